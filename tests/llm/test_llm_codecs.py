"""Fill-in-middle, tokenizer alignment and WARC archives: against plain Python, odd rows, empty tables, long texts."""

import base64
import collections
import gzip
import hashlib
import random
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from fixtures_llm import odd, rows, table
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from starweave.llm import align, fim, warc
from starweave.llm.queries import ORACLE, QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "the ", "b", " ", "  ", "\n", "\t", "é", "中", "😀", "<|endoftext|>", "<s>", "'s ", "12", "▁", "\x00", "!!", " ",
            "\r\n", " ", "ing ", "<P>", "<S>", "<M>", "<", "S>"]


def texts(n: int, alphabet=ALPHABET) -> list:
    rng = random.Random(5)
    some = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    long = ["".join(rng.choice(ALPHABET[:10]) for _ in range(4000)), "ab" * 3000, " " * 2000, "é" * 3000]
    return [None, "", " ", "  ", "a ", "\n", " a", "a  b", *some, *long]


def docs(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---- fill in middle --------------------------------------------------------------------------

def fim_brute(doc_id, text):
    t = text or ""
    n, d = len(t), sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(d[8 * i:8 * i + 8], 16) for i in range(4)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    plain = not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90
    p, m, s = t[:lo], t[lo:hi], t[hi:]
    form = "plain" if plain else "spm" if h[3] % 100 < 20 else "psm"
    out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    return (doc_id, n, form, None if plain else lo, None if plain else hi - lo, out)


def test_fim(spark):
    values = texts(300) + texts(300, ALPHABET[:15])
    df = docs(spark, values)
    want = [fim_brute(i, t) for i, t in enumerate(values)]
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    got = fim.transform(df)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want, key=lambda w: w[0])
    back = {r.doc_id: r for r in fim.restore(got).collect()}
    assert all((back[w[0]].text, back[w[0]].prefix_chars, back[w[0]].middle_chars) == (values[w[0]] or "", w[3], w[4]) for w in want)
    report = {r.doc_id: r for r in fim.fim_report(df).collect()}
    assert all((report[w[0]].output_sha256, report[w[0]].restored_sha256) == (sha(w[5]), sha(values[w[0]] or "")) for w in want)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_exception_index(text):
    raw = text.encode("utf-8", "ignore")
    text = raw.decode()
    index = fim.ExceptionIndex(np.frombuffer(raw, dtype=np.uint8))
    cuts = np.arange(len(text) + 1)
    at = index.to_bytes(cuts)
    assert at.tolist() == [len(text[:i].encode()) for i in range(len(text) + 1)]
    assert index.to_chars(at).tolist() == cuts.tolist()


def test_fim_buffers_are_cut_and_joined(spark, monkeypatch):
    monkeypatch.setattr(fim, "_BYTES", 64)
    import pyarrow as pa

    values = [b"", b"x" * 200, b"abc", "é".encode() * 20, b""]
    column = pa.array([b"zz", *values]).slice(1)
    got = [raw[x:y] for a, b, raw, at in fim.buffers(column) for x, y in zip(at, at[1:])]
    assert got == values


# ---- alignment -------------------------------------------------------------------------------

def align_brute(values):
    a_lib = Tokenizer.from_file(A)
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=B)
    with open(A, "rb") as v, open(B, "rb") as m:
        pair = align.Pair(v.read(), m.read())
    out, count = [], collections.Counter()
    for t in values:
        raw = (" " + t).encode() if t else b""
        a = a_lib.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_lib.encode(t) if t else []
        if not t or b"".join(pair.bytes_a[i] for i in a) != raw or b"".join(pair.bytes_b[i] for i in b) != raw:
            out.append(None)
            continue
        end_a, end_b = np.cumsum([len(pair.bytes_a[i]) for i in a]), np.cumsum([len(pair.bytes_b[i]) for i in b])
        groups, links, i, j = [], [], 0, 0
        for e in sorted(set(end_a.tolist()) & set(end_b.tolist())):
            i2, j2 = int((end_a <= e).sum()), int((end_b <= e).sum())
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            i, j = i2, j2
        links = [(x, y) for x, ex in zip(a, end_a) for y, ey in zip(b, end_b) if ex == ey] if len(a) * len(b) < 10**6 else None
        if links is None:
            at = {e: y for y, e in zip(b, end_b)}
            links = [(x, at[e]) for x, e in zip(a, end_a) if e in at]
        count.update(links)
        out.append((len(a), len(b), groups, links))
    best = collections.Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(i, 0, 0, 0, 0, 0, 0, "") if r is None else
            (i, r[0], r[1], len(r[2]), len(r[3]), sum(count[x] == best[x[1]] for x in r[3]), sum(count[x] for x in r[3]), sha(";".join(r[2])))
            for i, r in enumerate(out)]


@pytest.mark.parametrize("limits", [{}, {"long_bytes": 200, "step": 64}, {"long_bytes": 0, "step": 7}])
def test_alignment(spark, limits):
    values = texts(150)
    got = sorted(tuple(r) for r in align.alignment_report(docs(spark, values), A, B, **limits).collect())
    want = align_brute(values)
    assert got == want and sum(w[1] > 0 for w in want) > 60


def test_alignment_groups_cover_the_text(spark):
    values = ["plain words, and numbers 12345", "déjà vu 中文\n\nend"]
    with open(A, "rb") as v, open(B, "rb") as m:
        pair = align.Pair(v.read(), m.read())
    for r in align.align(docs(spark, values), A, B).collect():
        for side, part in ((pair.bytes_a, 0), (pair.bytes_b, 1)):
            ids = [int(i) for g in r.groups.split(";") for i in g.split("|")[part].split(",")]
            assert b"".join(side[i] for i in ids).decode() == " " + values[r.doc_id]


_ENDS = st.lists(st.integers(1, 60), unique=True, max_size=25).map(sorted)


def _same(x, y):
    return (x.cut, x.pre, x.body, x.suf, tuple(x.links)) == (y.cut, y.pre, y.body, y.suf, tuple(y.links))


@settings(max_examples=200, deadline=None)
@given(_ENDS, _ENDS, st.lists(st.integers(0, 60), min_size=2, max_size=2).map(sorted))
def test_fragments_form_a_monoid(end_a, end_b, cuts):
    edges = [0, *cuts, 60]
    parts = []
    for lo, hi in zip(edges, edges[1:]):
        a, b = ([e for e in ends if lo < e <= hi] for ends in (end_a, end_b))
        parts.append(align.fragment([100 + e for e in a], a, [200 + e for e in b], b))
    x, y, z = parts
    whole = align.fragment([100 + e for e in end_a], end_a, [200 + e for e in end_b], end_b)
    left, right = align.compose(align.compose(x, y), z), align.compose(x, align.compose(y, z))
    assert _same(left, right) and _same(left, whole)
    assert _same(align.compose(align.Fragment(), x), x) and _same(align.compose(x, align.Fragment()), x)


def test_pair_bound():
    assert 0 < align.pair_bound(A, B) < 10**6


# ---- archives --------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def pages(spark, data):
    return spark.createDataFrame(data, PAGES)


def page_rows():
    big = "x" * 300_000 + "é"
    return [(5, "http://a.org/1", "same"), (3, "http://b.org/2", "same"), (9, None, "same"), (1, "", None), (2, "u v\r\nX: y", ""),
            (7, "http://a.org/1", "other"), (8, "http://a.org/1", big), (4, "http://a.org/1", big),
            *((100 + i, "http://hot.org/", f"text {i % 40}") for i in range(200))]


def warc_brute(data):
    first = {}
    for i, _, h in data:
        first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in data:
        raw, f = (h or "").encode(), first[h or ""]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((i, len(raw), digest, "response" if f == i else "revisit", None if f == i else f))
    return sorted(out)


def test_archives(spark, tmp_path):
    data = page_rows()
    root = str(tmp_path / "out")
    df = pages(spark, data)
    got = sorted(tuple(r) for r in warc.archive_report(df, root=root).collect())
    assert got == warc_brute(data)
    # The files are ordinary archives: one gzip member per record.
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in Path(root, "archive").iterdir())
    assert raw.count(b"WARC/1.1\r\n") == len(data) and raw.count(warc.PROFILE.encode()) == sum(g[3] == "revisit" for g in got)


def test_lookup_of_some_urls(spark, tmp_path):
    data = page_rows()
    root = f"file://{tmp_path}/out"
    warc.write(pages(spark, data), root, block_lines=7, archive_bytes=2_000)
    assert len(list(Path(tmp_path, "out", "archive").iterdir())) > 1
    keys = spark.createDataFrame([("http://A.org:80/1#x",), ("http://none.org/",), ("http://hot.org",), ("http://a.org/1",)], "url string")
    keys = keys.select(warc.url_key(F.col("url")).alias("key"))
    places = warc.lookup(keys, root)
    records = warc.read(places, root)
    got = {r.page_id: r for r in warc.resolved(records.cache()).collect()}
    texts_of = {i: h for i, u, h in data if u in ("http://a.org/1", "http://hot.org/")}
    assert set(got) == set(texts_of)
    whole = {r.page_id: r for r in warc.resolved(warc.read(warc.lookup(
        pages(spark, data).select(warc.url_key(F.col("url")).alias("key")), root), root)).collect()}
    assert {i: r.payload.decode() for i, r in whole.items()} == {i: h or "" for i, _, h in data}


def test_url_keys(spark):
    want = {"http://WWW.Ex.com:8080/a?b#c": "com,ex,www:8080)/a?b", "https://u:p@a.b.c:443": "c,b,a)/", "http://1.2.3.4/x": "1.2.3.4)/x",
            None: "", "": "", "http://[::1]:80/x": "[::1])/x", "ex.com?q=1": "com,ex)/?q=1"}
    df = spark.createDataFrame([(u,) for u in want], "u string")
    assert {r.u: r.k for r in df.select("u", warc.url_key(F.col("u")).alias("k")).collect()} == want


def test_repeated_pages_and_null_ids(spark):
    data = [(1, "u", "a")] * 3 + [(None, "u", "a"), (None, "u", "b"), (2, "u", None)]
    df = pages(spark, data).select("*", F.lit(1).alias("capture"), F.lit(2).alias("key"), F.lit(3).alias("same"))
    got = sorted((tuple(r) for r in warc.archive_report(df).select("page_id", "record_type", "refers_to").collect()), key=str)
    assert got == sorted([(1, "response", None), (1, "revisit", 1), (1, "revisit", 1), (None, "revisit", 1), (None, "response", None),
                          (2, "response", None)], key=str)


# ---- all three -------------------------------------------------------------------------------

def test_empty_tables(spark):
    assert fim.fim_report(table(spark, [])).count() == 0
    assert align.alignment_report(table(spark, []), A, B).count() == 0
    assert warc.archive_report(pages(spark, [])).count() == 0


def test_odd_rows_and_columns(spark):
    df = odd(spark)
    n = df.count()
    assert fim.fim_report(df).count() == n
    got = align.alignment_report(df, A, B).collect()
    assert len(got) == n and {r.n_a for r in got if r.doc_id == 3} == {0}
    long = {d: t for d, t, *_ in rows()}
    assert {r.restored_sha256 for r in fim.fim_report(df).filter("doc_id = 11").collect()} == {sha(long[11])}


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_warc"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    found = con.sql(ORACLE[name])
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert got.columns == found.columns
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, found.fetchall()))
