"""Alignment of two tokenizers' ids over whole texts, as an associative fold of fragments.

Tokenizer A is a byte-level BPE vocabulary (it encodes a space and the text), tokenizer B a
SentencePiece BPE model, which adds that space itself. Where tokens of both end at one byte, the text is
cut into groups. A byte range knows the tokens that end in it, and so gives a **fragment**: an open
prefix (tokens up to its first common end, whose group may have begun before the range), closed groups,
and an open suffix (tokens after its last common end). Fragments of adjacent ranges compose: suffix and
prefix between them close one group. Composition is associative, so ranges can be encoded anywhere and
composed in any tree.

A text of up to ``LONG`` bytes is folded inside one task. Its ranges are the words: both tokenizers cut
before a space that follows a character other than white space, so a word's fragment depends on the word
alone and has no open end on either side; the words that a task has not met are worked out together, and
those of frequent words are kept. A longer text is cut for each tokenizer
at that tokenizer's own places, encoded by many tasks, dealt into byte ranges of ``STEP`` bytes (which
split tokens and groups anywhere), and a tree of Spark groupings composes ``FAN`` fragments at a time.

A link is a pair of tokens that end together. One of two such tokens is a suffix of the other, so the
pairs that can ever be linked number at most the bytes of all tokens times the ids that share a token's
bytes: the table of pair counts has a bound set by the vocabularies, which ``pair_counts`` checks. It is
counted in every task, summed by Spark and broadcast.

Defined results: texts that are null or empty, or that a tokenizer does not give back byte for byte (a
text that holds U+2581, say), have no tokens: zeros and an empty string; strings of special tokens are
plain text; repeated rows and null ids are aligned each; texts of any length are aligned whole; an empty
table gives an empty result; other columns of ``docs`` are not used.
"""

from __future__ import annotations

import contextlib
import gc
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starweave.llm.common import documents, stored
from starweave.llm.tokens import _IRREGULAR, PATTERN, _byte_of

LONG = 1 << 16  # bytes of text beyond which a document is spread over tasks
STEP = 1 << 14  # bytes of a range of such a document
FAN = 8  # fragments composed at once
_ROWS = 256  # texts worked on at a time
_MARK = "▁"
_SPACE = re.compile(r"\s")
_CUT_BOTH = re.compile(r"(?<=\S)(?= )")  # both tokenizers cut here
_CUT_A = re.compile(r"(?<=\S)(?=\s)")
_CUT_B = re.compile(r"(?<=[^ ])(?= )")


# ---- the monoid ------------------------------------------------------------------------------

class Fragment:
    """Tokens that end in a byte range. Without a common end in it (``cut``), all are in the suffix."""

    __slots__ = ("cut", "pre", "body", "suf", "links")

    def __init__(self, cut=False, pre=((), ()), body="", suf=((), ()), links=()) -> None:
        self.cut, self.pre, self.body, self.suf, self.links = cut, pre, body, suf, links


def group(tokens) -> str:
    return ",".join(map(str, tokens[0])) + "|" + ",".join(map(str, tokens[1]))


def fragment(a: list[int], ends_a: list[int], b: list[int], ends_b: list[int]) -> Fragment:
    """The fragment of a range from the ids that end in it and the bytes where they end."""
    out, groups, links = Fragment(), [], []
    i = j = i0 = j0 = 0
    while i < len(a) and j < len(b):
        if ends_a[i] == ends_b[j]:
            links.append(a[i] << 32 | b[j])
            i, j = i + 1, j + 1
            if out.cut:
                groups.append(group((a[i0:i], b[j0:j])))
            else:
                out.cut, out.pre = True, (tuple(a[:i]), tuple(b[:j]))
            i0, j0 = i, j
        elif ends_a[i] < ends_b[j]:
            i += 1
        else:
            j += 1
    out.body, out.suf, out.links = ";".join(groups), (tuple(a[i0:]), tuple(b[j0:])), tuple(links)
    return out


def compose(x: Fragment, y: Fragment) -> Fragment:
    """Of two adjacent ranges the fragment of both; associative, with ``Fragment()`` as its identity."""
    between = (x.suf[0] + y.pre[0], x.suf[1] + y.pre[1])
    if not y.cut:
        return Fragment(x.cut, x.pre, x.body, (x.suf[0] + y.suf[0], x.suf[1] + y.suf[1]), x.links + y.links)
    if not x.cut:
        return Fragment(True, between, y.body, y.suf, x.links + y.links)
    return Fragment(True, x.pre, ";".join(s for s in (x.body, group(between), y.body) if s), y.suf, x.links + y.links)


def finished(x: Fragment) -> str:
    """All groups of a whole text, whose start and end are common."""
    return ";".join(s for s in (group(x.pre), x.body) if s)


# ---- the two tokenizers, in a task -----------------------------------------------------------

class Pair:
    """Both tokenizers with the bytes of their tokens, and the fragments of frequent words."""

    LIMIT = 100_000  # words kept

    def __init__(self, vocabulary: bytes, model: bytes) -> None:
        spec = json.loads(vocabulary)
        byte = _byte_of()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        self.a = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id(_MARK)
        # A piece with a mark behind another character would cross words: then texts are not cut.
        self.cuts = not any(_MARK in p.lstrip(_MARK) for p in pieces)
        self._len_a, self._len_b = (np.array([len(t) for t in table]) for table in (self.bytes_a, self.bytes_b))
        # Each id as text, followed by a comma, or by what ends its side of a group.
        self._text = [f"{i}{mark}" for i in range(len(self.bytes_a)) for mark in ",|"]
        self._text += [f"{i}{mark}" for i in range(len(self.bytes_b)) for mark in ",;"]
        self.words: dict[str, tuple | None] = {}

    def ids_b(self, words: list[str]) -> list[list[int]]:
        """B's ids of each word, with the space that the model adds."""
        return [ids if w else [self.space] for w, ids in zip(words, self.b.encode(words, num_threads=1))]

    def ends(self, ids: list[int], table) -> list[int]:
        return np.cumsum([len(table[i]) for i in ids], dtype=np.int64).tolist()

    def learn(self, words: list[str]) -> dict[str, tuple | None]:
        """(tokens of A and, times 2^32, of B; groups, each with its ``;``; link codes) of each word, all worked out together.

        Every word is a range that starts and ends at a common end, so the ends that the two streams share
        close the groups of all words at once. None: the bytes of a word are not given back.
        """
        if "" in words or _SPACE.search("".join(words)):  # A cuts such a word as it likes: its ids are asked for alone
            odd = {w for w in words if not w or _SPACE.search(w)}
            return {**self._learn([w for w in words if w not in odd]), **self._learn(list(odd), False)}
        return self._learn(words)

    def _learn(self, words: list[str], together: bool = True) -> dict[str, tuple | None]:
        if not words:
            return {}
        lists = self.ids_b(words)
        b = list(itertools.chain.from_iterable(lists))
        text = f" {' '.join(words)}"
        raw = text.encode()
        if b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            good = [w for w, ids in zip(words, lists) if b"".join([self.bytes_b[i] for i in ids]) == b" " + w.encode()]
            return {**dict.fromkeys(words), **(self._learn(good, together) if len(good) < len(words) else {})}
        if together:
            a = self.a.encode_ordinary(text)
            last = np.append(np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 32)[1:], len(raw))
        else:
            a = [i for w in words for i in self.a.encode_ordinary(" " + w)]
            last = np.cumsum([len(w.encode()) + 1 for w in words])
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        end_a, end_b = np.cumsum(self._len_a[a]), np.cumsum(self._len_b[b])
        at = np.searchsorted(end_b, end_a)
        hit = end_b[at] == end_a
        common, link = end_a[hit], a[hit] << 32 | b[at[hit]]
        closes = np.zeros(len(b), dtype=bool)
        closes[at[hit]] = True
        group_a, group_b = np.cumsum(hit) - hit, np.cumsum(closes) - closes
        # Of each group first the ids of A, then those of B.
        shown = np.empty(len(a) + len(b), dtype=np.int64)
        shown[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = 2 * a + hit
        shown[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = 2 * (len(self.bytes_a) + b) + closes
        shown = list(map(self._text.__getitem__, shown.tolist()))
        n_a, n_b, n = (np.diff(np.searchsorted(e, last, side="right"), prepend=0) for e in (end_a, end_b, common))
        codes, tokens = link.astype("<i8").tobytes(), (n_a + (n_b << 32)).tolist()
        to, upto = np.cumsum(n_a + n_b).tolist(), (8 * np.cumsum(n)).tolist()
        return {w: (t, "".join(shown[x:y]), codes[p:q])
                for w, t, x, y, p, q in zip(words, tokens, [0, *to], to, [0, *upto], upto)}

    def split(self, text: str) -> list[str]:
        """The words of a space and the text, each without the space before it."""
        if not self.cuts:
            return [text]
        if "  " in text or text[0] == " " or text[-1] == " " or _IRREGULAR.search(text):
            return [w[1:] for w in _CUT_BOTH.split(" " + text)]
        return text.split(" ")

    def fold(self, texts: list[str]) -> list[tuple]:
        """(A tokens, B tokens, links, groups, link codes) of whole texts."""
        cut = [self.split(t) if t else [] for t in texts]
        known = self.words
        new = self.learn(list(set().union(*cut).difference(known)))
        known.update(new)
        out = []
        for words in cut:
            own = list(map(known.__getitem__, words))
            if not own or None in own:
                out.append((0, 0, 0, "", b""))
            else:
                tokens, groups, codes = zip(*own)
                n, codes = sum(tokens), b"".join(codes)
                out.append((n & 0xFFFFFFFF, n >> 32, len(codes) // 8, "".join(groups)[:-1], codes))
        if len(known) > self.LIMIT:
            for w in new:
                del known[w]
        return out


def _pair(box: Broadcast) -> Pair:
    """The tokenizers of this Python worker; later tasks of the worker find them, and the words met, in the broadcast value."""
    if "pair" not in box.value:
        box.value["pair"] = Pair(box.value["vocabulary"], box.value["model"])
    return box.value["pair"]


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups string, links binary"


def _batch(names: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "int": pa.int32()}
    fields = [f.split() for f in names.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _fold(box: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # no cycles are made here, and the words kept are many
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, _ROWS):
                    part = batch.slice(at, _ROWS)
                    done = _pair(box).fold([t or "" for t in part.column("text").to_pylist()])
                    yield _batch(_ALIGNED, [(d, *row) for d, row in zip(part.column("doc_id").to_pylist(), done)])
        finally:
            gc.enable()

    return run


# ---- long texts: pieces, ranges, tree --------------------------------------------------------

_PIECE = "rid long, doc_id long, side string, start long, size long, text string"
_RANGE = "rid long, doc_id long, side string, start long, bucket long, last long, ok boolean, ids binary, ends binary"
_FRAGMENT = ("rid long, doc_id long, bucket long, last long, ok boolean, n_a long, n_b long, cut boolean, "
             "pre_a binary, pre_b binary, body string, suf_a binary, suf_b binary, links binary")


def _pieces(step: int, box: Broadcast):
    """Each tokenizer's own pieces of a text, of about ``step`` bytes, with the bytes where they start."""
    def cut(text: str, safe: re.Pattern) -> Iterator[tuple[int, str]]:
        start, at = 0, 0
        while at < len(text):
            found = safe.search(text, at + step) if at + step < len(text) else None
            piece = text[at:found.start() if found else len(text)]
            yield start, piece
            start, at = start + len(piece.encode()), at + len(piece)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = _pair(box).cuts
        for batch in batches:
            for rid, doc, text in zip(*(batch.column(c).to_pylist() for c in ("rid", "doc_id", "text"))):
                text = " " + text
                size = len(text.encode())
                rows = [(rid, doc, "a", start, size, piece) for start, piece in cut(text, _CUT_A)]
                rows += [(rid, doc, "b", start, size, piece) for start, piece in (cut(text, _CUT_B) if cuts else [(0, text)])]
                yield _batch(_PIECE, rows)

    return run


def _ranges(step: int, box: Broadcast):
    """Ids of each piece, dealt into the byte ranges in which they end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, doc, side, start, size, text in zip(*(c.to_pylist() for c in batch.columns)):
                pair = _pair(box)
                ids = pair.a.encode_ordinary(text) if side == "a" else pair.ids_b([text[1:]])[0]
                table = pair.bytes_a if side == "a" else pair.bytes_b
                ok = b"".join([table[i] for i in ids]) == text.encode()
                last = (size - 1) // step
                if not ok:
                    yield _batch(_RANGE, [(rid, doc, side, start, 0, last, False, b"", b"")])
                    continue
                ends = np.array(pair.ends(ids, table), dtype="<i8") + start
                own, at = np.unique((ends - 1) // step, return_index=True)
                edges = [*at.tolist(), len(ids)]
                raw = np.array(ids, dtype="<u4")
                yield _batch(_RANGE, [(rid, doc, side, start, int(k), last, True, raw[x:y].tobytes(), ends[x:y].tobytes())
                                      for k, x, y in zip(own, edges, edges[1:])])

    return run


def _ids(raw: bytes) -> tuple[int, ...]:
    return tuple(np.frombuffer(raw, dtype="<u4").tolist())


def _row(rid, doc, bucket, last, ok, n_a, n_b, f: Fragment) -> tuple:
    pack = lambda ids: np.array(ids, dtype="<u4").tobytes()
    return (rid, doc, bucket, last, ok, n_a, n_b, f.cut, pack(f.pre[0]), pack(f.pre[1]), f.body, pack(f.suf[0]), pack(f.suf[1]),
            np.array(f.links, dtype="<i8").tobytes())


def _fragments(table: pa.Table) -> pa.Table:
    """One fragment of all ids that end in one byte range of a text."""
    rows = sorted(table.to_pylist(), key=lambda r: r["start"])
    ids, ends = {"a": [], "b": []}, {"a": [], "b": []}
    for r in rows:
        ids[r["side"]] += np.frombuffer(r["ids"], dtype="<u4").tolist()
        ends[r["side"]] += np.frombuffer(r["ends"], dtype="<i8").tolist()
    ok = all(r["ok"] for r in rows)
    f = fragment(ids["a"], ends["a"], ids["b"], ends["b"]) if ok else Fragment()
    head = rows[0]
    return pa.Table.from_batches([_batch(_FRAGMENT, [_row(head["rid"], head["doc_id"], head["bucket"], head["last"], ok,
                                                          len(ids["a"]), len(ids["b"]), f)])])


def _composed(table: pa.Table) -> pa.Table:
    """Adjacent fragments of one text as one."""
    rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
    whole, ok = Fragment(), all(r["ok"] for r in rows)
    for r in rows if ok else ():
        whole = compose(whole, Fragment(r["cut"], (_ids(r["pre_a"]), _ids(r["pre_b"])), r["body"],
                                        (_ids(r["suf_a"]), _ids(r["suf_b"])), tuple(np.frombuffer(r["links"], dtype="<i8").tolist())))
    head = rows[0]
    return pa.Table.from_batches([_batch(_FRAGMENT, [_row(head["rid"], head["doc_id"], head["bucket"] // FAN, head["last"], ok,
                                                          sum(r["n_a"] for r in rows), sum(r["n_b"] for r in rows), whole)])])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            if r["ok"]:
                f = Fragment(r["cut"], (_ids(r["pre_a"]), _ids(r["pre_b"])), r["body"])
                yield _batch(_ALIGNED, [(r["doc_id"], r["n_a"], r["n_b"], len(r["links"]) // 8, finished(f), r["links"])])
            else:
                yield _batch(_ALIGNED, [(r["doc_id"], 0, 0, 0, "", b"")])


def _align_long(docs: DataFrame, box: Broadcast, step: int) -> DataFrame:
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    pieces = stored(numbered.mapInArrow(_pieces(step, box), _PIECE), "pieces")  # fixes the row numbers
    longest = pieces.agg(F.max("size")).first()[0]
    spread = pieces.repartition("rid", "side", "start")  # pieces of one text go to many tasks
    level = spread.mapInArrow(_ranges(step, box), _RANGE).groupBy("rid", "bucket").applyInArrow(_fragments, _FRAGMENT)
    ranges = -(-(longest or 0) // step)
    while ranges > 1:  # every round leaves one fragment in ``FAN``
        level = level.groupBy("rid", F.floor(F.col("bucket") / FAN)).applyInArrow(_composed, _FRAGMENT)
        ranges = -(-ranges // FAN)
    return level.mapInArrow(_finish, _ALIGNED)


def align(docs: DataFrame, vocabulary: str, model: str, id_col: str = "doc_id", text_col: str = "text",
          long_bytes: int = LONG, step: int = STEP) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, groups (``a1,a2|b1;a3|b2,b3``), links (pair codes, 64-bit).

    ``vocabulary`` and ``model`` are paths that the driver can read; their content goes to the executors.
    """
    with open(vocabulary, "rb") as v, open(model, "rb") as m:
        box = docs.sparkSession.sparkContext.broadcast({"vocabulary": v.read(), "model": m.read()})
    base = documents(docs, id_col, text_col)
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short = base.filter(size <= long_bytes).mapInArrow(_fold(box), _ALIGNED)
    return short.unionByName(_align_long(base.filter(size > long_bytes), box, step))


# ---- links over the corpus -------------------------------------------------------------------

def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in _slices(batches):
        own = np.frombuffer(b"".join(part.column("links").to_pylist()), dtype="<i8")
        new, n = np.unique(own, return_counts=True)
        codes, at = np.unique(np.concatenate((codes, new)), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate((counts, n)), minlength=len(codes)).astype(np.int64)
    for a in range(0, len(codes), 10_000):
        yield pa.record_batch([pa.array(codes[a:a + 10_000]), pa.array(counts[a:a + 10_000])], names=["code", "n"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """How many links hold each pair: code (A id times 2^32 plus B id), n."""
    return aligned.select("links").mapInArrow(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def pair_bound(vocabulary: str, model: str) -> int:
    """Most pairs that can ever be linked: one token of a pair is a suffix of the other."""
    with open(vocabulary, "rb") as v, open(model, "rb") as m:
        pair = Pair(v.read(), m.read())
    total = 0
    for own, other in ((pair.bytes_a, pair.bytes_b), (pair.bytes_b, pair.bytes_a)):
        shared: dict[bytes, int] = {}
        for token in other:
            shared[token] = shared.get(token, 0) + 1
        total += sum(shared.get(token[i:], 0) for token in own for i in range(len(token)))
    return total


def _judge(table: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, best = table.value
        for batch in _slices(batches):
            links = batch.column("links").to_pylist()
            at = np.searchsorted(codes, np.frombuffer(b"".join(links), dtype="<i8"))
            edge = np.cumsum([0] + [len(x) // 8 for x in links])
            total, top = (np.concatenate((np.zeros(1, np.int64), np.cumsum(x[at]))) for x in (counts, best))
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")), pa.array(np.diff(edge)),
                                   pa.array(top[edge[1:]] - top[edge[:-1]]), pa.array(total[edge[1:]] - total[edge[:-1]]),
                                   batch.column("groups_sha256")],
                                  names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return run


def _sent(spark: SparkSession, counts: DataFrame, bound: int) -> Broadcast:
    """Pair counts and which of them are the most that their B id has, sorted by code."""
    rows = counts.toPandas()
    if len(rows) > bound:
        raise RuntimeError(f"{len(rows)} linked pairs, {bound} can exist")
    code, n = (rows[c].to_numpy(dtype=np.int64) for c in ("code", "n"))
    by = np.argsort(code)
    code, n = code[by], n[by]
    b = code & 0xFFFFFFFF
    most = np.zeros(int(b.max(initial=-1)) + 1, dtype=np.int64)
    np.maximum.at(most, b, n)
    return spark.sparkContext.broadcast((code, n, (n == most[b]).astype(np.int64)))


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows go to Python a thousand at a time while jobs run here: a text's links are longer than the text."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def alignment_report(docs: DataFrame, vocabulary: str, model: str, id_col: str = "doc_id", text_col: str = "text",
                     long_bytes: int = LONG, step: int = STEP) -> DataFrame:
    """Per document: tokens, groups and links, how many links are the commonest of their B id, the sum of their counts,
    and the digest of the groups."""
    with _small_batches(docs.sparkSession):
        aligned = align(docs, vocabulary, model, id_col, text_col, long_bytes, step)
        digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
        aligned = stored(aligned.withColumn("groups_sha256", digest).drop("groups"), "aligned")
        table = _sent(docs.sparkSession, pair_counts(aligned), pair_bound(vocabulary, model))
        return stored(aligned.mapInArrow(_judge(table), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                                                        "count_sum long, groups_sha256 string"), "alignment")
