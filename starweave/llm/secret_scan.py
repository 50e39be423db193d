"""Secret scans: regular-expression candidates, judged by how many owners in the corpus hold them.

Candidates come from built-in regular expressions; their values are hashed, and one aggregate over
the corpus counts the distinct owners and repositories that hold each hash. A value held by several
owners or by many repositories is a copied example; any other that looks random is a live credential.
The base kinds are always reported. Candidates of the extra kind ``mixed`` (long tokens of upper
case, lower case and digits, without a telling name before them) are reported only when the
ownership count says that they are live, and when no base span overlaps them.

Everything is DataFrame expressions. Only candidate rows are shuffled, never texts. Positions are
code points, end exclusive: texts are split at the matches and the lengths are added up.

Defined results: a null text counts as empty and has no spans; null owners are one owner, a null
repository is one repository; repeated rows are reported one by one; null ids pass through; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starweave.llm.common import col, documents, fresh, quoted, stored

# The contract's three base kinds in order, and the extra kind of the method.
# Hexadecimal runs and access keys are matched from the minimum length on, which equals dropping
# the short matches: a shorter run cannot hold a longer one.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{16,}",
    "mixed": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}",
}
BASE = ("assign", "access", "hex")
NAMES = list(KINDS)
#: A value of this many owners, or of this many repositories (of one owner, too), is a copied example.
#: A pair of copies reaches neither.
COPIED_OWNERS, COPIED_REPOS = 3, 10
#: Live credentials have this many different characters at least.
LIVE_CHARACTERS = 10


def _live_looking(value: Column) -> Column:
    """Random by its characters: many different ones, letters and digits."""
    return (value.rlike("[0-9]") & value.rlike("[A-Za-z]")
            & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARACTERS))


def _hits(kind: str, matches: Column, text: Column) -> Column:
    """Per match: kind, number, characters since the last match, length, value hash, does it count, is it live-looking."""
    pattern = KINDS[kind]
    gaps = F.split(text, pattern, -1)
    value = lambda m: F.regexp_extract(m, ASSIGN, 2) if kind == "assign" else m
    good = {
        "assign": lambda m: F.length(value(m)) >= 12,
        "mixed": lambda m: m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]"),
    }.get(kind, lambda m: F.lit(True))
    rows = F.transform(F.arrays_zip(matches.alias("m"), gaps.alias("g")), lambda x, i: F.struct(
        F.lit(NAMES.index(kind)).alias("kind"), i.alias("k"), F.length(x["g"]).cast("long").alias("gap"),
        F.length(x["m"]).cast("long").alias("len"), F.unhex(F.sha2(value(x["m"]).cast("binary"), 256)).alias("hash"),
        good(x["m"]).alias("good"), _live_looking(value(x["m"])).alias("live")))
    return F.when(F.size(matches) > 0, F.filter(rows, lambda r: r["len"].isNotNull())).otherwise(F.array())


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """One row per document, with the candidates of every kind in the array ``hits``."""
    names = ["doc_id", "text", "owner", "repo"]
    df = docs.select(col(docs, id_col).cast("long").alias("doc_id"),
                     F.coalesce(col(docs, text_col).cast("string"), F.lit("")).alias("text"),
                     F.coalesce(col(docs, owner_col).cast("string"), F.lit("")).alias("owner"),
                     F.coalesce(col(docs, repo_col).cast("string"), F.lit("")).alias("repo"))
    found = df.select(*names, *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in KINDS.items()))
    hits = F.concat(*(_hits(k, F.col(f"m_{k}"), F.col("text")) for k in KINDS))
    return found.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "owner", "repo",
                        F.md5("text").alias("digest"), hits.alias("hits"))


def ownership(hits: DataFrame) -> DataFrame:
    """``(hash, n_owners, n_repos)``: distinct owners and distinct repositories of each value; null is one of them."""
    owners, repos = (hits.select("hash", c).distinct().groupBy("hash").agg(F.count("*").alias(n))
                     for c, n in (("owner", "n_owners"), ("repo", "n_repos")))
    return owners.join(repos, "hash")


def _placed(table: DataFrame) -> DataFrame:
    """One row per good candidate, with its start and end."""
    rows = table.filter(F.size("hits") > 0).select("rid", "owner", "repo", F.inline("hits"))
    run = Window.partitionBy("rid", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(run))
    return rows.filter("good").select("rid", "owner", "repo", "kind", (F.col("end") - F.col("len")).alias("start"),
                                      "end", "hash", "live")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                  repo_col: str = "doc_id", copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """One row per document: counts per base kind, the digest of the base spans, all spans, and how
    many reported spans are live (not copied, random-looking) or copied, in all and by each count
    (``copied_owners`` owners or more, ``copied_repos`` repositories or more)."""
    return _report(docs, id_col, text_col, owner_col, repo_col, copied_owners, copied_repos).drop("cuts")


def _report(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str,
            copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """The report with ``cuts``: each span's start and end, and the furthest end before it."""
    table = stored(candidates(docs, id_col, text_col, owner_col, repo_col), "secrets")
    hits = stored(_placed(table), "secret-hits")
    counts = stored(ownership(hits), "secret-owners")
    mixed = NAMES.index("mixed")
    judged = hits.select("rid", "kind", "start", "end", "hash", "live").join(counts, "hash").select(
        "rid", "kind", "start", "end", (F.col("n_owners") >= copied_owners).alias("by_owners"),
        (F.col("n_repos") >= copied_repos).alias("by_repos"), "live")
    copied = F.col("by_owners") | F.col("by_repos")
    judged = judged.withColumn("copied", copied).withColumn("live", F.col("live") & ~copied)
    judged = judged.filter((F.col("kind") != mixed) | F.col("live"))
    is_base = F.col("kind") != mixed
    before = Window.partitionBy("rid").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The rows that follow, read backwards: a frame that ends with the last row is computed anew for every row.
    after = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    judged = judged.withColumn("reach", F.max(F.when(is_base, F.col("end"))).over(before)).withColumn(
        "next", F.min(F.when(is_base, F.col("start"))).over(after))
    judged = judged.filter(is_base | ((F.coalesce("reach", F.lit(0)) <= F.col("start"))
                                      & (F.coalesce("next", "end") >= F.col("end"))))
    earlier = Window.partitionBy("rid").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    judged = judged.withColumn("since", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    name = F.element_at(F.array(*map(F.lit, NAMES)), F.col("kind") + 1)
    count = lambda k: F.count_if(F.col("kind") == NAMES.index(k)).alias(f"n_{k}")
    span = F.struct("start", "kind", "end", F.concat_ws(":", name, "start", "end").alias("text"), "since")
    per_doc = judged.groupBy("rid").agg(
        *(count(k) for k in BASE), F.count_if("live").alias("n_live"), F.count_if("copied").alias("n_copied"),
        F.count_if("by_owners").alias("n_copied_owners"), F.count_if("by_repos").alias("n_copied_repos"),
        F.sort_array(F.collect_list(span)).alias("all"))
    text = lambda a: F.array_join(F.transform(a, lambda s: s["text"]), ",")
    per_doc = per_doc.select(
        "rid", *(f"n_{k}" for k in BASE), "n_live", "n_copied", "n_copied_owners", "n_copied_repos", text(F.col("all")).alias("spans"),
        F.transform("all", lambda s: F.struct(s["start"].cast("int").alias("a"), s["end"].cast("int").alias("b"),
                                              s["since"].cast("int").alias("since"))).alias("cuts"),
        text(F.filter("all", lambda s: s["kind"] != mixed)).alias("base"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return table.select("rid", "doc_id", "digest").join(per_doc, "rid", "left").select(
        "doc_id", *(zero(f"n_{k}") for k in BASE),
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"), zero("n_live"), zero("n_copied"),
        zero("n_copied_owners"), zero("n_copied_repos"), "digest", "cuts")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
           repo_col: str = "doc_id", mask: str = "[SECRET]") -> DataFrame:
    """All documents, with every reported span of the text replaced by ``mask``.

    Spans are a function of the text alone (ownership is counted per value), so they are matched to
    documents by the text's digest, one row per distinct text that has any.
    """
    report = _report(docs, id_col, text_col, owner_col, repo_col)
    spans = stored(report.filter("spans <> ''").groupBy("digest").agg(F.any_value("cuts").alias("cuts")), "secret-spans")
    d, s, t = (fresh(docs.columns, x) for x in ("digest", "spans", "text"))
    spans = spans.select(F.col("digest").alias(d), F.col("cuts").alias(s))
    text = col(docs, text_col).cast("string")
    mine = [col(docs, c) for c in docs.columns]
    df = docs.select(*mine, F.md5(F.coalesce(text, F.lit(""))).alias(d)).join(spans, d, "left")
    df = df.select(*(F.col(quoted(c)) for c in docs.columns), F.col(s))
    body, cuts = F.col(quoted(text_col)).cast("string"), F.col(s)

    def masked(wide: Column) -> Column:
        """The text from its four-byte characters, of which a piece is copied without walking to it."""
        piece = lambda a, b: F.decode(F.substring(wide, 4 * a + 1, 4 * (b - a)), "UTF-32")
        # Overlapping spans: each starts after the furthest end before it, or inside what is masked already.
        parts = F.transform(cuts, lambda x: F.when(x["a"] >= x["since"], F.concat(piece(x["since"], x["a"]), F.lit(mask)))
                            .otherwise(F.lit("")))
        last = F.array_max(F.transform(cuts, lambda x: x["b"]))
        return F.concat(F.array_join(parts, ""), piece(last, (F.octet_length(wide) / 4).cast("int")))

    # One element: its lambda binds the encoded text once for all pieces.
    new = F.when(cuts.isNull(), body).otherwise(F.transform(F.array(F.encode(body, "UTF-32")), masked)[0])
    df = df.select(*(F.col(quoted(c)) for c in docs.columns), new.alias(t))
    return df.select(*(F.col(t).alias(c) if c == text_col else F.col(quoted(c)) for c in docs.columns))
