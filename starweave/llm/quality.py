"""Quality rules: a threshold table compiled into one projection, without user functions.

Each document gets a few counts and ratios (length, symbols, stop words, repeated lines and word
windows); :data:`RULES` says which range each of them must lie in. Counts and rules are built-in
expressions over one row, so a document never leaves its scan task and nothing is shuffled.

Defined results: a null text counts as empty; an empty text has all counts 0 and fails the
word-count rule; repeated rows are judged one by one; null ids pass through; an empty table gives
an empty result. Any text length works: the cost is that of sorting its words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starweave.llm.common import col, documents, fresh, quoted

# Very frequent function words of the corpus languages, per language.
STOP_WORDS = {
    "en": "the be to of and that have with a in is it for on was as by this",
    "de": "der die das und in zu den von mit sich auf für ist im dem nicht ein eine",
    "fr": "le la les de des et un une du en à est que qui dans pour sur pas",
    "es": "el la los de que y en un una las por con para del se no su es",
}
STOP_SET = sorted({w for words in STOP_WORDS.values() for w in words.split()})


@dataclass(frozen=True)
class Rule:
    """``low <= signal <= high``; a bound that is None is open."""

    name: str
    signal: str
    low: float | None = None
    high: float | None = None


#: Thresholds of published web-text filters. The first two are the base rules of the contract.
RULES = (
    Rule("enough_words", "n_words", low=50),
    Rule("few_repeated_windows", "repeat_word_pct", high=50),
    Rule("mean_word_length", "mean_word_chars", low=2.5, high=12),
    Rule("few_symbols", "symbols_per_word", high=0.25),
    Rule("has_stop_words", "n_stop_words", low=2),
    Rule("few_repeated_lines", "dup_line_ratio", high=0.5),
)
BASE_RULES = ("enough_words", "few_repeated_windows")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _windows(words: Column) -> Column:
    """A 64-bit hash of each 3-word window, in order."""
    n = F.size(words)
    return F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
            F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))


#: A word position takes 24 bits of a packed sort key; longer texts are sorted as pairs.
_POSITION_BITS = 24


def _packed_order(windows: Column) -> Column:
    """(top 40 bits of the window, start) as one sorted array of longs: equal windows side by side."""
    low = (1 << _POSITION_BITS) - 1
    return F.sort_array(F.transform(windows, lambda w, i: w.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))


def _repeat_starts(windows: Column, packed: Column) -> Column:
    """Starts of the windows that occur twice or more, ascending.

    Neighbours in the packed order are compared as whole 64-bit windows. If two different windows
    share their top 40 bits, or the text is too long to pack, whole pairs are sorted instead.
    """
    low = F.lit((1 << _POSITION_BITS) - 1).cast("long")
    at = lambda k: F.get(windows, F.get(packed, k).bitwiseAND(low).cast("int"))
    top = lambda k: F.shiftright(F.get(packed, k), _POSITION_BITS)
    mixed = F.exists(F.sequence(F.lit(1), F.greatest(F.size(packed) - 1, F.lit(1))),
                     lambda k: (top(k) == top(k - 1)) & (at(k) != at(k - 1)))
    fast = F.filter(F.transform(F.filter(packed, lambda p, k: (top(k - 1) == top(k)) | (top(k) == top(k + 1))),
                                lambda p: p.bitwiseAND(low).cast("int")), lambda i: i.isNotNull())
    pairs = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    slow = F.aggregate(  # runs of equal windows, in order: keep the starts of those longer than one
        pairs, F.struct(F.array().cast("array<int>").alias("out"), F.lit(None).cast("bigint").alias("w"),
                        F.lit(-1).alias("i"), F.lit(False).alias("twice")),
        lambda a, p: F.struct(
            F.when(a["w"].eqNullSafe(p["w"]), F.concat(
                a["out"], F.when(a["twice"], F.array(p["i"])).otherwise(F.array(a["i"], p["i"])))
            ).otherwise(a["out"]).alias("out"),
            p["w"].alias("w"), p["i"].alias("i"), a["w"].eqNullSafe(p["w"]).alias("twice")),
        lambda a: a["out"])
    n = F.size(windows)
    return F.sort_array(F.when(n < 2, F.array().cast("array<int>"))
                        .when((n >= 1 << _POSITION_BITS) | mixed, slow).otherwise(fast))


def _covered(starts: Column) -> Column:
    """Words under the windows at ``starts`` (ascending): each adds the words up to the next, three at most."""
    return F.coalesce(F.aggregate(
        F.transform(starts, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - s, F.lit(3)))),
        F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))


def with_signals(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Add one struct column ``out`` with every signal that the rules may name.

    The arrays of words and windows are columns of their own in successive projections, each read
    more than once by the next, so Catalyst computes them once per row instead of inlining them.
    """
    names = [fresh([*df.columns, out], x) for x in ("text", "words", "lines", "counts", "windows", "packed")]
    t, w, ln, c, h, p = (F.col(quoted(x)) for x in names)
    mine = [F.col(quoted(x)) for x in df.columns]
    step = df.select(*mine, F.coalesce(col(df, text_col).cast("string"), F.lit("")).alias(names[0]))
    step = step.select(
        *mine, _words(t).alias(names[1]),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(names[2]),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long").alias(names[0]))
    stop = F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_SET)))
    step = step.select(*mine, _windows(w).alias(names[4]), F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        t.alias("n_symbols"), F.size(ln).cast("long").alias("n_lines"),
        (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
        stop.cast("long").alias("n_stop_words")).alias(names[3]))
    step = step.select(*mine, c, h, _packed_order(h).alias(names[5]))
    step = step.select(*mine, c, _repeat_starts(h, p).alias(names[5]))
    step = step.select(*mine, c, _covered(p).alias(names[5]))
    ratio = lambda x, y: F.when(c[y] > 0, c[x] / c[y])
    # One row each: a filter on a generated column is not pushed into the projections below, where
    # every signal would be computed again wherever it is named.
    return step.select(*mine, F.explode(F.array(F.struct(
        *(p.alias(x) if x == "n_repeat_words" else c[x].alias(x) for x in COUNTS),
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "n_words").alias("symbols_per_word"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio")))).alias(out))


def rule_holds(rule: Rule, signals: Column) -> Column:
    x = signals[rule.signal]
    if rule.signal == "repeat_word_pct":  # in whole numbers: exact at the threshold
        return 100 * signals["n_repeat_words"] <= rule.high * signals["n_words"]
    checks = ([x >= rule.low] if rule.low is not None else []) + ([x <= rule.high] if rule.high is not None else [])
    out = checks[0]
    for c in checks[1:]:
        out = out & c
    return F.coalesce(out, F.lit(True))  # a ratio of nothing breaks no rule


def verdict(signals: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    out = F.lit(True)
    for r in rules:
        out = out & rule_holds(r, signals)
    return out


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: id, all signals, ``base_failed``, ``kept`` and the first rule it breaks."""
    df = with_signals(documents(docs, id_col, text_col), "text", "q")
    q = F.col("q")
    failed = F.coalesce(*(F.when(~rule_holds(r, q), F.lit(r.name)) for r in rules), F.lit(None).cast("string"))
    base = ~verdict(q, tuple(r for r in rules if r.name in BASE_RULES))
    return df.select("doc_id", "q.*", base.alias("base_failed"), verdict(q, rules).alias("kept"),
                     failed.alias("failed_rule"))


def quality_filter(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that break no rule, with all their columns."""
    out = fresh(docs.columns, "q")
    kept = with_signals(docs, text_col, out)
    return kept.filter(verdict(F.col(out), rules)).select(*[col(docs, c) for c in docs.columns])
