"""Near-duplicate components at 80 and 85 percent on texts that share most of their words."""

import random

import numpy as np
import pytest
from fixtures_llm import shingle_set, table
from pyspark.sql import functions as F

from starweave.llm import minhash


def variants(n: int, changed: int, words: int = 200, seed: int = 1, chain: int = 0) -> list[str]:
    """Copies of one text with some words changed; with ``chain``, every copy starts from the one before it."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out, last = [], base
    for i in range(n):
        text = list(last if chain and i % chain else base)
        for at in rng.sample(range(words), changed):
            text[at] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(text))
        last = text
    return out


def brute(texts, percent):
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(sets)))
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("percent", [80, 85])
def test_components_equal_brute_force(spark, percent):
    texts = variants(120, 3) + variants(60, 5, seed=2) + variants(60, 1, seed=3, chain=6) + variants(30, 2, words=40, seed=4)
    docs = table(spark, [(i, t, None, None, 1) for i, t in enumerate(texts)])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, min_percent=percent).collect()}
    assert got == dict(enumerate(brute(texts, percent)))


def test_comparisons_grow_with_the_texts(spark, monkeypatch):
    made = []
    for n in (150, 300, 600):
        pairs, real = [], minhash._compared.__wrapped__ if hasattr(minhash._compared, "__wrapped__") else minhash._compared
        monkeypatch.setattr(minhash, "_compared", lambda p, s, real=real, pairs=pairs: (pairs.append(p.count()), real(p, s))[1])
        minhash.near_duplicates(table(spark, [(i, t, None, None, 1) for i, t in enumerate(variants(n, 5))]), min_percent=80)
        monkeypatch.undo()
        made.append(sum(pairs[1:]))  # after the buckets' own pivots
    assert made[1] <= 3 * max(made[0], 50) and made[2] <= 3 * max(made[1], 100) and made[2] <= 8 * 600


def test_bitmaps_never_claim_more_difference():
    rng = np.random.default_rng(1)
    for size in (1, 10, 300, 5000):
        x = rng.integers(0, 2**63, size).astype(np.uint64)
        y = np.concatenate((x[: size // 2], rng.integers(0, 2**63, size // 2 + 1).astype(np.uint64)))
        x, y = np.unique(x), np.unique(y)
        bits = int(np.bitwise_count((minhash.bitmap(x) ^ minhash.bitmap(y)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(x, y))
        assert len(minhash.bitmap(x)) == minhash._BITS // 64


def test_bands_for():
    assert minhash.bands_for(85) == 24 and minhash.bands_for(80) > 24


def test_repeated_rows_keep_the_same_one(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "a", 1), (1, text, "de", "b", 2), (1, text, "fr", "c", 3), (2, "other words entirely", "en", "a", 1)]
    kept = {tuple(minhash.keep_one_of_each(table(spark, rows[i:] + rows[:i])).filter(F.col("doc_id") == 1).first()) for i in range(3)}
    assert len(kept) == 1
