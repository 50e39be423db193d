"""The pipeline against its stages done by plain Python, and the SQL of the operators that have it."""

import corpus_pipeline
import pytest
from conftest import SF001
from fixtures_llm import near_components, odd, quality, rows, table
from oracle import compare, duck

import __spark_entry__ as entry
from starweave.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    assert compare(QUERIES[name](spark, SF001), duck(SF001), ORACLE[name]) > 0


def test_registered():
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "suffix_array", "secret_scans", "packing"]


def test_stages(spark):
    data = {r[0]: r[1] for r in rows()}
    docs = table(spark)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").persist()
        kept[name] = {r.doc_id: r.asDict() for r in docs.collect()}
        if name != "packing":
            assert docs.columns == table(spark).columns
            assert all(r["n_chars"] == len(r["text"]) for r in kept[name].values())
    good = {d for d, t in data.items() if (q := quality(t))[0] >= 50 and 2 * q[4] <= q[0]} - {19}
    assert set(kept["quality_rules"]) == good
    near = near_components([(d, data[d]) for d in good])
    assert set(kept["near_duplicates"]) == {d for d, r in near.items() if r[2]}
    assert "[SECRET]" in kept["secret_scans"][16]["text"] and "AKIA" not in kept["secret_scans"][16]["text"]
    assert set(kept["packing"]) == set(kept["secret_scans"])
    # of two texts that share a passage, the later one has lost it
    assert len(kept["suffix_array"][10]["text"]) < len(data[10]) / 2 and kept["suffix_array"][8]["text"] == data[8]


def test_stages_on_odd_and_empty_tables(spark):
    for docs in (odd(spark), table(spark, [])):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "").persist()
            assert out.columns == docs.columns and out.count() <= n
            docs = out
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0) == (n == 0)
