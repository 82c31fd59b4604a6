from collections import Counter

import brute
import corpus_pipeline
import pytest

import __spark_entry__ as entry
from panelcast.llm import quality
from panelcast.session import scratch_path


def through(spark, docs, sf_dir):
    """The output of every stage, written and read as the pipeline does."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_on_the_table(spark, documents, small):
    toxic, good, single, mixed, packed = through(spark, documents, small)
    assert all(x.columns == documents.columns for x in (toxic, good, single, mixed))
    assert toxic.join(documents, documents.columns, "left_semi").count() == toxic.count() < documents.count()
    base = {r["doc_id"] for r in toxic.collect() if (c := brute.quality_counts(r["text"]))[0] >= 10 and 100 * c[4] <= 20 * c[0]}
    kept = {r["doc_id"] for r in good.collect()}
    assert kept <= base and len(kept) > 0.97 * len(base)
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert {r["doc_id"] for r in single.collect()} == {i for i, _, c in brute.near_duplicates(rows) if i == c}
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, single.collect()))
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in single.collect()}


def test_stages_on_odd_rows_and_empty_tables(spark, edge, tmp_path, labels):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    last = through(spark, edge, str(tmp_path))
    assert last[0].count() == edge.count() and Counter(r["doc_id"] for r in last[2].collect())[1] == 1
    assert all(x.columns == edge.columns for x in last[:-1])
    assert [x.count() for x in through(spark, edge.limit(0), str(tmp_path))] == [0] * 5


def test_run_is_the_stages(spark, small, documents):
    got = Counter(tuple(r)[0:3] for r in corpus_pipeline.run(spark, small).collect())
    want = Counter(tuple(r)[0:3] for r in through(spark, documents, small)[-1].collect())
    assert sum(n for (_, _, n), c in got.items() for _ in range(c)) == sum(n for (_, _, n), c in want.items() for _ in range(c))


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert quality.GRID.keys() == quality.rule_values().keys()
