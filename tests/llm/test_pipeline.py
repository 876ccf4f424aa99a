"""The pipeline: each stage on what its predecessor kept, decisions in effect, the whole against its parts."""

import os

import pytest
from awkward import frame, texts
from test_contamination import brute as brute_contamination
from test_jaccard import brute as brute_components
from test_quality import plain

import corpus_pipeline as pipeline
from lectern.llm.jaccard import keep_representatives

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="supplied tables not present")
def test_stages_on_supplied_tables(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    names, columns = [name for name, _ in pipeline.STAGES], docs.columns
    assert names == ["quality rules", "near duplicates", "decontamination", "source mix", "shards"]
    held = [docs.collect()]
    for _, stage in pipeline.STAGES:
        docs = pipeline.materialize(stage(spark, docs, SF_DIR), "test-stage")
        held.append(docs.collect())
        assert docs.columns[:len(columns)] == columns
    raw, good, single, clean, mix, shards = held
    ids = [{r["doc_id"] for r in rows} for rows in held]
    assert ids[5] == ids[4] <= ids[3] <= ids[2] <= ids[1] <= ids[0]
    assert not any(plain(r["text"])[5] for r in good)
    groups = brute_components([(r["doc_id"], r["text"]) for r in good], width=5, percent=80)
    assert ids[2] == {component for _, _, component in groups} and len(single) == len(ids[2])
    hits = brute_contamination([(r["doc_id"], r["text"]) for r in single], items)
    assert ids[3] == {d for d, _, n_hit, _, _ in hits if n_hit == 0} and len(clean) == len(ids[3])
    copies = {}
    for r in mix:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert max(copies.values()) <= 3
    sizes = [sum(r["shard"] == s for r in shards) for s in range(8)]
    assert len(shards) == len(mix) and max(sizes) - min(sizes) <= 1
    whole = pipeline.run(spark, SF_DIR).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, shards))
    assert pipeline.ORACLE_SQL is None


def test_stages_on_awkward_rows(spark):
    docs = frame(spark)
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        assert out.columns[:len(docs.columns)] == docs.columns
        assert out.count() <= 3 * len(texts())
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0


def test_representatives(spark):
    rows = [(5, "a b c d e f", None, "s"), (3, "A b c d e f", None, "s"), (3, "A b c d e f", None, "s"), (None, "a b c d e f", None, "s"),
            (9, None, None, "s"), (9, None, None, "s"), (8, "", None, "s"), (None, "x y z", None, "s"), (None, "x y z", None, "s")]
    kept = keep_representatives(frame(spark, rows))
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert got == sorted([(3, "A b c d e f"), (9, None), (9, None), (8, ""), (None, "x y z")], key=repr)
    assert kept.columns == frame(spark, []).columns
