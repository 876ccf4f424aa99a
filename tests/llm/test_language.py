"""Language identification: held-out accuracy, mixtures, awkward rows."""

import os

import pytest
from awkward import frame, texts
from pyspark.sql import functions as F

from lectern.llm.language import mixture, predict, train, trigrams
from lectern.llm.language_queries import op8_language_id

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="supplied tables not present")
def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang", "text")
    got = op8_language_id(spark, SF_DIR).join(truth, "doc_id")
    share = got.groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"),
                                        F.count(F.lit(1)).alias("n")).collect()
    by = {r["held_out"]: r for r in share}
    assert by[True]["n"] > 100 and by[True]["right"] >= 0.99
    assert sum(r["n"] for r in share) == truth.count()
    assert got.where("score < 0 OR score > 1").isEmpty()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="supplied tables not present")
def test_mixture_of_two_languages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names, table = train(docs)
    sample = {r["lang"]: r["text"][:1500] for r in docs.where("length(text) BETWEEN 2000 AND 4000 AND lang IN ('en', 'fr')")
              .orderBy("doc_id").collect()}
    shares = mixture(trigrams(sample["en"] + "\n" + sample["fr"]), table)
    found = {names[i]: p for i, p in shares.items()}
    assert set(found) >= {"en", "fr"} and abs(found["en"] - 0.5) < 0.15 and abs(sum(found.values()) - 1) < 1e-6


def test_trigrams():
    assert trigrams(None) is None and trigrams("") is None and trigrams("12 -- 3 \n") is None
    assert len(trigrams("a")) == 1 and len(trigrams("ab c")) == 4
    assert trigrams("Ab, c!").tolist() == trigrams("  ab 7 C").tolist()
    assert len(trigrams("x " * 100_000)) == 199_999


def test_awkward_rows(spark):
    docs = frame(spark)
    got = predict(docs, train(docs), carry=["doc_id", "text", "label"]).select("_carry.*", "lang_pred", "score").collect()
    assert len(got) == len(texts()) and {r["label"] for r in got} == {"label"}
    for r in got:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= r["score"] <= 1
    empty = frame(spark, [])
    assert predict(empty, train(empty)).count() == 0
    assert {r["lang_pred"] for r in predict(docs, train(empty)).collect()} == {"und"}
