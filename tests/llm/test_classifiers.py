"""Quality and toxicity by held-out accuracy, and the pipeline over a small table."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridsmith.llm import quality, toxicity
from gridsmith.llm.common import labelled_sample
from gridsmith.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_quality_on_held_out_rows(spark, tables):
    rows = QUERIES["op3_quality_classifier"](spark, FOLDER).join(tables[1], "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_toxicity_on_held_out_rows(spark):
    # The larger table: the smaller one has too few toxic rows to learn from.
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = QUERIES["op6_toxicity"](spark, folder).join(labels, "doc_id").join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.lang == "en"]
    toxic = [r.predicted for r in held if r.toxic]
    assert np.mean(toxic) > 0.8 and np.mean([r.predicted for r in held if not r.toxic]) < 0.05


def test_a_pair_of_terms_says_what_neither_does():
    draw = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(1500):
        a, b = draw.random(2) < 0.5
        rows.append(toxicity.text_terms(" ".join([f"n{draw.integers(40)}", *["insult"] * int(a), *["group"] * int(b)])))
        y.append(float(a == b))
    model = toxicity.fit(rows, np.array(y), np.ones(len(y)))
    both, insult, group, neither = toxicity.Scorer(model).score(["insult group", "insult", "group", "n7"])
    assert min(both, neither) > 0.6 and max(insult, group) < 0.4


def test_additive_model_learns_a_pair():
    draw = np.random.default_rng(0)
    x = draw.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, np.ones(len(y)))
    assert (0, 1) in model.pairs and ((model.score(x) >= 0.5) == y).mean() > 0.95
    flat = quality.fit(x, np.ones(len(y)), np.ones(len(y)))
    assert (flat.score(x) > 0.9).all()


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_edges(spark, module, label):
    texts = [None, "", " ", "x" * 200_000, "word " * 30_000, "ok text", "ok text"]
    docs = spark.createDataFrame([(i if i else None, t, 9.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 1), (3, 5), (77, 0)], f"doc_id long, {label} int")
    for known in (labels, labels.limit(0)):
        model = module.train(docs, known)
        rows = module.score_documents(docs, model).collect()
        assert len(rows) == len(texts) and all(0 <= r.score <= 1 and not math.isnan(r.score) for r in rows)
        assert module.score_documents(docs.limit(0), model).count() == 0


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, folder).cache()
        assert kept.columns == docs.columns, name
        assert kept.count() <= before.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "toxicity", "ngram_jaccard_join", "pii", "best_fit_packing"]
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in kept.collect()}
    assert kept.where(F.col("text").contains("@mail")).count() == 0


def test_registered():
    assert sorted(QUERIES) == sorted([*[n for n in QUERIES if n.startswith("op")], "pipeline"])
    assert {int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline"} == set(range(1, 14))
    assert set(SQL) <= set(QUERIES)


def test_the_sample_is_drawn_from_labels_of_the_documents(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(0, 0), (None, 1), (401, None), (402, 7)], "doc_id long, quality int")
    docs = spark.range(20).withColumnRenamed("id", "doc_id")
    keep = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = labelled_sample(labels, docs.union(docs), "doc_id", "quality", 3, 1, 50).collect()
    assert sorted((r.key, r.label, r.weight) for r in rows) == [(i, i % 2, 1.0) for i in keep]
    few = labelled_sample(labels, docs, "doc_id", "quality", 3, 1, 2).collect()
    assert {r.key for r in few} < set(keep) and all(r.weight > 1 for r in few)
    assert labelled_sample(labels, docs.limit(0), "doc_id", "quality", 3, 1, 2).count() == 0
