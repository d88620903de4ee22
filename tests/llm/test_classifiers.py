"""Held-out accuracy of the trained operators, and defined scores where nothing can be learned."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkspark.llm import quality_model as Q
from linkspark.llm import toxicity as T
from linkspark.llm.labelled import held_out
from linkspark.llm.textvec import blocks

MIDDLE = "/root/testdata/sf0.1"


@pytest.mark.parametrize("module, label, recall, wrong", [(Q, "quality", 0.98, 0.1), (T, "toxic", 0.68, 0.02)])
def test_held_out(spark, module, label, recall, wrong):
    """On labels that were never learned from: rows of label 1 found, and of label 0 taken for them."""
    got = module.query(spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").where("held_out").toPandas()
    ones, zeros = got[got[label] == 1].predicted, got[got[label] == 0].predicted
    print(label, int(ones.sum()), len(ones), int(zeros.sum()), len(zeros))
    assert ones.mean() >= recall and zeros.mean() <= wrong
    assert got.score.between(0, 1).all()


def test_clashing_columns(spark, docs, labels):
    """Whatever further columns the documents have, the scores are the same."""
    more = docs.selectExpr("*", "1 as y", "2 as score", "3 as row", "4 as terms", "5 as quality", "6 as toxic")
    for module in (Q, T):
        want = {r.doc_id: r.score for r in module.score(docs, module.train(docs, labels)).collect()}
        got = {r.doc_id: r.score for r in module.score(more, module.train(more, labels)).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_classifier_learns_from_the_corpus(spark):
    """Documents that no label names move the weights: a term that only they hold with others is learned."""
    r = np.random.default_rng(3)
    some = lambda: " ".join("".join(r.choice(list("etaoinsr"), 6)) for _ in range(12))
    texts = [f"{some()} plain" for _ in range(300)] + [f"vile {some()} awful" for _ in range(40)] + [f"vile {some()} nasty" for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    few = spark.createDataFrame([(i, int(i >= 300)) for i in range(340)], "doc_id long, toxic int")
    few = few.unionByName(spark.createDataFrame([(i, 1) for i in range(340, 352)], few.schema))
    got = {r.doc_id: r.score for r in T.score(df, T.train(df, few)).collect()}
    assert min(got[i] for i in range(352, 540)) >= 0.7 and max(got[i] for i in range(300)) < 0.7


def test_near_copies_count_once():
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 62, (5, 32)).astype(np.uint64)
    copies = np.repeat(base, 4, axis=0)
    copies[::2, 30:] = r.integers(0, 1 << 62, (10, 2))
    assert T.distinct_sample(copies).tolist() == [0, 4, 8, 12, 16]


@pytest.mark.parametrize("module, label", [(Q, "quality"), (T, "toxic")])
def test_odd_texts_and_no_labels(spark, odd, module, label):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = module.train(odd, none)
    got = module.score(odd, model).collect()
    assert len(got) == odd.count() and all(r.score == 0.5 for r in got)
    assert module.score(odd.limit(0), model).count() == 0
    assert module.with_score(odd, model, "_s").columns == ["doc_id", "text", "score", "_s"]


def test_split(spark):
    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("h"))
    from zlib import crc32

    assert all(r.h == (r.doc_id is None or crc32(str(r.doc_id).encode()) % 3 == 1) for r in df.collect())


def test_attention_gradient():
    r = np.random.default_rng(1)
    m = Q.Attention(hidden=4, gate=3)
    x, borders, y = r.normal(size=(7, Q.N_FEATURES)), np.array([0, 2, 3, 7]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(Q.sigmoid(m.forward(x, borders)[-1])) + (1 - y) * np.log(1 - Q.sigmoid(m.forward(x, borders)[-1])))
    grad = m.gradient(x, borders, y, np.ones(3))
    for k in m.p:
        i = tuple(0 for _ in m.p[k].shape)
        keep = m.p[k][i]
        m.p[k][i] = keep + 1e-5
        up = loss()
        m.p[k][i] = keep - 1e-5
        assert abs((up - loss()) / 2e-5 - grad[k][i]) < 1e-4
        m.p[k][i] = keep


def test_passages_cover_every_word():
    (block,) = blocks(pa.array(["a " * 200, "", "b"]))
    borders, x = Q.passages(block)
    assert borders.tolist() == [0, 4, 5, 6] and np.allclose(np.expm1(x[:, Q.N_CLASS + 5] * 4), [64, 64, 64, 8, 0, 1], atol=1e-3)
