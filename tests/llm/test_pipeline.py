"""The pipeline's stages against plain versions of their decisions."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from linkspark.llm import quality_model, secrets, toxicity
from linkspark.llm.scratch import stash

from .conftest import SMALL
from .test_ngram_join import plain
from .test_tokens import check_packed

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def through(spark, df):
    out = [("documents", df)]
    for name, stage in C.STAGES:
        df = stash(stage(spark, df, SMALL), name)
        out.append((name, df))
    return dict(out)


@pytest.fixture(scope="module")
def steps(spark):
    return through(spark, spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_columns_and_decisions(spark, steps):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    names = list(steps)
    for name in names[:-1]:
        assert steps[name].columns == steps["documents"].columns
    ids = {n: {r.doc_id for r in steps[n].select("doc_id").collect()} for n in names}
    for before, after, module in (("documents", "quality", quality_model), ("quality", "toxicity", toxicity)):
        scores = {r.doc_id: r.score for r in module.score(steps[before], module.train(steps[before], labels)).collect()}
        keep = (lambda s: s >= 0.7) if module is quality_model else (lambda s: s < 0.7)
        assert ids[after] == {i for i, s in scores.items() if keep(s)}
    groups = plain([(r.doc_id, r.text) for r in steps["toxicity"].collect()])
    assert ids["near_copies"] == {i for i, (_, c) in groups.items() if i == c}
    assert ids["secrets"] == ids["near_copies"] == ids["packing"]


def test_texts_and_sequences(steps):
    """Every text of the last stages by a plain version: findings replaced, tokens packed once and in order."""
    rows = steps["near_copies"].collect()
    net = secrets.train(steps["near_copies"])
    want = {}
    for r in rows:
        text, end = [], 0
        for _, a, b in secrets.find([r.text or ""], net)[0][1]:
            if a >= end:
                text += [(r.text or "")[end:a], "[secret]"]
            end = max(end, b)
        want[r.doc_id] = "".join(text) + (r.text or "")[end:]
    kept = {r.doc_id: r for r in steps["secrets"].collect()}
    assert {i: r.text for i, r in kept.items()} == want and all(r.n_chars == len(r.text) for r in kept.values())
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array(t.encode(x, add_special_tokens=False).ids + [1], "<u4") for i, x in want.items()}
    check_packed(steps["packing"].collect(), ids)


def test_run_is_its_stages(spark, steps):
    n = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in df.collect())
    one, two = ({(d, k) for d, *_, k in n(df)} for df in (C.run(spark, SMALL), steps["packing"]))
    assert one == two


def test_odd_rows_go_through(spark):
    """Null ids and texts, empty and blank texts, repeated rows, a very long text, and columns of helpers' names."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = {r.doc_id: r.text for r in docs.join(spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1 and toxic = 0"), "doc_id").limit(3).collect()}
    a, b, c = good.values()
    rows = [(900_001, a), (None, b), (None, b), (None, c + " and more words of another text"), (900_001, c), (900_002, a), (None, None), (900_003, None), (900_004, ""), (900_005, " \n"), (900_006, (b + "\n") * 300), (900_007, "password = hunter2hunter2 " + a)]
    odd = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCUMENTS)
    more = docs.unionByName(odd).selectExpr("*", "1 as y", "0.5D as score", "0.1D as _score", "true as _keep", "7L as key", "8 as _key", "'x' as spans")
    steps = through(spark, more)
    for name in list(steps)[:-1]:
        assert steps[name].columns == more.columns
        assert steps[name].where("y <> 1 or score <> 0.5 or _score <> 0.1 or not _keep or key <> 7 or _key <> 8 or spans <> 'x'").count() == 0
    before = [(r.doc_id, r.text) for r in steps["toxicity"].collect()]
    after = [(r.doc_id, r.text) for r in steps["near_copies"].collect()]
    # Rows as nodes of their own: equal rows link, rows with a null id come last among their group.
    numbered = sorted(set(before), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    groups = plain(list(enumerate(t for _, t in numbered)))
    want = [numbered[i] for i, (n, least) in groups.items() if i == least and (n or numbered[i][0] is not None)]
    want += [r for r in before if r[0] is None and not (r[1] or "").strip(" \t\n\x0b\x0c\r")]
    assert sorted(map(str, after)) == sorted(map(str, want))
    assert len(after) == steps["secrets"].count()


def test_empty_table(spark):
    steps = through(spark, spark.read.parquet(f"{SMALL}/documents.parquet").limit(0))
    assert all(df.count() == 0 for df in steps.values())


def test_repeated_rows_keep_one(spark):
    df = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 13)] * 2 + [(2, "a b c d e f g", "en", "s", 13), (3, "z", "en", "s", 1)], DOCUMENTS)
    assert sorted(r.doc_id for r in C.one_of_each(spark, df, SMALL).collect()) == [1, 3]


def test_repeated_and_null_ids_keep_every_group(spark):
    """A text stays if it is its group's first, whatever other texts have its doc_id."""
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(1, base), (7, base + " 1"), (7, "one text of seven"), (7, "another text of seven"), (7, "another text of seven")]
    rows += [(None, "no id one"), (None, "no id two"), (None, "no id two"), (None, None), (None, ""), (None, " "), (8, ""), (8, " "), (8, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCUMENTS)
    got = C.one_of_each(spark, df, SMALL)
    assert got.columns == df.columns
    want = [(1, base), (7, "one text of seven"), (7, "another text of seven"), (None, "no id one"), (None, "no id two"), (None, None), (None, ""), (None, " "), (8, ""), (8, " ")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_scores_do_not_touch_further_columns(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.with_score(df, toxicity.train(df, none), "_score").select(F.col("score")).first()[0] == 2.0
