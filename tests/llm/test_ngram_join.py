"""The shingle join against all pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from linkspark.llm import ngram_join as N
from linkspark.llm.components import components

from .conftest import DOCS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    """doc_id -> (set size, smallest doc_id reachable), from an inverted index over all shingles."""
    sets, inverted = {}, defaultdict(list)
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    for i, s in sets.items():
        for g in s:
            inverted[g].append(i)
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in inverted[g] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def run(df, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df, **options).collect()}


def varied(seed, groups, sizes, copies, changes, words=40):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    out = []
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.choice(sizes))]
        for _ in range(r.randint(1, copies)):
            x = list(base)
            for _ in range(r.choice(changes)):
                if x:
                    x[r.randrange(len(x))] = r.choice(vocabulary)
            out.append(" ".join(x))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_small_and_large_sets(spark, seed):
    rows = list(enumerate(varied(seed, 250, [1, 3, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 60, 120, 220, 400], 4, [0, 0, 1, 1, 2, 3, 6])))
    assert run(spark.createDataFrame(rows, DOCS)) == plain(rows)


def test_large_groups_and_a_common_passage(spark):
    """One group of many near copies, and many texts that share a passage: the large-bucket path."""
    r = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(50))
    texts = varied(6, 1, [90], 1, [0]) * 1
    base = texts[0].split()
    for _ in range(150):
        x = list(base)
        for _ in range(r.randint(0, 4)):
            x[r.randrange(len(x))] = f"n{r.randrange(999)}"
        texts.append(" ".join(x))
    texts += [" ".join([f"u{i}x{j}" for j in range(r.randint(2, 60))]) + " " + passage for i in range(150)]
    rows = list(enumerate(texts))
    assert run(spark.createDataFrame(rows, DOCS), pair_limit=3) == plain(rows)


def test_signatures_of_a_third_of_all_texts_are_dealt_by_document(spark, monkeypatch):
    """Groups of near copies of every size class, with the bound for frequent shingles lowered."""
    monkeypatch.setattr(N, "SPLIT_FROM", 8)
    monkeypatch.setattr(N, "SPLIT", 4)
    monkeypatch.setattr(N, "BLOCK", 20)
    r = random.Random(9)
    texts = []
    for size in (7, 8, 9, 12, 40, 150):
        base = [f"b{size}x{i}" for i in range(size)]
        for _ in range(60):
            x = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                x[r.choice([0, size - 1, r.randrange(size)])] = f"n{r.randrange(60)}"
            texts.append(" ".join(x))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, DOCS)
    assert run(df.repartition(7), pair_limit=3) == plain(rows)


def test_histograms_bound_the_difference():
    r = np.random.default_rng(1)
    universe = r.integers(0, 1 << 63, 9000, dtype=np.uint64) * np.uint64(2)
    for n in (1, 4, 30, 63, 64, 65, 500, 4000, 6000):
        a = np.sort(r.choice(universe, n, replace=False))
        b = np.unique(np.concatenate((r.choice(a, n * 4 // 5 + 1, replace=False), r.choice(universe, n // 5))))
        one, two = (N.sketches(np.array([0, len(x)]), x) for x in (a, b))
        assert N.gaps(one, two)[0] <= len(np.setxor1d(a, b)) and N.gaps(one, one)[0] == 0


def test_more_documents_to_verify_than_a_filter_takes(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOOM_MOST", 2)
    rows = list(enumerate(varied(4, 60, [8, 12, 30, 60], 4, [0, 1, 2, 3]))) + [(None, "a b c d e f g h i j k l m n o p")]
    df = spark.createDataFrame(rows, DOCS)
    assert {k: v for k, v in run(df).items() if k is not None} == plain(rows[:-1])


def test_tables_on_the_way_are_removed(spark, docs):
    import os

    got = N.near_duplicates(docs)
    root = N.Scratch(spark).root.removeprefix("file:")
    names = {f.split("-")[0] for _, folders, _ in os.walk(root) for f in folders}
    assert not names & {"candidates", "pairs", "buckets", "links", "members", "apart", "edges"}
    assert got.count() == docs.count()


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 5, 6, "x"), (2, "a b c d e f", 7, 8, "y")], "doc_id long, text string, cid long, key long, component string")
    assert run(df) == {1: (2, 1), 2: (2, 1)}


def test_driver_documents(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert run(docs) == plain(rows)


def test_odd_texts(odd):
    got = run(odd)
    assert got[0] == got[1][:0] + (0, 0) and got[1] == (0, 1) and got[5][1] == 4 and got[8][1] == 3
    assert N.near_duplicates(odd.limit(0)).count() == 0


def test_further_edges_join_components(spark, monkeypatch):
    from linkspark.llm import components as P

    work = N.Scratch(spark)
    frame = lambda e, names: spark.createDataFrame(e, f"{names[0]} long, {names[1]} long")
    for small in (P.SMALL, 0):
        monkeypatch.setattr(P, "SMALL", small)
        group = P.components(frame([(1, 2), (2, 3), (10, 11), (20, 21), (30, 31)], "uv"), work)
        got = {r.node: r.component for r in P.joined(group, frame([(11, 3), (50, 21), (60, 61), (2, 1)], "ab"), work).collect()}
        assert got == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 20: 20, 21: 20, 50: 20, 30: 30, 31: 30, 60: 60, 61: 60}


@pytest.mark.parametrize("small", [0, 10_000])
def test_components(spark, monkeypatch, small):
    from linkspark.llm import components as P

    monkeypatch.setattr(P, "SMALL", small)
    e = [(i, i + 1) for i in range(100, 140)] + [(5, 7), (7, 9), (9, 5), (50, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 5 for i in (5, 7, 9, 50)}


def test_a_null_id_bridges_two_documents(spark):
    words = [f"w{i}" for i in range(60)]
    late, both = words[:53] + [f"x{i}" for i in range(7)], [f"y{i}" for i in range(7)] + words[7:53] + [f"x{i}" for i in range(7)]
    df = spark.createDataFrame([(3, " ".join(words)), (None, " ".join(late)), (9, " ".join(both))], DOCS)
    assert run(df) == {3: (56, 3), None: (56, 3), 9: (56, 3)}
    assert run(df.where("doc_id is not null")) == {3: (56, 3), 9: (56, 9)}
