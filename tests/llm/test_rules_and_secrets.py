"""Quality rules, URL rules, secrets and vectors against plain versions."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from linkspark.llm import quality_rules as Q
from linkspark.llm import secrets as S
from linkspark.llm import url_rules as U
from linkspark.llm import vector_search as V

from .conftest import DOCS, SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def text_stats(t):
    t = t or ""
    w, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_text_stats(spark, docs, odd):
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(["a b c a b c", "x\ny\nx\n x\nx\n\n", "line\r\nline\r\nline", "#*$%&|<> ü", "a a a a", "日本 語\n日本 語"])], DOCS)
    for df in (docs.select("doc_id", "text"), odd.select("doc_id", "text"), extra):
        want = {r.doc_id: text_stats(r.text) for r in df.collect()}
        assert {r.doc_id: tuple(r[n] for n in Q.STATS) for r in Q.text_stats(df).collect()} == want


def test_binomial_bound():
    p = Q.binomial_upper(3, 100, 0.05)
    from math import comb

    assert abs(sum(comb(100, k) * p**k * (1 - p) ** (100 - k) for k in range(4)) - 0.05) < 1e-6
    assert Q.binomial_upper(5, 5, 0.05) == 1.0


STATISTICS = "doc_id long, " + ", ".join(f"{n} long" for n in (*Q.STATS, *Q.EXTRA))


def labelled(spark, n, seed=2):
    """Good documents with few symbols, one in a hundred with some, and bad ones with many; two lengths."""
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        bad, words = i % 5 == 0, 150 if i % 2 else 400
        symbols = r.integers(20, 60) if bad else r.integers(0, 8) if i % 97 else 30
        rows.append((i, words, 700 + i, int(symbols * words // 100), 0, 0, 10, 0, 0))
    return spark.createDataFrame(rows, STATISTICS), spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(n)], "doc_id long, quality int")


def test_cutoffs_keep_good_documents(spark):
    stats, labels = labelled(spark, 4000)
    moves, taken = Q.choose(stats, labels, 0.05, 0.05, 0.8)
    assert set(taken) == {0, 1} and all(k > 0 for k in taken.values())
    judged = Q.judge(stats, moves, taken).join(labels, "doc_id")
    for s in (0, 1):  # the promise, stratum by stratum, over all rules
        own = judged.where(Q.stratum() == s).where("quality = 1")
        assert own.where("not kept").count() <= 0.05 * own.count()
    assert judged.where("quality = 0 and kept").count() <= 0.1 * judged.where("quality = 0").count()
    assert Q.choose(*labelled(spark, 100), 0.05, 0.05, 0.8)[1] == {}  # too few to prove anything
    assert Q.choose(stats, labels.where("quality = 1"), 0.05, 0.05, 0.8) == ([], {})


def test_choice_against_a_plain_version(spark):
    """kept, by brute force over the same statistics and moves."""
    stats, labels = labelled(spark, 1500, 7)
    moves, taken = Q.choose(stats, labels, 0.05, 0.05, 0.8)
    rows, quality = stats.collect(), {r.doc_id: r.quality for r in labels.collect()}
    value = {"symbols_per_word": lambda r: 1000 * r.n_symbols // r.n_words, "upper_share": lambda r: 1000 * r.n_upper // r.word_chars, "word_length": lambda r: 100 * r.word_chars // r.n_words}
    names = list(Q.RULES)

    def rejects(r, k):
        return any(value.get(names[rule], lambda r: 0)(r) > Q.GRID[i] for rule, i in moves[:k])

    for s in (0, 1):
        good = [r for r in rows if quality[r.doc_id] and (r.n_words >= 200) == s]
        count = lambda k, good=good: sum(rejects(r, k) for r in good)
        want = next((k - 1 for k in range(1, len(moves) + 1) if Q.binomial_upper(count(k), len(good), 0.025) > 0.05), len(moves))
        assert taken[s] == want
    kept = {r.doc_id: r.kept for r in Q.judge(stats, moves, taken).collect()}
    assert kept == {r.doc_id: not rejects(r, taken[int(r.n_words >= 200)]) for r in rows}


def test_a_value_at_the_cutoff_passes_and_tables_may_be_empty(spark):
    row = lambda i, symbols: (i, 1000, 5000, symbols, 0, 0, 0, 0, 0)
    at = Q.GRID.index(50)
    stats = spark.createDataFrame([row(1, 50), row(2, 51), row(2, 51)], STATISTICS)
    judged = Q.judge(stats, [(0, at)], {2: 1})
    assert sorted((r.doc_id, r.kept) for r in judged.collect()) == [(1, True), (2, False), (2, False)]
    assert Q.judge(stats.limit(0), [(0, at)], {2: 1}).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.apply_rules(spark.createDataFrame([], DOCS + ", s int, quality int"), none).count() == 0


def test_copies_of_a_good_document_count_once(spark):
    """Where the bound would be met only by counting copies, nothing is proven."""
    stats, labels = labelled(spark, 120)
    copies = stats
    for k in range(1, 30):
        copies = copies.unionByName(stats.withColumn("doc_id", F.col("doc_id") + 1000 * k))
    more = copies.select("doc_id").withColumn("quality", (F.col("doc_id") % 1000 % 5 > 0).cast("int"))
    assert Q.choose(copies, more, 0.05, 0.05, 0.8)[1] == {}


def test_rules_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = Q.apply_rules(odd, none).collect()
    assert len(got) == odd.count() and all(r.kept == (not r.base_failed) for r in got)


def test_url_rules(spark):
    urls = [None, "", "x", "http://", "HTTP://A.Org", "http://org/", "http://sub.example.ORG/es/1?x", "http://example.org/en/1", "http://xexample.org/es/", "http://a.com/fr/#y", "http://com/de/", "a://b://c/d", "http://example.org:80/es/", "x\n://example.org/es/", "http://.org/a", "http://org./a", "http://a\u0001.com/de/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(U.RULES, "host string, path string, verdict string")
    got = U.judge_urls(pages, rules)
    con = duckdb.connect()
    frame = pages.toPandas()
    con.register("pages", frame)
    want = sorted(con.execute(U.ORACLE).fetchall(), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert U.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in U.judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}
    nested = spark.createDataFrame([("a.b.c", "/", "block"), ("b.c", "/", "allow"), ("c", "/x", "block"), ("c", "/x", "allow")], "host string, path string, verdict string")
    asked = spark.createDataFrame([(1, "h://z.a.b.c/q"), (2, "h://b.c/x"), (3, "h://d.c/xy"), (4, "h://d.c/q"), (5, "h://ab.c/x")], "page_id long, url string")
    assert {r.page_id: r.rule for r in U.judge_urls(asked, nested).collect()} == {1: "a.b.c/", 2: "b.c/", 3: "c/x", 4: None, 5: "c/x"}


def judged_plainly(url):
    """(host, path, rule, verdict) by string methods alone."""
    _, mark, rest = (url or "").partition("://")
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]) if mark else ""
    path = rest[end:] if mark else ""
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits, key=lambda r: len(r[0]), default=(None, "allow")))


def test_urls_that_hold_urls(spark):
    """Against a plain parser: a second :// in path, query, fragment and straight after the host."""
    urls = [f"{s}://{h}{p}{q}" for s in ("http", "HTTPS", "") for h in ("example.org", "Sub.Example.ORG", "a.com", "net", "") for p in ("", "/", "/es/x", "/en/12", "/de/", "/a://b/es/") for q in ("", "?u=http://x.com/es/a", "#http://z/de/q", "?a#b?c", "#a?b")]
    urls += [None, "", "://", "a:/b", "http:/x://example.org/es/", "?x=http://example.org/es/y", "http://example.org\n/es/"]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, lane int")
    rules = spark.createDataFrame(U.RULES, "host string, path string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in U.judge_urls(pages, rules).collect()}
    assert got == {i: judged_plainly(u) for i, u in enumerate(urls)}
    con = duckdb.connect()
    frame = pages.toPandas()
    con.register("pages", frame)
    assert {r[0]: r[1:] for r in con.execute(U.ORACLE).fetchall()} == got


def secret_spans(t):
    found = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A) if len(m.group(1)) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
    return sorted(found, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


def test_secret_patterns(spark, docs):
    texts = ["secret: \"token: abcdefg", "PassWord='abcdef", "apikey=a.b.c-d", "toKen = short", "AKIA" + "A" * 20, "ſecret=abcdefgh", "x" + "0" * 24 + "g", "é password=" + "f" * 30]
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], DOCS)
    df = docs.select("doc_id", "text").unionByName(extra)
    want = {r.doc_id: secret_spans(r.text or "") for r in df.collect()}
    for r in S.scan(df, None).collect():
        own = S.joined(want[r.doc_id])
        assert r.spans == own and r.base_sha256 == hashlib.sha256(own.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in want[r.doc_id]) for x in ("assign", "access", "hex"))


def test_network_adds_findings_and_leaves_words(spark):
    r = np.random.default_rng(4)
    hexes = lambda n: "".join(r.choice(list("0123456789abcdef"), n))
    words = lambda n: " ".join("".join(r.choice(list("etaoinshr"), r.integers(2, 8))) for _ in range(n))
    texts = [f"{words(20)} password={hexes(18)} {words(20)}" for _ in range(200)] + [f"{words(20)} +1 (663) 555-6869 item-2024-05 {words(20)}" for _ in range(200)]
    net = S.train(spark.createDataFrame(list(enumerate(texts * 20)), DOCS))
    assert net is not None
    planted = [f"{words(12)} passcode={hexes(18)} {words(9)}" for _ in range(40)]
    plain = [f"{words(12)} 192.168.14.22 on 2024-05-17 {words(9)}" for _ in range(40)]
    hits = lambda ts: sum(any(k == "network" for k, _, _ in spans) for _, spans in S.find(ts, net))
    assert hits(planted) >= 30 and hits(plain) <= 2


def test_training_takes_the_smallest_hashes(spark):
    texts = [f"password=abcdef{i}" for i in range(30)] + [f"clean text {i}" for i in range(50)] + ["clean text 7"] * 20 + ["clean " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).select("text", F.xxhash64("text").alias("h"))
    clean = df.where(~S.likely())
    assert S.smallest(clean, 25) == sorted({r.h for r in clean.collect()})[:25] and clean.select("h").distinct().count() == 51


def test_windows_cover_long_values():
    text = "x = " + "".join(chr(97 + i % 26) for i in range(205)) + " end"
    got = S.windows(text, 4, 209)
    seen = b"".join(bytes(w[S.SIDE : S.SIDE + S.VALUE]) for w in got)
    assert len(got) == 8 and bytes(got[0][S.SIDE : S.SIDE + S.VALUE]).decode() == text[4:52] and bytes(got[-1][S.SIDE : S.SIDE + S.VALUE]).decode() == text[161:209]
    assert set(seen.decode()) == set(text[4:209]) and S.candidates(text, []) == [(4, 209)]


def test_candidates():
    text = "pass: hunterhunter, id abc12345, abc123 and 4135104468711155 Note: ok key='Zx-9_y+/=='"
    assert [text[a:b] for a, b in S.candidates(text, [])] == ["hunterhunter", "abc12345", "Zx-9_y+/=="]
    assert S.candidates(text, [("assign", 0, len(text))]) == []


def test_threshold_keeps_recall():
    """Even where findings and others cannot be told apart."""
    r = np.random.default_rng(1)
    x = r.integers(97, 123, (400, S.WIDTH)).astype(np.uint8)
    y = (np.arange(400) % 2).astype(float)
    net = S.CharNet().fit(x, y, 0.95, steps=30)
    held = np.random.default_rng(11).permutation(400)[300:]
    score = net.score(x[held][y[held] > 0])
    assert (score >= net.threshold).mean() >= 0.95


def test_network_spans_in_long_texts_and_further_columns(spark):
    r = np.random.default_rng(5)
    hexes = lambda n: "".join(r.choice(list("0123456789abcdef"), n))
    words = lambda n: " ".join("".join(r.choice(list("etaoinshr"), r.integers(2, 8))) for _ in range(n))
    texts = [f"{words(20)} password={hexes(18)} {words(20)}" for _ in range(120)] + [f"{words(20)} item-2024-05 {words(20)}" for _ in range(120)]
    net = S.train(spark.createDataFrame(list(enumerate(texts)), DOCS))
    long = words(30_000)
    text = f"{long} passcode={hexes(20)} {long}"
    df = spark.createDataFrame([(1, text, "a", 2), (1, text, "b", 3), (None, None, "c", 4)], "doc_id long, text string, spans string, h int")
    rows = S.scan(df, net).collect()
    assert [r.doc_id for r in rows] == [1, 1, None] and rows[0].spans == rows[1].spans
    at = len(long) + len(" passcode=")
    assert f"network:{at}:{at + 20}" in rows[0].spans.split(",")
    kept = S.redact(df, net)
    assert kept.columns == df.columns and kept.where("doc_id = 1").first().text.count("[secret]") >= 1


def test_redaction(spark, odd):
    df = spark.createDataFrame([(1, "a password=abcdef0123 b", 23), (2, None, 0)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in S.redact(df, None).orderBy("doc_id").collect()] == [(1, "a [secret] b", 12), (2, None, None)]
    assert S.redact(odd, None).count() == odd.count() and S.scan(odd.limit(0), None).count() == 0


def exact(x, ids, q, k):
    v = x[ids == q][0]
    d = np.sqrt(((x - v) ** 2).sum(1))
    m = ids != q
    o = np.lexsort((ids[m], d[m]))[:k]
    return list(zip(ids[m][o].tolist(), d[m][o].tolist(), strict=True))


@pytest.mark.parametrize("folder, shard_size", [(SMALL, 2048), ("/root/testdata/sf0.1", 2048), ("/root/testdata/sf0.1", 250)])
def test_vector_search(spark, folder, shard_size):
    """Recall against brute force, with one shard and with several whose results are merged."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    got = V.nearest(vectors, vectors.where("vec_id % 100 = 0"), shard_size=shard_size).collect()
    e = vectors.toPandas()
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        want = exact(x, ids, q, 10)
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert [s for _, _, s in own] == sorted(s for _, _, s in own)
        hit += len({v for _, v, _ in own} & {v for v, _ in want})
        total += 10
    print("recall", folder, shard_size, hit / total)
    assert hit / total >= 0.95


def test_equal_distances_go_to_smaller_ids(spark):
    """Thirty vectors at one distance of the query, in several shards; further columns do not matter."""
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [1.0, float(np.cos(i)), float(np.sin(i))]) for i in range(1, 31)]
    df = spark.createDataFrame([(i, v, i, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, shard long, lane int, dim string")
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    want = exact(x, ids, 0, 10)
    for size in (100, 8):
        got = sorted((r.rank, r.vec_id, r.score) for r in V.nearest(df, df.where("vec_id = 0"), shard_size=size).collect())
        assert [(v, s) for _, v, s in got] == want


def test_vector_copies_and_bad_rows(spark):
    r = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(60)] + [(60 + i, r.normal(size=3).tolist()) for i in range(40)]
    rows += [(200, None), (201, [0.0, 0.0, 0.0]), (202, [float("nan"), 1.0, 1.0]), (203, [None, 1.0, 1.0]), (204, []), (205, [1.0, 2.0]), (300, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = V.nearest(df, df.where("vec_id in (0, 5, 205, 201)")).collect()
    for q in (0, 5):
        assert sorted((x.rank, x.vec_id) for x in got if x.query_id == q) == [(i + 1, v) for i, v in enumerate([v for v in range(12) if v != q][:10])]
    assert {x.query_id for x in got} == {0, 5}
    assert V.nearest(df.limit(0), df.limit(0)).count() == 0
