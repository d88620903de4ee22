"""Sources, candidate filter, selection, model artifact and traffic on small inputs."""

import json
import uuid
from pathlib import Path

from pyspark.sql import functions as F

from linkspark.functions import urls as U
from linkspark.operators import candidates as K
from linkspark.operators import selection as X
from linkspark.plans import training as P
from linkspark.sources import corpus as R
from linkspark.streaming import traffic as T

DUMP = "INSERT INTO `externallinks` VALUES (7,19211,'http://be.fci.www.','/nomenclatures.asp?lang=en&sel=0'),(8,1,'http://org.example.www.','/a\\'b');"


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_dump_lines(spark):
    got = R.externallinks_urls(lines(spark, DUMP, "-- comment (1,2,'x://a','b')")).collect()
    assert sorted(r.url for r in got) == ["http://www.example.org/a'b", "http://www.fci.be/nomenclatures.asp?lang=en&sel=0"]


def test_sql_escapes(spark):
    row = lines(spark, "a\\'b\\\\n\\nc\\q").select(R.unescape_sql(F.col("value"))).first()[0]
    assert row == "a'b\\n\ncq"


def test_cdxj_and_plain(spark, tmp_path):
    line = 'com,example)/ 20260101 {"status": "200", "url": "https:\\/\\/example.com\\/\\u2713"}'
    assert [r.url for r in R.cdxj_urls(lines(spark, line, "broken")).collect()] == ["https://example.com/✓"]
    (tmp_path / "cdx-00").write_text(line + "\n")
    (tmp_path / "cdx-01.tmp").write_text(line + "\n")
    assert R.read_corpus(spark, str(tmp_path), "cdxj").count() == 1
    assert [r.url for r in R.plain_urls(lines(spark, " http://a/ ", "")).collect()] == ["http://a/"]


def test_visit_order():
    assert R.binary_visit_order(8) == [4, 2, 1, 0, 3, 6, 5, 7]
    assert sorted(R.binary_visit_order(13)) == list(range(13))


def test_url_parts(spark):
    df = spark.createDataFrame([("http://www.example.com/a/b?c=d#frag",), ("x",), ("http://h?q#?z",)], "url string")
    got = [tuple(r.p) for r in df.select(U.url_parts(F.col("url")).alias("p")).collect()]
    assert got == [("http", "www.example.com", "/a/b", "c=d"), ("", "x", "", ""), ("http", "h", "", "q")]


def test_rejection_reasons(spark):
    want = {
        "example.com": "exact-domain",
        ".com/": None,
        "/a94a8fe5ccb19ba61c4c": "hash-like",
        "/%5Bfoo%5D%5Bbar%5D": "percent-blob",
        "/CreateIssueDetails!init.jspa": "over-specific-path",
        "/wp-content/": None,
        "": "low-signal-shape",
        "a" * 81: "too-long",
        "é/": "non-ascii",
        "ab": "no-savings",
        "abc": "low-signal-shape",
    }
    df = spark.createDataFrame([(c,) for c in want], "candidate string")
    assert {r.candidate: r.reason for r in K.judged(df).collect()} == want


def test_selection_prefers_the_longer_of_equal_cover(spark):
    pool = spark.createDataFrame([(".com", 10, 24, 240), (".com/", 10, 30, 300)], "candidate string, n long, saved_bits long, total_score long")
    held = spark.createDataFrame([("https://example.com/path",)] * 10, "url string")
    assert K.TOKEN_COST == 12
    g = X.Greedy([(".com/", 10, 18), (".com", 10, 12)], [(b"example.com/path", 1.0)] * 10, 0)
    chosen, faded = g.choose(5)
    assert [g.pool[k][0] for k, _ in chosen] == [".com/"] and [g.pool[k][0] for k, _, _ in faded] == [".com"]
    first = X.select_dictionary(pool, held, overhead=0).where("kind = 'selected'").orderBy("rank").first()
    assert first.candidate == ".com/"
    assert X.select_dictionary(pool.limit(0), held).count() == 0


def test_curated_entries_follow_the_first_sixteen(spark):
    pool = spark.createDataFrame([(f"c{i:02d}", 1, 1, 100 - i) for i in range(20)] + [("github.", 1, 1, 200)], "candidate string, n long, saved_bits long, total_score long")
    got = [r.candidate for r in P.merge_curated(pool).orderBy("rank").collect()]
    assert got[:16] == ["github."] + [f"c{i:02d}" for i in range(15)] and got[16] == "gitlab." and len(got) == 35


def test_model_and_report(spark, tmp_path):
    d = P.partition_budget(spark.createDataFrame([(f"c{i}", i + 1) for i in range(200)], "candidate string, rank long"), 48)
    P.write_model(d, str(tmp_path / "m"))
    back = P.read_model(spark, str(tmp_path / "m"))
    assert back.where("tier = 'primary'").count() == 11 and back.where("tier = 'extended'").count() == 128
    text = P.render_report({"seen": 3}, {"Schemes": (["value", "count"], [("https", 2), ("a`b", 1)])})
    assert P.read_section(text, "Schemes") == [("https", "2"), ("a`b", "1")]


def test_counters(spark, tmp_path):
    counts = spark.createDataFrame([("a", 3), ("b", 9)], "key string, value long")
    seeds = spark.createDataFrame([("a", 7), ("c", 1)], "key string, value long")
    assert {r.key: r.value for r in T.seeded(counts, seeds).collect()} == {"a": 7, "b": 9, "c": 1}
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    now, then = str(tmp_path / "now"), str(tmp_path / "then")
    assert T.read_counters(spark, now).count() == 0 and T.views_endpoint(spark, None, "a").first().views is None
    assert T.views_endpoint(spark, now, "a").first().views == 0
    sink = T.counter_sink(now, then)
    sink(counts.withColumn("updated_at", at), 0)
    news = spark.createDataFrame([("b", 10), ("b", 12), ("d", 1)], "key string, value long").withColumn("updated_at", at)
    for _ in (1, 2):  # a batch that comes again changes nothing
        sink(news, 1)
        assert {r.key: r.value for r in T.read_counters(spark, now).collect()} == {"a": 3, "b": 12, "d": 1}
    assert T.views_endpoint(spark, now, "b").first().views == 12
    assert sorted((r.batch, r.key, r.value) for r in spark.read.parquet(then).collect()) == [(0, "a", 3), (0, "b", 9), (1, "b", 12), (1, "d", 1)]


def test_routes(spark):
    from linkspark.functions import codec as C

    ok, old = C.encode("https://example.com/x").short_url, C.encode("https://example.com/x", "0").short_url
    rows = [(ok, "Mozilla", "redirect"), (ok, "Slackbot", "embed"), (old, "Mozilla", "app"), ("https://link.example/", "m", "asset"), ("https://link.example/1/A", "m", "error"), ("https://link.example/1/", "m", "asset")]
    df = spark.createDataFrame(rows, "u string, a string, want string")
    for r in df.select("want", T.route(F.col("u"), F.col("a")).alias("r")).collect():
        assert r.r.action == r.want


def test_stream_runs_to_its_end(spark, tmp_path, monkeypatch):
    from pyspark.sql.streaming.query import StreamingQuery

    spark.sql("SELECT '/a' AS path, timestamp'2026-01-01 10:00:00' AS ts FROM range(7)").write.parquet(str(tmp_path / "in"))
    wait = StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda self, timeout=None: wait(self) if timeout is None else False)
    events = spark.readStream.schema("path string, ts timestamp").parquet(str(tmp_path / "in"))
    name = f"waits_{uuid.uuid4().hex}"
    assert [(r.path, r.views) for r in T.stream_daily(events, name).collect()] == [("/a", 7)]
    empty = spark.createDataFrame([], "path string, ts timestamp")
    empty.write.parquet(str(tmp_path / "none"))
    none = spark.readStream.schema("path string, ts timestamp").parquet(str(tmp_path / "none"))
    assert T.stream_daily(none, f"none_{uuid.uuid4().hex}").count() == 0
    (state,) = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")).glob(f"{name}-*")
    assert (state / "commits").is_dir()


def test_selection_takes_the_smallest_hash_keys(spark):
    from linkspark.plans import catalog

    def key(row, m=(1 << 64) - 1):
        x = (row + 0x9E3779B97F4A7C15) & m
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
        return x ^ (x >> 31)

    d = "/root/testdata/sf0.001"
    held = [(r.url, r.page_id + 1) for r in catalog.pages(spark, d).collect() if (r.page_id + 1) % 10 == 0]
    least = sorted(held, key=lambda x: key(x[1]))[:3]
    assert len(least) < len(held)
    pool = catalog.pool(spark, d)
    for name, kind in (("select_dictionary", "selected"), ("shadowed_tokens", "shadowed")):
        want = {(r.rank, r.candidate) for r in X.select_dictionary(pool, spark.createDataFrame(least, "url string, row_no long")).where(f"kind = '{kind}'").collect()}
        assert {(r.rank, r.candidate) for r in getattr(catalog, name)(spark, d, bodies=3).collect()} == want


def test_numbers_are_gapless_over_partitions_and_files(spark, tmp_path):
    for i, n in enumerate((3, 0, 5, 2)):
        (tmp_path / f"part-{i}").write_text("".join(f"{i}:{j}\n" for j in range(n)))
    rows = R.numbered(spark.read.option("minPartitionNum", 4).text(str(tmp_path))).collect()
    assert sorted(r.row_no for r in rows) == list(range(1, 11))
    for i in range(4):  # a file's lines stay in their order, next to each other
        own = [r.row_no for r in sorted(rows, key=lambda r: r.value) if r.value.startswith(f"{i}:")]
        assert own == list(range(own[0], own[0] + len(own))) if own else True


def test_strict_tuples(spark):
    line = "INSERT INTO `externallinks` VALUES (,,'http://org.a.','/x'),(1,2,'http://org.b.','/y'),(3,4,'http://org.c.','/z'"
    urls = lambda strict: sorted(r.url for r in R.externallinks_urls(lines(spark, line), strict).collect())
    assert urls(False) == ["http://a.org/x", "http://b.org/y", "http://c.org/z"] and urls(True) == ["http://b.org/y"]


def test_what_the_generator_refuses(spark):
    want = {"example.com": False, ".com/": True, "www.co.uk": True, "shop.example.co.uk/": False, "/a/b": False, "/news/2024/": True, "/news": True, "é": False, "": False, "a..com": True, "/x/1": False, "docs.python": True}
    df = spark.createDataFrame([(c,) for c in want], "candidate string")
    assert {r.candidate: r.ok for r in df.select("candidate", K.is_usable_entry(F.col("candidate")).alias("ok")).collect()} == want


def test_older_candidates(spark):
    from collections import Counter

    df = spark.createDataFrame([("http://www.A.b.co.uk:80/x/yy.html?k%31=1&flag",)], "url string")
    got = {f: Counter(x for r in K.variant_candidates(df, f).collect() for x in r.candidates) for f in (True, False)}
    assert got[True]["?k1="] == got[True]["flag="] == 1 and got[True]["?k1=&flag="] == 1 and got[True][".uk/"] == 1
    assert got[True]["http://www."] == 1 and got[True]["www."] == 1 and got[True]["b."] == 1 and got[True]["www.a.b."] == 1 and got[True]["/x/yy.html/"] == 1
    assert got[False]["http://www."] == got[False]["www."] == 1 and got[False]["x"] == 0 and got[False]["yy.html"] == 1 and got[False][".b.co.uk/"] == 1
    assert got[False][".html"] == 1 and got[False]["b."] == 0


def test_report_reads_back(spark):
    from linkspark.plans import report as G

    urls = [f"https://example{i % 3}.com/news/item{i}?page={i}&reference=newsletter-of-the-week" for i in range(600)] + ["http://b.org/it's\\`"]
    numbered = spark.createDataFrame([(u, i + 1) for i, u in enumerate(urls)], "url string, row_no long")
    text = G.corpus_report(numbered, top=20)
    assert "- Rows seen: 601" in text and "- Training held-out URLs: 60" in text
    assert P.read_section(text, "Schemes") == [("https", "600"), ("http", "1")]
    chars = {r.value: r.n for r in P.report_characters(spark, text).collect()}
    assert chars["e"] > 60 and "`" not in chars
    top = P.report_candidates(spark, text).collect()
    assert top and all(r.total_score == r.n * r.saved_bits for r in top) and len(top) <= 20
    chosen = P.report_selected(spark, text).collect()
    assert chosen and all(abs(r.gain - r.cost_bits - r.net_score) < 0.11 for r in chosen)
    assert P.escaped("\\") == "\\\\" and P.escaped("\t'") == "\\t\\'" and P.escaped("\x01") == "\\u{1}"


def test_partial_reports_add_up(spark, tmp_path):
    from linkspark.plans import report as G

    urls = spark.range(90).selectExpr("concat('https://h', id % 4, '.net/a/', id) AS url", "id + 1 AS row_no")
    urls.where("row_no <= 40").coalesce(1).write.parquet(str(tmp_path / "in"))
    urls.where("row_no > 40").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, row_no long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    G.stream_report(stream, str(tmp_path / "state"), str(tmp_path / "report"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "report.partial"), wholetext=True).collect())
    assert "- Rows seen: 90" in text and P.read_section(text, "Schemes") == [("https", "90")]
    assert "Selected dictionary entries" not in text and len(list((tmp_path / "state" / "tables").glob("batch=*"))) == 2
    whole = {tuple(r) for r in G.corpus_stats(urls).collect()}
    assert {tuple(r) for r in G.merged(spark.read.schema(G.STATS).parquet(str(tmp_path / "state" / "tables"))).collect()} == whole


def test_model_tables_round_trip(spark, tmp_path):
    chars = spark.createDataFrame([(chr(97 + i % 26) if i < 26 else chr(0x4E00 + i), 100 - i) for i in range(60)] + [("`", 500)], "key string, n long")
    entries = spark.createDataFrame([(f"c{i:03d}/", 5, 1000 - i) for i in range(200)] + [("c000/", 5, 1), ("example.com", 9, 5000)], "candidate string, n long, total_score long")
    model = P.build_model(chars, entries)
    P.write_tables(model, str(tmp_path / "m"))
    t = P.read_tables(spark, str(tmp_path / "m"))
    assert t["literal"] == tuple(chr(97 + i) for i in range(26)) and len(t["primary"]) == 33 and len(t["extended"]) == 128
    assert t["primary"][:2] == ("c000/", "c001/") and t["primary"][16:31] == P.CURATED and "example.com" not in t["primary"]


def test_analytics_files(spark, tmp_path):
    from linkspark.sources import analytics as A

    group = lambda h, p, s, n: {"count": n, "dimensions": {"clientRequestHTTPHost": h, "clientRequestPath": p, "edgeResponseStatus": s}}
    days = [{"start": "2026-01-01", "end": "2026-01-02", "groups": [group("me", "/1/a", 302, 5), group("me", "/1/a", 400, 2), group("you", "/1/a", 302, 9)]}, {"start": "2026-01-02", "end": "2026-01-03", "groups": [group("me", "/api/views", 200, 7), group("me", "/1/a", 302, 1)]}]
    (tmp_path / "w.json").write_text("".join(json.dumps(d) + "\n" for d in days))
    windows = A.read_windows(spark, str(tmp_path / "w.json"))
    assert [r.truncated for r in A.window_summary(windows, 3).orderBy("start").collect()] == [True, False]
    rollup = T.path_status_rollup(A.request_counts(windows, "me"))
    assert [tuple(r) for r in A.visited_paths(rollup).orderBy("path").collect()] == [("/1/a", 8, '{"302":6,"400":2}'), ("/api/views", 7, '{"200":7}')]
    assert A.views(windows, "me").first().views == 8 and A.views(windows, "nobody").first().views == 0
    A.write_visited_paths(rollup, windows, str(tmp_path / "out"), 3)
    assert spark.read.json(str(tmp_path / "out/paths")).count() == 2 and spark.read.json(str(tmp_path / "out/windows")).count() == 2
    got = [(str(r.start), str(r.end)) for r in A.day_windows(spark, "2026-01-01 06:00:00", "2026-01-03 00:00:00").collect()]
    assert got == [("2026-01-01 06:00:00", "2026-01-02 06:00:00"), ("2026-01-02 06:00:00", "2026-01-03 00:00:00")]
    assert A.day_windows(spark, "2026-01-01 00:00:00", "2026-01-01 00:00:00").count() == 0


def test_links_resolve_once_for_all_uses(spark):
    from linkspark.functions import codec as C
    from linkspark.functions import links as L

    url = "https://example.com/x"
    rows = [(C.encode(url).short_url, url, True), (C.encode(url, "0").short_url, url, False), ("https://link.example/1/A", None, False), (None, None, None)]
    df = spark.createDataFrame(rows, "link string, url string, canonical boolean")
    for r in df.select("url", "canonical", L.resolve_link(F.col("link")).alias("r")).collect():
        assert r.r is None if r.canonical is None else (r.r.url, r.r.canonical, r.r.error is None) == (r.url, r.canonical, r.canonical)
    summary = spark.createDataFrame([(url,)], "u string").select(L.encode_summary(L.try_encode_url(F.col("u")))).first()[0]
    c = C.encode(url)
    assert summary == f"visible length: {c.short_url_length}/{c.normalized_length} chars ({c.short_url_length / c.normalized_length:.2f}x)"


def test_the_shared_folder():
    from types import SimpleNamespace

    import pytest

    from linkspark.session import shared_dir

    session = lambda folder, master: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder), sparkContext=SimpleNamespace(master=master))
    assert shared_dir(session("hdfs://x/y/", "yarn")) == "hdfs://x/y"
    assert Path(shared_dir(session(None, "local[4]"))).is_dir() and shared_dir(session(None, "local")) == shared_dir(session(None, "local[4]"))
    for master in ("yarn", "local-cluster[2,1,900]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session(None, master))
