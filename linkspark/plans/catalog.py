"""Queries over the driver's tables with their DuckDB counterparts.

CATALOG maps a name to (query, sql); sql is None where SQL cannot express the result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec as C
from ..functions import links as L
from ..functions import model as M
from ..functions import urls as U
from ..operators import candidates as K
from ..operators import corpus_stats as S
from ..operators import selection as X
from ..session import shared_dir
from ..sources import analytics as A
from ..sources import corpus as R
from ..streaming import traffic as T

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}


def listed(sql: str | None = None):
    def add(f: Query) -> Query:
        CATALOG[f.__name__] = (f, sql)
        return f

    return add


def pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url")


def training(spark: SparkSession, d: str) -> DataFrame:
    return S.with_heldout(pages(spark, d).withColumn("row_no", F.col("page_id") + 1)).where("not heldout")


def numbered(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).withColumn("row_no", F.col("page_id") + 1)


def heldout(spark: SparkSession, d: str, bodies: int = 20_000) -> DataFrame:
    """The held-out links of smallest hash key: what candidates are scored on is bounded."""
    return S.bottom_k(S.with_heldout(numbered(spark, d)).where("heldout"), bodies)


def sql_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


BODY = "CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END"
PARTS = """
u0 AS (SELECT page_id, url, strpos(url, '://') AS k FROM pages),
u1 AS (SELECT page_id, url, CASE WHEN k > 0 THEN substr(url, 1, k - 1) ELSE '' END AS scheme, CASE WHEN k > 0 THEN substr(url, k + 3) ELSE url END AS rest FROM u0),
u2 AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS host FROM u1),
u3 AS (SELECT *, split_part(substr(rest, length(host) + 1), '#', 1) AS visible FROM u2),
u4 AS (SELECT page_id, url, scheme, host, CASE WHEN strpos(visible, '?') > 0 THEN substr(visible, 1, strpos(visible, '?') - 1) ELSE visible END AS path,
  CASE WHEN strpos(visible, '?') > 0 THEN substr(visible, strpos(visible, '?') + 1) ELSE '' END AS query FROM u3),
parts AS (SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS labels FROM u4),
tails AS (SELECT *, CASE WHEN len(labels) = 0 THEN 0 WHEN strlen(labels[-1]) = 2 AND len(labels) > 1 AND labels[-2] IN ('co', 'ac', 'gov', 'com', 'org', 'net') THEN 2 ELSE 1 END AS tail,
  CASE WHEN starts_with(path, '/') THEN '/' WHEN query <> '' THEN '?' ELSE '' END AS boundary,
  list_filter(string_split(path, '/'), lambda x: x <> '' AND strlen(x) <= 80) AS segments,
  list_filter(list_transform(list_filter(string_split(query, '&'), lambda x: contains(x, '=')), lambda x: split_part(x, '=', 1)), lambda x: x <> '' AND strlen(x) <= 80) AS keys
  FROM parts)"""


def runs(items: str, n: int, before: str, gap: str, after: str) -> str:
    return f"list_transform(range(0, greatest(len({items}) - {n - 1}, 0)), lambda i: '{before}' || array_to_string({items}[i + 1 : i + {n}], '{gap}') || '{after}')"


CANDIDATES = (
    PARTS
    + """,
lead AS (SELECT *, labels[1 : greatest(len(labels) - tail - 1, 0)] AS sub FROM tails WHERE (page_id + 1) % 10 <> 0),
listed AS (SELECT flatten([
  CASE WHEN tail >= 1 AND len(labels) >= tail THEN ['.' || labels[-1]] || CASE WHEN boundary <> '' THEN ['.' || labels[-1] || boundary] ELSE [] END ELSE [] END,
  CASE WHEN tail >= 2 AND len(labels) >= tail THEN ['.' || labels[-2] || '.' || labels[-1]] || CASE WHEN boundary <> '' THEN ['.' || labels[-2] || '.' || labels[-1] || boundary] ELSE [] END ELSE [] END, """
    + ",\n  ".join(
        [runs("sub", n, "", ".", ".") for n in (1, 2, 3, 4)]
        + ["segments", "list_filter(list_transform(segments, lambda x: regexp_extract(x, '^.+(\\.[^.]+)$', 1)), lambda x: x <> '')"]
        + [runs("segments", n, "/", "/", a) for n in (1, 2, 3, 4, 5) for a in ("", "/")]
        + [runs("keys", 1, b, "", "=") for b in ("?", "&", "")]
        + [runs("keys", n, "?", "=&", "=") for n in (2, 3, 4)]
    )
    + """]) AS c FROM lead),
counts AS (SELECT candidate, count(*) AS n FROM (SELECT unnest(c) AS candidate FROM listed) GROUP BY candidate)"""
)
CHEAP = U.CHEAP.replace("'", "''")
BITS = "(6 * length({0}) + 7 * length(regexp_replace({0}, '" + CHEAP + "', '', 'g')))"
REASON = (
    ",\nr0 AS (SELECT candidate, n, "
    + BITS.format("candidate")
    + f""" AS bits, ltrim(rtrim(trim(candidate, '/'), '?#:'), '.') AS core, trim(candidate, '/?&=.-_') AS bare,
  list_filter(string_split(trim(candidate, '/'), '/'), lambda x: x <> '') AS segs FROM counts),
r1 AS (SELECT *, list_filter(string_split(core, '.'), lambda x: x <> '') AS lab FROM r0),
r2 AS (SELECT *, CASE WHEN len(lab) > 1 AND strlen(lab[-1]) = 2 AND lab[-2] IN ('co', 'ac', 'gov', 'com', 'org', 'net') THEN 2 ELSE 1 END AS tl FROM r1),
r3 AS (SELECT *, list_filter(segs, lambda x: x IN {sql_list(K.COMMON_SEGMENTS)} OR regexp_full_match(x, '[0-9]+')) AS plain,
  list_filter(segs, lambda x: NOT (x IN {sql_list(K.COMMON_SEGMENTS)} OR regexp_full_match(x, '[0-9]+')) AND (length(x) > 48 OR (length(x) >= 16 AND (len(regexp_extract_all(x, '[A-Z]')) >= 2 OR regexp_matches(x, '[^A-Za-z0-9._-]'))))) AS odd FROM r2),
judged AS (SELECT candidate, n, bits, CASE
  WHEN candidate = '' THEN 'low-signal-shape'
  WHEN strlen(candidate) > 80 THEN 'too-long'
  WHEN strlen(candidate) <> length(candidate) THEN 'non-ascii'
  WHEN bits <= 12 THEN 'no-savings'
  WHEN len(lab) >= 2 AND len(lab) > tl AND len(list_filter(lab[len(lab) - tl + 1 :], lambda x: x NOT IN {sql_list(K.SUFFIXES)})) = 0 AND lab[len(lab) - tl] NOT IN {sql_list(K.COMMON_LABELS)} THEN 'exact-domain'
  WHEN length(bare) >= 12 AND (len(regexp_extract_all(bare, '[0-9A-Fa-f]')) * 100 >= 80 * length(bare) OR (NOT regexp_matches(bare, '[^A-Za-z0-9]') AND len(regexp_extract_all(bare, '[aeiouAEIOU]')) <= 1)) THEN 'hash-like'
  WHEN length(candidate) >= 18 AND len(regexp_extract_all(candidate, '%[0-9A-Fa-f][0-9A-Fa-f]')) >= 4 THEN 'percent-blob'
  WHEN len(odd) > 0 OR (contains(candidate, '/') AND len(segs) >= 2 AND len(plain) + 1 < len(segs)) THEN 'over-specific-path'
  WHEN length(candidate) = 1 OR regexp_full_match(candidate, '[A-Za-z0-9]{{1,3}}') THEN 'low-signal-shape' END AS reason FROM r3),
scored AS (SELECT candidate, n, bits - 12 AS saved_bits, n * (bits - 12) AS total_score FROM judged WHERE reason IS NULL AND bits > 12)"""
)
MINED = "WITH " + CANDIDATES + REASON
POOL = MINED + ",\npool AS (SELECT * FROM scored ORDER BY total_score DESC, candidate LIMIT 512)"


# ------------------------------------------------------------------ scalar functions


@listed(
    """WITH a AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)', ['s', 'a']) AS m FROM pages),
b AS (SELECT page_id, url, m.s AS s, m.a AS a, regexp_extract(m.a, '^(.*@)', 1) AS usr FROM a),
c AS (SELECT *, substr(a, length(usr) + 1) AS hp, substr(url, length(s) + 4 + length(a)) AS suffix FROM b),
d AS (SELECT *, regexp_extract(hp, ':[0-9]+$') AS port FROM c)
SELECT page_id, lower(s) || '://' || usr || lower(substr(hp, 1, length(hp) - length(port))) || port || suffix AS normalized_url,
  CASE WHEN lower(s) = 'https' THEN '' ELSE lower(s) || '://' END || usr || lower(substr(hp, 1, length(hp) - length(port))) || port || suffix AS body,
  lower(s) AS scheme, lower(s) = 'https' AS https_omitted FROM d"""
)
def norm_url(spark, d):
    return pages(spark, d).select("page_id", U.normalize_url(F.col("url")).alias("n")).select("page_id", "n.normalized_url", "n.body", "n.scheme", "n.https_omitted")


@listed(
    """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'Input must be an absolute URL with a scheme followed by //' WHEN 1 THEN 'Input URL must include a host'
  WHEN 2 THEN 'Input URL must include a host after userinfo' WHEN 3 THEN 'Invalid bracketed host' WHEN 4 THEN 'Input URL must not contain ASCII control characters' END AS error FROM pages"""
)
def norm_errors(spark, d):
    bad = F.when(F.col("page_id") % 6 == 0, F.regexp_replace("url", "://", ":")).when(F.col("page_id") % 6 == 1, F.lit("http:///a")).when(F.col("page_id") % 6 == 2, F.lit("http://me@/a"))
    bad = bad.when(F.col("page_id") % 6 == 3, F.lit("http://[::1/a")).when(F.col("page_id") % 6 == 4, F.concat("url", F.lit("\u0007"))).otherwise(F.col("url"))
    return pages(spark, d).select("page_id", U.normalize_url(bad)["error"].alias("error"))


@listed(f"SELECT page_id, {BODY} AS body, CAST(strlen({BODY}) AS BIGINT) AS n_bytes FROM pages")
def compression_body(spark, d):
    b = U.compression_body(F.col("url"))
    return pages(spark, d).select("page_id", b.alias("body"), F.octet_length(b).cast("long").alias("n_bytes"))


@listed(f"WITH {PARTS} SELECT page_id, scheme, host, path, query, labels[-1] AS tld, CAST(tail AS INTEGER) AS tail, boundary FROM tails")
def url_parts(spark, d):
    p = pages(spark, d).select("page_id", U.url_parts(F.col("url")).alias("p")).select("page_id", "p.*")
    labels = U.host_labels(F.col("host"))
    return p.select("*", F.try_element_at(labels, F.lit(-1)).alias("tld"), U.public_suffix_len(labels).alias("tail"), U.host_boundary(F.col("path"), F.col("query")).alias("boundary"))


@listed(f"SELECT page_id, CAST({BITS.format(f'({BODY})')} AS BIGINT) AS bits FROM pages")
def literal_bits(spark, d):
    return pages(spark, d).select("page_id", U.literal_bits(U.compression_body(F.col("url"))).cast("long").alias("bits"))


@listed(f"""WITH {PARTS}, w AS (SELECT page_id, url, path, query, least(greatest(strlen({BODY}) - 24, 0), 256) AS room FROM tails)
SELECT page_id, greatest(room / 256.0, 0.25)::DOUBLE * CASE WHEN path = '' AND query = '' THEN 0.25 ELSE 1 END::DOUBLE AS weight FROM w""")
def url_weight(spark, d):
    return pages(spark, d).select("page_id", U.url_weight(F.col("url")).alias("weight"))


@listed(f"""SELECT page_id, CAST(6 * length(b) + 7 * length(regexp_replace(b, '[abcdefghijklmnopqrstuvwxyz0123456789._/?&=:@+,$-]', '', 'g')) AS BIGINT) AS old_bits,
  CAST(6 * length(b) + 7 * length(regexp_replace(b, '[abcdefghijklmnopqrstuvwxyz0123456789._/?&=:@+%#-]', '', 'g')) AS BIGINT) AS fast_bits FROM (SELECT page_id, {BODY} AS b FROM pages)""")
def literal_bits_variants(spark, d):
    b = U.compression_body(F.col("url"))
    return pages(spark, d).select("page_id", U.literal_bits(b, U.CHEAP_48).cast("long").alias("old_bits"), U.literal_bits(b, U.CHEAP_48_FAST).cast("long").alias("fast_bits"))


@listed("""WITH e AS (SELECT page_id, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS u FROM pages)
SELECT page_id, '<!doctype html><html lang="en"><head><meta charset="UTF-8" /><title>link.example compressed URL</title><meta name="description" content="This URL was compressed using link.example, your destination: ' || u ||
  '" /><meta property="og:title" content="link.example compressed URL" /><meta property="og:description" content="This URL was compressed using link.example, your destination: ' || u ||
  '" /><meta property="og:type" content="website" /></head><body><p><a href="' || u || '">' || u || '</a></p></body></html>' AS page FROM e""")
def embed_pages(spark, d):
    return pages(spark, d).select("page_id", U.embed_page(F.col("url"), "link.example").alias("page"))


@listed("SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM documents")
def escape_html(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", U.escape_html(F.col("text")).alias("escaped"))


# ------------------------------------------------------------------ corpus statistics


@listed(f"WITH {PARTS} SELECT scheme AS key, count(*) AS n FROM parts WHERE scheme <> '' GROUP BY 1")
def scheme_counts(spark, d):
    return S.scheme_counts(pages(spark, d))


@listed(f"WITH {PARTS} SELECT labels[-1] AS key, count(*) AS n FROM parts WHERE len(labels) > 0 GROUP BY 1")
def tld_counts(spark, d):
    return S.tld_counts(pages(spark, d))


@listed(f"WITH {PARTS} SELECT lower(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '')) AS key, count(*) AS n FROM parts WHERE host <> '' GROUP BY 1")
def host_counts(spark, d):
    return S.host_counts(pages(spark, d))


@listed(f"WITH {PARTS} SELECT key, count(*) AS n FROM (SELECT unnest(segments) AS key FROM tails WHERE (page_id + 1) % 10 <> 0) GROUP BY 1")
def path_segment_counts(spark, d):
    return S.segment_counts(training(spark, d))


@listed(f"WITH {PARTS} SELECT key, count(*) AS n FROM (SELECT unnest(keys) AS key FROM tails WHERE (page_id + 1) % 10 <> 0) GROUP BY 1")
def query_key_counts(spark, d):
    return S.key_counts(training(spark, d))


@listed(f"SELECT key, count(*) AS n FROM (SELECT unnest(string_split({BODY}, '')) AS key FROM pages) WHERE key <> '' GROUP BY 1")
def char_counts(spark, d):
    return S.char_counts(pages(spark, d))


@listed(f"SELECT CAST(least(strlen({BODY}), 4095) AS BIGINT) AS length, count(*) AS n FROM pages GROUP BY 1")
def length_histogram(spark, d):
    return S.length_histogram(pages(spark, d))


@listed(f"""WITH h AS (SELECT least(strlen({BODY}), 4095) AS length, count(*) AS n FROM pages GROUP BY 1), r AS (SELECT length, sum(n) OVER (ORDER BY length) AS run, sum(n) OVER () AS total FROM h), p(p) AS (VALUES (0.5::DOUBLE), (0.9), (0.99))
SELECT p, CAST(CASE WHEN max(floor(total * p)) = 0 THEN 0 ELSE min(CASE WHEN run >= floor(total * p) THEN length END) END AS BIGINT) AS length FROM r, p GROUP BY p""")
def length_percentiles(spark, d):
    return S.percentiles(S.length_histogram(pages(spark, d)))


@listed(f"""WITH l AS (SELECT length({BODY}) AS length, row_number() OVER (ORDER BY length({BODY})) - 1 AS i, count(*) OVER () AS total FROM pages), p(p) AS (VALUES (0.5::DOUBLE), (0.9), (0.99))
SELECT p, CAST(max(length) AS BIGINT) AS length FROM l, p WHERE i = least(total - 1, floor(total * p)) GROUP BY p""")
def length_percentiles_sorted(spark, d):
    return S.sorted_percentiles(pages(spark, d))


@listed(f"SELECT count(*) AS seen, count(*) FILTER (WHERE (page_id + 1) % 10 = 0) AS heldout, CAST(sum(strlen({BODY})) AS BIGINT) AS n_bytes, count(DISTINCT url) AS distinct_urls FROM pages")
def corpus_summary(spark, d):
    p = S.with_heldout(pages(spark, d).withColumn("row_no", F.col("page_id") + 1))
    return p.agg(F.count("*").alias("seen"), F.count_if("heldout").alias("heldout"), F.sum(F.octet_length(U.compression_body(F.col("url")))).cast("long").alias("n_bytes"), F.count_distinct("url").alias("distinct_urls"))


# ------------------------------------------------------------------ samples and splits


@listed("SELECT page_id, url FROM pages WHERE (page_id + 1) % 3 = 0 AND (page_id + 1) // 3 <= 50")
def sample_systematic(spark, d):
    return pages(spark, d).where(S.systematic(F.col("page_id") + 1, 3, 50))


@listed("SELECT page_id, CAST((page_id + 1) // 2 AS BIGINT) AS ordinal, ((page_id + 1) // 2) % 10 = 0 AS heldout FROM pages WHERE (page_id + 1) % 2 = 0")
def heldout_split(spark, d):
    return S.with_heldout(pages(spark, d).withColumn("row_no", F.col("page_id") + 1), every=2).select("page_id", "ordinal", "heldout")


KEYED = """a AS (SELECT page_id, (CAST(page_id + 1 AS UHUGEINT) + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS x FROM pages),
b AS (SELECT page_id, CAST((xor(x::UBIGINT, x::UBIGINT >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS x FROM a),
c AS (SELECT page_id, CAST((xor(x, x >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS x FROM b),
keyed AS (SELECT page_id, xor(x, x >> 31) AS k FROM c)"""


@listed(f"WITH {KEYED} SELECT page_id, CAST(k AS VARCHAR) AS hash_key FROM keyed")
def heldout_hash_key(spark, d):
    return pages(spark, d).select("page_id", S.heldout_key(F.col("page_id") + 1).cast("string").alias("hash_key"))


@listed(f"WITH {KEYED} SELECT page_id, CAST(k AS VARCHAR) AS hash_key FROM keyed ORDER BY k LIMIT 40")
def heldout_bottom_k(spark, d):
    rows = pages(spark, d).withColumn("row_no", F.col("page_id") + 1)
    return S.bottom_k(rows, 40).select("page_id", F.col("hash_key").cast("string").alias("hash_key"))


@listed("SELECT page_id, CAST(page_id + 1 AS BIGINT) AS row_no FROM pages")
def numbered_rows(spark, d):
    """Rows of several partitions in order of page_id get gapless numbers."""
    ordered = pages(spark, d).select("page_id").repartitionByRange(4, "page_id").sortWithinPartitions("page_id")
    return R.numbered(ordered)


@listed("""WITH RECURSIVE t(lo, hi, way) AS (SELECT 0, 100, '' UNION ALL
  SELECT CASE WHEN s = '1' THEN lo ELSE (lo + hi) // 2 + 1 END, CASE WHEN s = '1' THEN (lo + hi) // 2 ELSE hi END, way || s FROM t, (VALUES ('1'), ('2')) v(s) WHERE lo < hi)
SELECT CAST(row_number() OVER (ORDER BY way) - 1 AS BIGINT) AS turn, CAST((lo + hi) // 2 AS BIGINT) AS chunk FROM t WHERE lo < hi""")
def chunk_visit_order(spark, d):
    return spark.createDataFrame(list(enumerate(R.binary_visit_order(100))), "turn long, chunk long")


@listed("SELECT DISTINCT CAST(round_even(i * 99 / 29.0, 0) AS BIGINT) AS position FROM range(30) t(i)")
def shard_even_sample(spark, d):
    return S.even_positions(spark, 100, 30)


# ------------------------------------------------------------------ candidates


def mined(spark, d):
    return K.count_candidates(training(spark, d))


def pool(spark, d):
    return K.best(K.scored(mined(spark, d)))


@listed("WITH " + CANDIDATES + " SELECT candidate, n FROM counts")
def candidate_counts(spark, d):
    return mined(spark, d)


@listed(MINED + " SELECT candidate, n, reason FROM judged WHERE reason IS NOT NULL")
def candidate_rejections(spark, d):
    return K.judged(mined(spark, d)).where("reason is not null")


@listed(POOL + " SELECT candidate, n, CAST(saved_bits AS BIGINT) AS saved_bits, CAST(total_score AS BIGINT) AS total_score FROM pool")
def scored_candidates(spark, d):
    return pool(spark, d)


@listed("WITH " + CANDIDATES + " SELECT candidate, n FROM counts ORDER BY n DESC, candidate DESC LIMIT 25")
def top_entries(spark, d):
    return K.top_entries(mined(spark, d), 25)


@listed(MINED + " SELECT candidate, n, CAST(saved_bits AS BIGINT) AS saved_bits, CAST(total_score AS BIGINT) AS total_score FROM scored ORDER BY total_score DESC, candidate DESC LIMIT 40")
def scored_descending(spark, d):
    return K.best_descending(K.scored(mined(spark, d)), 40)


def variant_sql(fast: bool) -> str:
    """What the older analysers offer, by lists."""
    host = "lower(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''))"
    keyed = "list_filter(list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: url_decode(replace(split_part(x, '=', 1), '+', ' '))), lambda x: x <> '' AND length(x) <= {})"
    if fast:
        lead = [f"CASE WHEN starts_with(body, '{p}') THEN ['{p}'] ELSE [] END" for p in K.FAST_PREFIXES]
    else:
        lead = ["CASE WHEN starts_with(body, 'http://') THEN ['http://'] ELSE [] END", "CASE WHEN starts_with(h, 'www.') THEN ['www.'] || CASE WHEN starts_with(body, 'http://www.') THEN ['http://www.'] ELSE [] END ELSE [] END"]
    ends = [f"CASE WHEN len(lab) >= {k} THEN ['.' || array_to_string(lab[len(lab) - {k - 1} :], '.')] || CASE WHEN starts_with(path, '/') THEN ['.' || array_to_string(lab[len(lab) - {k - 1} :], '.') || '/'] ELSE [] END ELSE [] END" for k in range(1, 4 if fast else 5)]
    dotted = "list_filter(list_transform({0}, lambda x: regexp_extract(x, '^.+([.][^.]+)$', 1)), lambda x: {1})"
    if fast:
        rest = [runs("sub", n, "", ".", ".") for n in (1, 2, 3, 4)] + ["seg", dotted.format("seg", "x <> ''")]
        rest += [runs("seg", n, "/", "/", a) for n in (1, 2, 3, 4, 5) for a in ("", "/")] + [runs("ks", n, "?", "=&", "=") for n in (2, 3, 4)]
    else:
        fit = "list_filter(seg, lambda x: length(x) BETWEEN 2 AND 32)"
        rest = [fit, f"list_transform({fit}, lambda x: '/' || x)", f"list_transform({fit}, lambda x: '/' || x || '/')", dotted.format("seg", "length(x) BETWEEN 2 AND 8")]
    rest += [runs("ks", 1, b, "", "=") for b in ("?", "&", "")]
    segments = "list_filter(string_split(path, '/'), lambda x: x <> '' AND length(x) <= 80)" if fast else "list_filter(string_split(path, '/'), lambda x: x <> '')"
    return f"""WITH {PARTS}, v0 AS (SELECT {BODY} AS body, path, {host} AS h, {segments} AS seg, {keyed.format(80 if fast else 32)} AS ks FROM u4),
v1 AS (SELECT *, CASE WHEN h = '' THEN [] ELSE string_split(h, '.') END AS lab FROM v0), v2 AS (SELECT *, lab[1 : greatest(len(lab) - 2, 0)] AS sub FROM v1),
v3 AS (SELECT flatten([{", ".join(lead + ends + rest)}]) AS c FROM v2)
SELECT candidate, count(*) AS n FROM (SELECT unnest(c) AS candidate FROM v3) GROUP BY 1"""


def _variant(name: str, fast: bool):
    def q(spark, d):
        offered = K.variant_candidates(pages(spark, d).select("url"), fast)
        return offered.select(F.explode("candidates").alias("candidate")).groupBy("candidate").agg(F.count("*").alias("n"))

    q.__name__ = name
    listed(variant_sql(fast))(q)


_variant("variant_candidates_fast", True)
_variant("variant_candidates_old", False)

USABLE = f"""w0 AS (SELECT *, string_split(regexp_replace(trim(candidate, '/'), '^[.]', ''), '.') AS mlab, list_filter(string_split(candidate, '/'), lambda x: x <> '') AS mseg FROM {{0}}),
w1 AS (SELECT *, CASE WHEN len(mlab) >= 3 AND strlen(mlab[-1]) = 2 AND mlab[-2] IN ('co', 'ac', 'gov', 'com', 'org', 'net') THEN 2 ELSE 1 END AS mt FROM w0),
usable AS (SELECT * EXCLUDE (mlab, mseg, mt) FROM w1 WHERE candidate <> '' AND strlen(candidate) = length(candidate)
  AND NOT (len(mlab) >= 2 AND len(mlab) > mt AND len(list_filter(mlab, lambda x: x = '')) = 0 AND len(list_filter(mlab[len(mlab) - mt + 1 :], lambda x: x NOT IN {sql_list(K.MODEL_SUFFIXES)})) = 0 AND mlab[len(mlab) - mt] NOT IN {sql_list(K.MODEL_LABELS)})
  AND NOT (starts_with(candidate, '/') AND len(mseg) >= 2 AND len(list_filter(mseg, lambda x: x IN {sql_list(K.MODEL_SEGMENTS)} OR regexp_full_match(x, '[0-9]+'))) < len(mseg)))"""


@listed("WITH " + CANDIDATES + ",\n" + USABLE.format("counts") + " SELECT candidate, n FROM usable")
def generator_filter(spark, d):
    return mined(spark, d).where(K.is_usable_entry(F.col("candidate")))


@listed(f"SELECT candidate, CAST(min(rank) AS BIGINT) AS rank FROM (VALUES {', '.join(f'({sql_list([v])}, {i})' for i, v in enumerate((*M.SHARED, *M.VIDEO, *M.DICTIONARY, *M.PRIMARY)))}) AS t(candidate, rank) GROUP BY 1")
def first_by_rank(spark, d):
    rows = list(enumerate((*M.SHARED, *M.VIDEO, *M.DICTIONARY, *M.PRIMARY)))
    return K.first_by_rank(spark.createDataFrame(rows, "rank long, candidate string"))


@listed(MINED + " SELECT candidate, n, reason FROM judged WHERE reason IS NOT NULL ORDER BY n DESC, candidate DESC LIMIT 25")
def rejected_top(spark, d):
    return K.top_entries(K.judged(mined(spark, d)).where("reason is not null"), 25)


SEEDS = (*M.PRIMARY, *M.EXTENDED)


@listed("WITH " + CANDIDATES + f" SELECT candidate, n FROM counts WHERE candidate IN {sql_list(SEEDS)}")
def seeded_recount(spark, d):
    seeds = spark.createDataFrame([(s,) for s in dict.fromkeys(SEEDS)], "candidate string")
    return mined(spark, d).join(F.broadcast(seeds), "candidate", "left_semi")  # 139 seeds


@listed("WITH " + CANDIDATES + " SELECT candidate, n FROM counts WHERE n >= 5 AND length(candidate) >= 2")
def minimum_support(spark, d):
    return mined(spark, d).where("n >= 5 and length(candidate) >= 2")


# The entries that are always wanted.
CURATED = """('github.', 0), ('gitlab.', 1), ('bitbucket.', 2), ('/tree/', 3), ('/blob/', 4), ('/issues/', 5), ('/pull/', 6), ('/commit/', 7),
('/releases/', 8), ('/src/', 9), ('/docs/', 10), ('x.com/', 11), ('twitter.com/', 12), ('/status/', 13), ('/statuses/', 14)"""


@listed(POOL + f""", top AS (SELECT candidate, row_number() OVER (ORDER BY total_score DESC, candidate) AS rank FROM pool), c(candidate, k) AS (VALUES {CURATED}),
extra AS (SELECT candidate, row_number() OVER (ORDER BY k) AS j FROM c WHERE candidate NOT IN (SELECT candidate FROM top)), n AS (SELECT count(*) AS x FROM extra), t AS (SELECT count(*) AS total FROM top)
SELECT candidate, CAST(CASE WHEN rank <= 16 THEN rank ELSE rank + x END AS BIGINT) AS rank FROM top, n UNION ALL SELECT candidate, CAST(least(16, total) + j AS BIGINT) FROM extra, t""")
def curated_merge(spark, d):
    from ..plans.training import merge_curated

    return merge_curated(pool(spark, d))


@listed(
    POOL
    + ",\n"
    + USABLE.format("pool")
    + f""", c(candidate, k) AS (VALUES {CURATED}), top AS (SELECT candidate, row_number() OVER (ORDER BY total_score DESC, candidate) AS rank FROM usable),
extra AS (SELECT candidate, row_number() OVER (ORDER BY k) AS j FROM c WHERE candidate NOT IN (SELECT candidate FROM top)), n AS (SELECT count(*) AS x FROM extra), t AS (SELECT count(*) AS total FROM top),
ranks AS (SELECT candidate, CASE WHEN rank <= 16 THEN rank ELSE rank + x END AS r FROM top, n UNION ALL SELECT candidate, least(16, total) + j FROM extra, t),
chars AS (SELECT key, count(*) AS n FROM (SELECT unnest(string_split({BODY}, '')) AS key FROM pages) WHERE key <> '' AND key <> '`' AND strlen(key) = 1 GROUP BY 1),
lit AS (SELECT key, row_number() OVER (ORDER BY n DESC, key) AS r FROM chars QUALIFY r <= 48), p AS (SELECT 59 - count(*) AS k FROM lit)
SELECT 'literal' AS tier, CAST(r - 1 AS BIGINT) AS id, key AS value FROM lit
UNION ALL SELECT CASE WHEN r <= k THEN 'primary' ELSE 'extended' END, CAST(CASE WHEN r <= k THEN r - 1 ELSE r - k - 1 END AS BIGINT), candidate FROM ranks, p WHERE r <= k + 128"""
)
def model_tables(spark, d):
    from ..plans.training import build_model

    return build_model(S.char_counts(pages(spark, d)), pool(spark, d))


@listed(POOL + ", t AS (SELECT candidate, row_number() OVER (ORDER BY total_score DESC, candidate) AS r FROM pool) SELECT candidate, CASE WHEN r <= 11 THEN 'primary' ELSE 'extended' END AS tier, CAST(CASE WHEN r <= 11 THEN r - 1 ELSE r - 12 END AS BIGINT) AS id FROM t WHERE r <= 139")
def budget_partition(spark, d):
    from ..plans.training import partition_budget, ranked

    return partition_budget(ranked(pool(spark, d)), 48)


HITS = (
    MINED
    + f""",\npool AS (SELECT * FROM scored ORDER BY total_score DESC, candidate LIMIT 512),
hb AS (SELECT body, greatest(least(greatest(strlen(body) - 24, 0), 256) / 256.0, 0.25)::DOUBLE * CASE WHEN path = '' AND query = '' THEN 0.25 ELSE 1 END::DOUBLE AS weight
  FROM (SELECT {BODY} AS body, path, query FROM tails WHERE (page_id + 1) % 10 = 0)),
hits AS (SELECT candidate, saved_bits, weight, (length(body) - length(replace(body, candidate, ''))) // length(candidate) AS o FROM hb JOIN pool ON contains(body, candidate))"""
)


@listed(HITS + " SELECT candidate, CAST(sum(o) AS BIGINT) AS occurrences, CAST(count(*) AS BIGINT) AS links FROM hits GROUP BY 1")
def heldout_occurrences(spark, d):
    o = X.occurrences(pool(spark, d), heldout(spark, d))
    return o.groupBy("candidate").agg(F.sum("occurrences").alias("occurrences"), F.count("*").alias("links"))


@listed(HITS + ", g AS (SELECT candidate, sum(o) AS o, sum(o * saved_bits * weight) AS gain FROM hits GROUP BY 1) SELECT pool.candidate, CAST(coalesce(o, 0) AS BIGINT) AS occurrences, (coalesce(gain, 0) - (8 * strlen(pool.candidate) + 16))::DOUBLE AS net_score FROM pool LEFT JOIN g ON pool.candidate = g.candidate")
def initial_net_score(spark, d):
    return X.initial_scores(pool(spark, d), heldout(spark, d))


@listed()
def select_dictionary(spark, d, bodies=20_000):
    return X.select_dictionary(pool(spark, d), heldout(spark, d, bodies)).where("kind = 'selected'").drop("kind")


@listed()
def shadowed_tokens(spark, d, bodies=20_000):
    return X.select_dictionary(pool(spark, d), heldout(spark, d, bodies)).where("kind = 'shadowed'").select("rank", "candidate", "n", F.col("gain").alias("initial_net"), F.col("net_score").alias("final_net"))


# ------------------------------------------------------------------ sources


def dump_lines(spark, d, broken: bool = False) -> DataFrame:
    """Lines of a dump, seven tuples each; broken ones lack the integers of every fifth."""
    p = pages(spark, d).select("page_id", "url", U.url_parts(F.col("url")).alias("p"))
    index = F.concat("p.scheme", F.lit("://"), F.array_join(F.reverse(U.host_labels(F.col("p.host"))), "."), F.lit("."))
    path = F.replace(U.after(F.col("url"), F.length("p.scheme") + 3 + F.length("p.host")), F.lit("'"), F.lit("\\'"))
    ids = F.when(F.lit(broken) & (F.col("page_id") % 5 == 0), F.lit(",")).otherwise(F.concat(F.col("page_id").cast("string"), F.lit(",1")))
    row = F.concat(F.lit("("), ids, F.lit(",'"), index, F.lit("','"), path, F.lit("')"))
    lines = p.select(F.floor(F.col("page_id") / 7).alias("line"), row.alias("row")).groupBy("line").agg(F.array_join(F.collect_list("row"), ",").alias("rows"))
    return lines.select(F.concat(F.lit("INSERT INTO `externallinks` VALUES "), "rows", F.lit(";")).alias("value"))


LOWERED = f"WITH {PARTS} SELECT lower(scheme) || '://' || lower(array_to_string(labels, '.')) || substr(rest0, length(host) + 1) AS url FROM (SELECT *, substr(url, length(scheme) + 4) AS rest0 FROM parts)"


@listed(LOWERED)
def externallinks_roundtrip(spark, d):
    return R.externallinks_urls(dump_lines(spark, d))


@listed(LOWERED)
def externallinks_lenient(spark, d):
    return R.externallinks_urls(dump_lines(spark, d, broken=True))


@listed(LOWERED + " WHERE page_id % 5 <> 0")
def externallinks_strict(spark, d):
    return R.externallinks_urls(dump_lines(spark, d, broken=True), strict=True)


@listed("SELECT url FROM pages")
def cdxj_roundtrip(spark, d):
    record = F.to_json(F.struct(F.lit("200").alias("status"), F.col("url").alias("url")))
    return R.cdxj_urls(pages(spark, d).select(F.concat(F.lit("com,example)/ 20260101000000 "), record).alias("value")))


@listed("SELECT url FROM pages")
def plain_urls(spark, d):
    return R.plain_urls(pages(spark, d).select(F.concat(F.lit("  "), "url", F.lit("\t")).alias("value")))


@listed("""WITH b AS (SELECT regexp_extract(url, '^[^:]+://[^/?#]*') AS base, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS path FROM pages) SELECT base || path AS url FROM b""")
def href_corpus(spark, d):
    return R.hrefs(spark.read.parquet(f"{d}/pages.parquet").select("url", "html"))


# ------------------------------------------------------------------ codes

NORMAL = CATALOG["norm_url"][1]


def _roundtrip(name: str, **options):
    def q(spark, d):
        code = L.try_encode_url(F.col("url"), **options)
        coded = pages(spark, d).select("page_id", code.alias("c"))
        back = L.try_decode_short_url(F.col("c.short_url"))
        return coded.select("page_id", F.col("c.version").alias("version"), F.col("c.carrier").alias("carrier"), back["url"].alias("url"))

    q.__name__ = name
    carrier = "client-max" if options.get("allow_fragment") else "server-safe"
    listed(f"SELECT page_id, '{options.get('version', '1')}' AS version, '{carrier}' AS carrier, normalized_url AS url FROM ({NORMAL})")(q)


for _v in M.VERSIONS:
    _roundtrip(f"encode_roundtrip_v{_v}_ascii", version=_v)
    _roundtrip(f"encode_roundtrip_v{_v}_cjk", version=_v, cjk=True)
    _roundtrip(f"encode_roundtrip_v{_v}_fragment", version=_v, allow_fragment=True)


@listed("SELECT page_id, page_id % 3 <> 1 AS canonical FROM pages")
def canonical_flag(spark, d):
    """Version 1 links are canonical in both alphabets; version 0 links never are."""
    v1, v0, cjk = (L.try_encode_url(F.col("url"), **o)["short_url"] for o in ({}, {"version": "0"}, {"cjk": True}))
    coded = pages(spark, d).select("page_id", F.when(F.col("page_id") % 3 == 0, v1).when(F.col("page_id") % 3 == 1, v0).otherwise(cjk).alias("link"))
    return coded.select("page_id", L.is_canonical(F.col("link")).alias("canonical"))


@listed("SELECT page_id, '0' AS version, 'abc/' || page_id AS payload FROM pages")
def short_url_parse(spark, d):
    link = F.concat(F.lit("https://link.example/0/abc/"), F.col("page_id").cast("string"))
    return pages(spark, d).select("page_id", U.payload_surface(link).alias("s")).select("page_id", "s.version", "s.payload")


@listed(f"SELECT page_id, body AS text FROM ({NORMAL})")
def tokens_materialize(spark, d):
    return pages(spark, d).select("page_id", L.materialized(F.col("url")).alias("text"))


@listed()
def encode_payloads(spark, d):
    return pages(spark, d).select("page_id", L.try_encode_url(F.col("url")).alias("c")).select("page_id", "c.*")


@listed()
def token_type_histogram(spark, d):
    t = pages(spark, d).select(F.explode(L.tokenize_url(F.col("url"))).alias("t"))
    return t.groupBy("t.type").agg(F.count("*").alias("n"), F.sum("t.text_length").alias("text_length"), F.sum("t.cost_bits").alias("cost_bits"))


@listed()
def ratio_by_version_alphabet(spark, d):
    parts = []
    for v in M.VERSIONS:
        for cjk in (False, True):
            c = pages(spark, d).select(L.try_encode_url(F.col("url"), version=v, cjk=cjk).alias("c"))
            parts.append(c.agg(F.lit(v).alias("version"), F.lit("cjk" if cjk else "ascii").alias("alphabet"), F.sum("c.payload_length").alias("payload"), F.sum("c.normalized_length").alias("normal")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("ratio", F.round(F.col("payload") / F.col("normal"), 4))


@listed()
def compression_ratio_by_length_bucket(spark, d):
    c = pages(spark, d).select(L.try_encode_url(F.col("url")).alias("c")).select((F.floor(F.col("c.normalized_length") / 16) * 16).alias("from_length"), "c.*")
    return c.groupBy("from_length").agg(F.count("*").alias("links"), F.round(F.sum("payload_length") / F.sum("normalized_length"), 4).alias("ratio"))


@listed(f"SELECT page_id, page_id % 3 <> 1 AS canonical, normalized_url AS url FROM ({NORMAL})")
def decode_for_ui(spark, d):
    """Canonical or not, a link that decodes gives its url."""
    v1, v0, cjk = (L.try_encode_url(F.col("url"), **o)["short_url"] for o in ({}, {"version": "0"}, {"cjk": True}))
    coded = pages(spark, d).select("page_id", F.when(F.col("page_id") % 3 == 0, v1).when(F.col("page_id") % 3 == 1, v0).otherwise(cjk).alias("link"))
    found = coded.select("page_id", L.resolve_link(F.col("link")).alias("r"))
    return found.select("page_id", "r.canonical", "r.url")


@listed()
def encode_summaries(spark, d):
    return pages(spark, d).select("page_id", L.try_encode_url(F.col("url")).alias("c")).select("page_id", L.encode_summary(F.col("c")).alias("summary"))


DICTIONARY_VALUES = ", ".join(f"('{t}', {i}, '{v}')" for t, vs in (("primary", M.PRIMARY), ("extended", M.EXTENDED)) for i, v in enumerate(vs))


@listed(f"""WITH m(tier, id, value) AS (VALUES {DICTIONARY_VALUES}), b AS (SELECT {BODY} AS body FROM pages)
SELECT tier, id, value, count(body) AS links, CAST(coalesce(sum((length(body) - length(replace(body, value, ''))) // length(value)), 0) AS BIGINT) AS occurrences FROM m LEFT JOIN b ON contains(body, value) GROUP BY ALL""")
def dictionary_coverage(spark, d):
    from ..plans.report import coverage

    return coverage(pages(spark, d), M.dimension_tables(spark)["model_dictionary"])


TOP = "SELECT '{0}' AS section, key, n FROM ({1}) ORDER BY n DESC, key DESC LIMIT {2}"


@listed(
    " UNION ALL ".join(
        f"SELECT * FROM ({TOP.format(title, CATALOG[name][1], k)})"
        for title, name, k in (("Schemes", "scheme_counts", 20), ("Top TLDs", "tld_counts", 50), ("Top path segments", "path_segment_counts", 30), ("Top query keys", "query_key_counts", 30))
    )
    + f" UNION ALL SELECT * FROM (SELECT 'Top body characters' AS section, key, n FROM ({CATALOG['char_counts'][1]}) WHERE strlen(key) = 1 AND key <> '`' ORDER BY n DESC, key LIMIT 30)"
)
def report_sections(spark, d):
    """The report's tables, from statistics of two halves of the corpus that are summed."""
    from ..plans import report as G

    parts = [G.corpus_stats(numbered(spark, d).where(F.col("page_id") % 2 == k)) for k in (0, 1)]
    stats = G.merged(parts[0].unionByName(parts[1]))
    out = G.characters(stats, 30).withColumn("section", F.lit("Top body characters"))
    for title, stat, k in G.SECTIONS:
        out = out.unionByName(G.section(stats, stat, k or 30).withColumn("section", F.lit(title)))
    return out.select("section", "key", "n")


@listed(f"SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'asset' WHEN page_id % 5 = 1 THEN 'app' WHEN page_id % 5 = 2 THEN 'error' WHEN page_id % 5 = 3 THEN 'embed' ELSE 'redirect' END AS action, CAST(CASE WHEN page_id % 5 = 2 THEN 400 WHEN page_id % 5 = 4 THEN 302 ELSE 200 END AS INTEGER) AS status, CASE WHEN page_id % 5 >= 3 THEN normalized_url END AS target FROM ({NORMAL})")
def route_requests(spark, d):
    v1, v0 = L.try_encode_url(F.col("url"))["short_url"], L.try_encode_url(F.col("url"), version="0")["short_url"]
    k = F.col("page_id") % 5
    raw = F.when(k == 0, F.lit("https://link.example/")).when(k == 1, v0).when(k == 2, F.lit("https://link.example/1/A")).otherwise(v1)
    agent = F.when(k == 3, F.lit("Discordbot/2.0")).otherwise(F.lit("Mozilla/5.0"))
    reqs = pages(spark, d).select("page_id", raw.alias("raw"), agent.alias("agent"))
    r = reqs.select("page_id", T.route(F.col("raw"), F.col("agent")).alias("r"))
    return r.select("page_id", "r.action", "r.status", F.when(F.col("r.action") != "error", F.col("r.location")).alias("target"))


# ------------------------------------------------------------------ traffic


def requests(spark, d):
    """The events as a request log."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.concat(F.lit("/"), "event_type").alias("path"), F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 3 * 100 + 200).cast("int").alias("status"))


@listed("SELECT '/' || event_type AS path, count(*) AS n FROM events GROUP BY 1")
def visit_filter(spark, d):
    noise = requests(spark, d).select(F.lit("/api/views").alias("path"))
    return requests(spark, d).select("path").unionByName(noise).where(U.counts_as_visit(F.col("path"))).groupBy("path").agg(F.count("*").alias("n"))


@listed("SELECT event_id, event_id % 2 = 0 AS preview FROM events")
def bot_filter(spark, d):
    agent = F.when(F.col("event_id") % 2 == 0, F.lit("Mozilla TwitterBot")).otherwise(F.lit("Mozilla/5.0 Firefox"))
    return requests(spark, d).select("event_id", U.is_preview_agent(agent).alias("preview"))


@listed("SELECT path, CAST(sum(n) AS BIGINT) AS n, string_agg(status || ':' || n, ',' ORDER BY status) AS statuses FROM (SELECT '/' || event_type AS path, user_id % 3 * 100 + 200 AS status, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def path_status_rollup(spark, d):
    r = T.path_status_rollup(requests(spark, d).withColumn("n", F.lit(1).cast("long")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("statuses")), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",")
    return r.select("path", "n", text.alias("statuses"))


DAILY = "SELECT '/' || event_type AS path, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS views FROM events GROUP BY 1, 2"


@listed(DAILY)
def daily_views(spark, d):
    return T.daily(requests(spark, d)).withColumn("day", F.to_date("day"))


@listed("""WITH e AS (SELECT max(ts) AS e FROM events) SELECT CAST(8 - ceil((epoch_us(e) - epoch_us(ts)) / 86400000000.0) AS BIGINT) AS day, count(*) AS views
FROM events, e WHERE event_type <> 'view' AND ts < e AND ts >= e - INTERVAL 7 DAY GROUP BY 1""")
def seven_day_views(spark, d):
    """Visits that count in the seven windows of a day that end with the last event; views stand for requests of
    the counter itself, which do not."""
    r = requests(spark, d).withColumn("path", F.when(F.col("path") == "/view", "/api/views").otherwise(F.col("path")))
    end = r.agg(F.max("ts").alias("end"))
    return T.views_before(r.crossJoin(F.broadcast(end)), F.col("end"))  # one row


def analytics_lines(spark, d, limit: int = 40) -> DataFrame:
    """A day's requests a line, as the analytics service answers: the `limit` largest groups."""
    r = requests(spark, d).withColumn("host", F.when(F.col("event_id") % 4 == 0, "other.example").otherwise("link.example")).withColumn("day", F.to_date("ts"))
    groups = r.groupBy("day", "host", "path", "status").agg(F.count("*").alias("n"))
    dimensions = F.struct(F.col("host").alias("clientRequestHTTPHost"), F.col("path").alias("clientRequestPath"), F.col("status").alias("edgeResponseStatus"))
    by_day = groups.groupBy("day").agg(F.collect_list(F.struct(F.col("n").alias("count"), dimensions.alias("dimensions"))).alias("groups"))
    return by_day.select(F.to_json(F.struct(F.col("day").cast("string").alias("start"), F.date_add("day", 1).cast("string").alias("end"), "groups")).alias("value"))


DAYS = "d AS (SELECT CAST(ts AS DATE) AS day, '/' || event_type AS path, user_id % 3 * 100 + 200 AS status, CASE WHEN event_id % 4 = 0 THEN 'other.example' ELSE 'link.example' END AS host FROM events)"


@listed(f"WITH {DAYS}, g AS (SELECT day, host, path, status, count(*) AS n FROM d GROUP BY ALL) SELECT CAST(day AS VARCHAR) AS start, CAST(CAST(day + INTERVAL 1 DAY AS DATE) AS VARCHAR) AS end, count(*) AS groups, count(*) >= 30 AS truncated FROM g GROUP BY day")
def analytics_windows(spark, d):
    return A.window_summary(A.parsed_windows(analytics_lines(spark, d)), limit=30)


@listed(f"""WITH {DAYS}, g AS (SELECT path, status, count(*) AS n FROM d WHERE host = 'link.example' GROUP BY ALL)
SELECT path, CAST(sum(n) AS BIGINT) AS count, '{{' || string_agg('"' || status || '":' || n, ',' ORDER BY status) || '}}' AS statuses FROM g GROUP BY path""")
def visited_paths(spark, d):
    counts = A.request_counts(A.parsed_windows(analytics_lines(spark, d)), "link.example")
    return A.visited_paths(T.path_status_rollup(counts))


@listed(f"WITH {DAYS} SELECT count(*) AS views FROM d WHERE host = 'link.example'")
def analytics_views(spark, d):
    return A.views(A.parsed_windows(analytics_lines(spark, d)), "link.example")


@listed("""WITH e AS (SELECT min(ts) AS a, max(ts) AS b FROM events), s AS (SELECT b, unnest(range(a, b, INTERVAL 1 DAY)) AS w FROM e)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, strftime(least(w + INTERVAL 1 DAY, b), '%Y-%m-%d %H:%M:%S') AS end FROM s""")
def day_windows(spark, d):
    a, b = requests(spark, d).agg(F.min("ts").cast("string"), F.max("ts").cast("string")).first()
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return A.day_windows(spark, a, b).select(text("start"), text("end"))


@listed("SELECT CAST(NULL AS BIGINT) AS unbound, max(event_id) AS bound, CAST(0 AS BIGINT) AS unknown FROM events WHERE event_type = 'view'")
def views_endpoint(spark, d):
    """The counter's value as requests see it, after upserts in three batches."""
    folder = f"{shared_dir(spark)}/counters-{uuid.uuid4().hex}"
    sink = T.counter_sink(f"{folder}/now", f"{folder}/then")
    u = requests(spark, d).select(F.substring("path", 2, 99).alias("key"), F.col("event_id").alias("value"), F.col("event_id").cast("timestamp").alias("updated_at"))
    for i, part in enumerate((u.where("value % 3 = 0"), u.where("value % 3 = 1"), u.where("value % 3 = 2"))):
        largest = T.latest(u.where(F.col("value") % 3 <= i))  # a counter only grows
        sink(part.limit(0).unionByName(largest.select("key", "value", "updated_at")), i)
    one, two, three = (T.views_endpoint(spark, t, k).withColumnRenamed("views", n) for t, k, n in ((None, "view", "unbound"), (f"{folder}/now", "view", "bound"), (f"{folder}/now", "nothing", "unknown")))
    return one.crossJoin(two).crossJoin(three)  # one row each


@listed("""WITH w AS (SELECT '/' || event_type AS path, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS e, count(*) AS n FROM events GROUP BY 1, 2)
SELECT path, strftime(e, '%Y-%m-%d %H:%M:%S') AS created_at, CAST(sum(n) OVER (PARTITION BY path ORDER BY e) AS BIGINT) AS value FROM w""")
def six_hour_snapshots(spark, d):
    return T.snapshots(requests(spark, d)).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@listed("SELECT '/' || event_type AS key, greatest(count(*), 1500) AS value FROM events GROUP BY 1")
def counter_seed_max(spark, d):
    counts = requests(spark, d).groupBy(F.col("path").alias("key")).agg(F.count("*").alias("value"))
    return T.seeded(counts, counts.select("key", F.lit(1500).cast("long").alias("value")))


@listed("""SELECT key, value, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at FROM (SELECT '/' || event_type AS key, event_id AS value, ts AS updated_at, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_counter_upsert(spark, d):
    u = requests(spark, d).select(F.col("path").alias("key"), F.col("event_id").alias("value"), F.col("ts").alias("updated_at"))
    return T.latest(u).withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@listed(DAILY)
def stream_daily_views(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(d)
    e = e.select(F.concat(F.lit("/"), "event_type").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    return T.stream_daily(e, "stream_daily_views").withColumn("day", F.to_date("day"))


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in CATALOG.items() if s}


DEFAULT_ORIGIN = C.ORIGIN
