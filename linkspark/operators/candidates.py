"""Reusable substrings of links: which a link offers, why one is rejected, and what it would save.

Everything is a native column expression. Reasons depend on the candidate alone, so they are evaluated once a
distinct candidate, after counting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

TOKEN_COST = 12
LONGEST = 80

# Labels that may follow a registered name.
SUFFIXES = (
    "com", "org", "net", "gov", "edu", "co", "ac", "uk", "au", "jp", "de", "fr", "ca", "us", "mil", "info", "io",
    "tv", "ie", "nz", "nl", "se", "ru", "it", "in", "br", "cn", "es", "eu", "za", "ai", "dev", "app", "xyz", "me",
    "cloud", "online", "site", "shop",
)

# Host labels that name no particular site.
COMMON_LABELS = (
    "www", "m", "mobile", "api", "docs", "news", "books", "maps", "search", "support", "help", "blog", "cdn",
    "static", "assets", "images", "img", "data", "download", "downloads", "ftp", "mail", "media", "video", "shop",
    "store", "admin", "login", "auth", "status", "developer", "developers",
)

# Path segments that many sites share.
COMMON_SEGMENTS = (
    "api", "v1", "v2", "v3", "wp-content", "wp-admin", "content", "assets", "static", "images", "img", "media",
    "files", "download", "downloads", "news", "article", "articles", "blog", "posts", "post", "archive", "archives",
    "search", "results", "page", "pages", "watch", "video", "videos", "wiki", "index.php", "cgi-bin", "login",
    "auth", "oauth", "products", "product", "category", "categories", "docs", "documentation", "help", "support",
    "about", "tags", "tag", "reviews", "review", "html", "pdf", "en", "es", "de", "fr", "it", "nl", "ru", "ja",
    "zh", "ko", "pt",
)


def _runs(parts: Column, n: int, make) -> Column:
    """make(joined slice) of every run of n neighbours; empty where there are fewer."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(parts) - n + 1, F.lit(1)))
    return F.when(F.size(parts) >= n, F.transform(starts, lambda i: make(F.slice(parts, i, n)))).otherwise(F.array().cast("array<string>"))


def host_candidates(labels: Column, boundary: Column) -> Column:
    """Suffixes of the host, with and without what follows it, and its leading labels."""
    tail, n = U.public_suffix_len(labels), F.size(labels)
    out = []
    for k in (1, 2):
        suffix = F.concat(F.lit("."), F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), "."))
        fits = (tail >= k) & (n >= tail)
        out.append(F.when(fits & (boundary != ""), F.array(suffix, F.concat(suffix, boundary))).when(fits, F.array(suffix)).otherwise(F.array().cast("array<string>")))
    lead = F.slice(labels, 1, F.greatest(n - tail - 1, F.lit(0)))
    dotted = lambda x: F.concat(F.array_join(x, "."), F.lit("."))
    return F.concat(*out, *(_runs(lead, k, dotted) for k in (1, 2, 3, 4)))


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: (x != "") & (F.octet_length(x) <= LONGEST))


def path_candidates(segments: Column) -> Column:
    slash = F.lit("/")
    ending = F.filter(F.transform(segments, lambda x: F.regexp_extract(x, r"(?s)^.+(\.[^.]+)\z", 1)), lambda x: x != "")
    bare = F.transform(segments, lambda x: x)
    led = lambda x: F.concat(slash, F.array_join(x, "/"))
    closed = lambda x: F.concat(slash, F.array_join(x, "/"), slash)
    return F.concat(bare, ending, *(_runs(segments, n, f) for n in (1, 2, 3, 4, 5) for f in (led, closed)))


def query_keys(query: Column) -> Column:
    keyed = F.filter(F.split(query, "&"), lambda x: F.contains(x, F.lit("=")))
    return F.filter(F.transform(keyed, lambda x: F.substring_index(x, "=", 1)), lambda x: (x != "") & (F.octet_length(x) <= LONGEST))


def _led(keys: Column, mark: str) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(mark), k, F.lit("=")))


def query_candidates(keys: Column) -> Column:
    return F.concat(*(_led(keys, c) for c in ("?", "&", "")), *(_runs(keys, n, lambda x: F.concat(F.lit("?"), F.array_join(x, "=&"), F.lit("="))) for n in (2, 3, 4)))


def with_candidates(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """urls with an array of every candidate that a link offers, as often as it offers it.

    The steps are separate projections, so that each part of a link is found once.
    """
    p = urls.withColumn("_p", U.url_parts(F.col(url_col)))
    p = p.withColumns({"_labels": U.host_labels(F.col("_p.host")), "_boundary": U.host_boundary(F.col("_p.path"), F.col("_p.query")), "_segments": path_segments(F.col("_p.path")), "_keys": query_keys(F.col("_p.query"))})
    every = F.concat(host_candidates(F.col("_labels"), F.col("_boundary")), path_candidates(F.col("_segments")), query_candidates(F.col("_keys")))
    return p.withColumn("candidates", every).drop("_p", "_labels", "_boundary", "_segments", "_keys")


# ------------------------------------------------------------------ rejection


def _among(x: Column, values: tuple[str, ...]) -> Column:
    return x.isin(*values)


def is_exact_domain(c: Column) -> Column:
    core = F.ltrim(F.rtrim(F.trim(c, F.lit("/")), F.lit("?#:")), F.lit("."))
    labels = U.host_labels(core)
    n, tail = F.size(labels), U.public_suffix_len(labels)
    after = F.slice(labels, F.greatest(n - tail + 1, F.lit(1)), tail)
    name = F.try_element_at(labels, F.greatest(n - tail, F.lit(1)))
    return (n >= 2) & (n > tail) & F.forall(after, lambda x: _among(x, SUFFIXES)) & ~_among(name, COMMON_LABELS)


def is_hash_like(c: Column) -> Column:
    core = F.trim(c, F.lit("/?&=.-_"))
    n = F.length(core)
    hexes = F.regexp_count(core, F.lit("[0-9A-Fa-f]"))
    plain = ~core.rlike("[^A-Za-z0-9]") & (F.regexp_count(core, F.lit("(?i)[aeiou]")) <= 1)
    return (n >= 12) & ((hexes * 100 >= 80 * n) | plain)


def is_percent_blob(c: Column) -> Column:
    return (F.length(c) >= 18) & (F.regexp_count(c, F.lit("%[0-9A-Fa-f]{2}")) >= 4)


def _ordinary(segment: Column) -> Column:
    return _among(segment, COMMON_SEGMENTS) | segment.rlike(r"^[0-9]+\z")


def is_over_specific(c: Column) -> Column:
    segments = F.filter(F.split(F.trim(c, F.lit("/")), "/"), lambda x: x != "")
    odd = lambda s: ~_ordinary(s) & ((F.length(s) > 48) | ((F.length(s) >= 16) & ((F.regexp_count(s, F.lit("[A-Z]")) >= 2) | s.rlike("[^A-Za-z0-9._-]"))))
    many = F.contains(c, F.lit("/")) & (F.size(segments) >= 2) & (F.size(F.filter(segments, _ordinary)) + 1 < F.size(segments))
    return F.exists(segments, odd) | many


def is_low_signal(c: Column) -> Column:
    return (F.length(c) == 1) | c.rlike(r"^[A-Za-z0-9]{1,3}\z")


def rejection_reason(c: Column, cost: int = TOKEN_COST) -> Column:
    """The first reason that applies, or null for an accepted candidate."""
    return (
        F.when(c == "", "low-signal-shape")
        .when(F.octet_length(c) > LONGEST, "too-long")
        .when(c.rlike(r"[^\x00-\x7F]"), "non-ascii")
        .when(U.literal_bits(c) <= cost, "no-savings")
        .when(is_exact_domain(c), "exact-domain")
        .when(is_hash_like(c), "hash-like")
        .when(is_percent_blob(c), "percent-blob")
        .when(is_over_specific(c), "over-specific-path")
        .when(is_low_signal(c), "low-signal-shape")
    )


def count_candidates(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """candidate, n. Partial aggregation runs before the shuffle; nothing is pruned."""
    return with_candidates(urls.select(url_col), url_col).select(F.explode("candidates").alias("candidate")).groupBy("candidate").agg(F.count("*").alias("n"))


def judged(counts: DataFrame, cost: int = TOKEN_COST) -> DataFrame:
    return counts.withColumn("reason", rejection_reason(F.col("candidate"), cost))


def scored(counts: DataFrame, cost: int = TOKEN_COST) -> DataFrame:
    """candidate, n, saved_bits, total_score of accepted candidates that save something."""
    saved = (U.literal_bits(F.col("candidate")) - cost).cast("long")
    good = judged(counts, cost).where("reason is null").withColumn("saved_bits", saved).where("saved_bits > 0")
    return good.select("candidate", "n", "saved_bits", (F.col("n") * F.col("saved_bits")).alias("total_score"))


def best(scored_counts: DataFrame, k: int = 512) -> DataFrame:
    return scored_counts.orderBy(F.desc("total_score"), "candidate").limit(k)


def top_entries(counts: DataFrame, k: int, key: str = "candidate") -> DataFrame:
    """The k most frequent keys, most frequent first and then by key; at the cut, equal counts keep the largest keys."""
    return counts.orderBy(F.desc("n"), F.desc(key)).limit(k).orderBy(F.desc("n"), key)


def best_descending(scored_counts: DataFrame, k: int) -> DataFrame:
    """The older analysers' order: equal scores by candidate, largest first."""
    return scored_counts.orderBy(F.desc("total_score"), F.desc("candidate")).limit(k)


def first_by_rank(rows: DataFrame, key: str = "candidate", rank: str = "rank") -> DataFrame:
    """Each key once, with its least rank."""
    return rows.groupBy(key).agg(F.min(rank).alias(rank))


# ------------------------------------------------------------------ what the older analysers offer


def host_name(url: Column) -> Column:
    """The host in lower case, without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(U.url_parts(url)["host"], r"(?s)^.*@", ""), r":[0-9]*\z", ""))


def decoded_keys(query: Column, longest: int) -> Column:
    """Query keys, decoded, of all non-empty parts, whether they have a value or not."""
    parts = F.filter(F.split(query, "&"), lambda x: x != "")
    raw = F.transform(parts, lambda x: F.substring_index(x, "=", 1))
    return F.filter(F.transform(raw, lambda x: F.coalesce(F.try_url_decode(x), x)), lambda x: (x != "") & (F.length(x) <= longest))


# Beginnings of links that the older analysers count.
FAST_PREFIXES = ("http://", "http://www.", "https://", "https://www.", "www.")


def variant_candidates(urls: DataFrame, fast: bool = True, url_col: str = "url") -> DataFrame:
    """urls with the candidates of the older analysers, as often as they offer them.

    fast: prefixes, suffixes of one to three labels, n-grams of the labels before the last two, segments and
    keys as in with_candidates. Otherwise: suffixes of one to four labels, no n-grams, and only segments of 2 to
    32 characters, endings of 2 to 8 and keys of up to 32.
    """
    body = U.compression_body(F.col(url_col))
    p = urls.withColumn("_body", body).withColumn("_p", U.url_parts(F.col(url_col))).withColumn("_host", host_name(F.col(url_col)))
    labels = F.when(F.col("_host") == "", F.array().cast("array<string>")).otherwise(F.split("_host", r"\."))
    longest = LONGEST if fast else 32
    p = p.withColumns({"_labels": labels, "_segments": F.filter(F.split("_p.path", "/"), lambda x: x != ""), "_keys": decoded_keys(F.col("_p.query"), longest)})
    none, n = F.array().cast("array<string>"), F.size("_labels")
    rooted = F.col("_p.path").startswith("/")
    out = []
    if fast:
        out += [F.when(F.col("_body").startswith(x), F.array(F.lit(x))).otherwise(none) for x in FAST_PREFIXES]
    else:
        out.append(F.when(F.col("_body").startswith("http://"), F.array(F.lit("http://"))).otherwise(none))
        www = F.col("_host").startswith("www.")
        out.append(F.when(www, F.array(F.lit("www."))).otherwise(none))
        out.append(F.when(www & F.col("_body").startswith("http://www."), F.array(F.lit("http://www."))).otherwise(none))
    for k in range(1, 4 if fast else 5):
        suffix = F.concat(F.lit("."), F.array_join(F.slice("_labels", F.greatest(n - k + 1, F.lit(1)), k), "."))
        out.append(F.when((n >= k) & rooted, F.array(suffix, F.concat(suffix, F.lit("/")))).when(n >= k, F.array(suffix)).otherwise(none))
    segments = F.col("_segments")
    if fast:
        segments = F.filter(segments, lambda x: F.length(x) <= LONGEST)
        lead = F.slice("_labels", 1, F.greatest(n - 2, F.lit(0)))
        out += [_runs(lead, k, lambda x: F.concat(F.array_join(x, "."), F.lit("."))) for k in (1, 2, 3, 4)]
        every = F.concat(*out, path_candidates(segments), query_candidates(F.col("_keys")))
    else:
        fit = F.filter(segments, lambda x: F.length(x).between(2, 32))
        ending = F.filter(F.transform(segments, lambda x: F.regexp_extract(x, r"(?s)^.+(\.[^.]+)\z", 1)), lambda x: F.length(x).between(2, 8))
        led = [fit, F.transform(fit, lambda x: F.concat(F.lit("/"), x)), F.transform(fit, lambda x: F.concat(F.lit("/"), x, F.lit("/")))]
        every = F.concat(*out, *led, ending, *(_led(F.col("_keys"), c) for c in ("?", "&", "")))
    return p.withColumn("candidates", every).drop("_body", "_p", "_host", "_labels", "_segments", "_keys")


# ------------------------------------------------------------------ what the model generator refuses

# Suffixes, site-less labels and common segments of the model generator.
MODEL_SUFFIXES = (
    "com", "org", "net", "gov", "edu", "co", "ac", "uk", "au", "jp", "de", "fr", "ca", "us", "mil", "info", "io",
    "tv", "ie", "nz", "nl", "se", "ru", "it", "in", "br", "cn", "es", "eu", "za",
)
MODEL_LABELS = (
    "www", "m", "mobile", "api", "docs", "news", "books", "maps", "search", "support", "help", "blog", "cdn",
    "static", "assets", "images", "data", "download", "downloads", "ftp", "mail",
)
MODEL_SEGMENTS = (
    "news", "search", "article", "articles", "index.php", "cgi-bin", "books", "archive", "archives", "story",
    "stories", "content", "view", "page", "pages", "watch", "wiki", "images", "files", "sports", "music", "reviews",
    "about", "data", "results", "html", "pdf",
)


def is_usable_entry(c: Column) -> Column:
    """Whether the model generator takes a candidate: ASCII, no registered domain, no path of one site."""
    labels = F.split(F.regexp_replace(F.trim(c, F.lit("/")), r"^\.", ""), r"\.")
    n = F.size(labels)
    two = (n >= 3) & (F.octet_length(F.try_element_at(labels, F.lit(-1))) == 2) & F.coalesce(_among(F.try_element_at(labels, F.lit(-2)), U.SECOND_LEVEL), F.lit(False))
    tail = F.when(two, 2).otherwise(1)
    after = F.slice(labels, F.greatest(n - tail + 1, F.lit(1)), tail)
    name = F.try_element_at(labels, F.greatest(n - tail, F.lit(1)))
    domain = (n >= 2) & (n > tail) & F.forall(labels, lambda x: x != "") & F.forall(after, lambda x: _among(x, MODEL_SUFFIXES)) & ~_among(name, MODEL_LABELS)
    segments = F.filter(F.split(c, "/"), lambda x: x != "")
    common = F.filter(segments, lambda x: _among(x, MODEL_SEGMENTS) | x.rlike(r"^[0-9]+\z"))
    narrow = c.startswith("/") & (F.size(segments) >= 2) & (F.size(common) < F.size(segments))
    return (c != "") & ~c.rlike(r"[^\x00-\x7F]") & ~domain & ~narrow
