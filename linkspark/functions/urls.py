"""URL functions as native column expressions. No Python runs on the executors for any of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that the analyser counts as cheap, as a regular-expression class.
CHEAP = r"[A-Za-z0-9\-._/?&=:@+%#~!$'()*,;]"
# The same of the two older analysers, which have 48 cheap characters each.
CHEAP_48 = r"[a-z0-9\-._/?&=:@+,$]"
CHEAP_48_FAST = r"[a-z0-9\-._/?&=:@+%#]"
# Labels that make a country's suffix two labels long.
SECOND_LEVEL = ("co", "ac", "gov", "com", "org", "net")
# User agents that fetch previews.
PREVIEW_AGENTS = "(?i)bot|crawler|spider|facebookexternalhit|meta-externalagent|twitterbot|discordbot|slackbot|linkedinbot|telegrambot|whatsapp|embedly|quora link preview|skypeuripreview"
# Paths whose requests are no visits.
UNCOUNTED_PREFIXES = ("/api/", "/assets/", "/cdn-cgi/")
UNCOUNTED_PATHS = ("/favicon.ico", "/sw.js")


def after(text: Column, n: Column | int) -> Column:
    """text without its first n characters."""
    return text.substr(F.lit(n) + 1 if isinstance(n, int) else n + 1, F.length(text))


def compression_body(url: Column) -> Column:
    return F.when(url.startswith("https://"), after(url, 8)).otherwise(url)


def url_parts(url: Column) -> Column:
    """struct(scheme, host, path, query): text between the separators, nothing decoded or lowered."""
    at = F.instr(url, "://")
    scheme = F.when(at > 0, url.substr(F.lit(1), at - 1)).otherwise("")
    rest = F.when(at > 0, after(url, at + 2)).otherwise(url)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    visible = F.substring_index(after(rest, F.length(host)), "#", 1)
    mark = F.instr(visible, "?")
    path = F.when(mark > 0, visible.substr(F.lit(1), mark - 1)).otherwise(visible)
    query = F.when(mark > 0, after(visible, mark)).otherwise("")
    return F.struct(scheme.alias("scheme"), host.alias("host"), path.alias("path"), query.alias("query"))


def host_labels(host: Column) -> Column:
    return F.filter(F.split(host, r"\."), lambda x: x != "")


def public_suffix_len(labels: Column) -> Column:
    last, before = F.try_element_at(labels, F.lit(-1)), F.try_element_at(labels, F.lit(-2))
    two = (F.octet_length(last) == 2) & F.coalesce(before.isin(*SECOND_LEVEL), F.lit(False))
    return F.when(F.size(labels) == 0, 0).when(two, 2).otherwise(1)


def host_boundary(path: Column, query: Column) -> Column:
    return F.when(path.startswith("/"), "/").when(query != "", "?").otherwise("")


def literal_bits(text: Column, cheap: str = CHEAP) -> Column:
    """6 bits a cheap character, 13 any other."""
    return 6 * F.length(text) + 7 * F.length(F.regexp_replace(text, cheap, ""))


# ------------------------------------------------------------------ normal form

_SCHEME = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://"


def normalize_url(url: Column) -> Column:
    """struct(normalized_url, body, scheme, https_omitted, error): the parts are null where error is set."""
    raw = F.regexp_extract(url, _SCHEME, 1)
    authority = F.regexp_extract(url, _SCHEME + r"([^/?#]*)", 2)
    suffix = after(url, F.length(raw) + 3 + F.length(authority))
    user = F.regexp_extract(authority, r"(?s)^(.*@)", 1)
    rest = after(authority, F.length(user))
    bracketed = rest.startswith("[")
    close = F.instr(rest, "]")
    port = F.regexp_extract(rest, r":[0-9]+\z", 0)
    plain = F.concat(F.lower(rest.substr(F.lit(1), F.length(rest) - F.length(port))), port)
    inner = F.concat(F.lower(rest.substr(F.lit(1), close)), after(rest, close))
    scheme = F.lower(raw)
    body = F.concat(user, F.when(bracketed, inner).otherwise(plain), suffix)
    whole = F.concat(scheme, F.lit("://"), body)
    error = (
        F.when(raw == "", "Input must be an absolute URL with a scheme followed by //")
        .when(authority == "", "Input URL must include a host")
        .when(rest == "", "Input URL must include a host after userinfo")
        .when(bracketed & (close == 0), "Invalid bracketed host")
        .when(whole.rlike(r"[\x00-\x1F\x7F]"), "Input URL must not contain ASCII control characters")
    )
    ok = error.isNull() & url.isNotNull()
    secure = scheme == "https"
    return F.struct(
        F.when(ok, whole).alias("normalized_url"),
        F.when(ok, F.when(secure, body).otherwise(whole)).alias("body"),
        F.when(ok, scheme).alias("scheme"),
        F.when(ok, secure).alias("https_omitted"),
        error.alias("error"),
    )


# ------------------------------------------------------------------ payloads and requests


def is_ascii_safe_payload(payload: Column) -> Column:
    return ~payload.rlike(r"[%\x{80}-\x{10FFFF}]")


def is_cjk_payload(payload: Column) -> Column:
    return payload.rlike(r"^#?[\x{4E00}-\x{9FFF}]+\z")


def has_client_fragment(payload: Column) -> Column:
    return F.contains(payload, F.lit("#"))


def payload_surface(link: Column) -> Column:
    """struct(version, payload): what follows the first /0/ or /1/; else version 1 and everything."""
    version = F.regexp_extract(link, r"(?s)/([01])/", 1)
    found = version != ""
    start = F.least(*[F.when(F.instr(link, m) > 0, F.instr(link, m)) for m in ("/0/", "/1/")])
    return F.struct(F.when(found, version).otherwise("1").alias("version"), F.when(found, after(link, start + 2)).otherwise(link).alias("payload"))


def counts_as_visit(path: Column) -> Column:
    skip = path.isin(*UNCOUNTED_PATHS)
    for p in UNCOUNTED_PREFIXES:
        skip = skip | path.startswith(p)
    return ~skip


def is_preview_agent(agent: Column) -> Column:
    return F.coalesce(agent.rlike(PREVIEW_AGENTS), F.lit(False))


def is_static_asset(path: Column, destination: Column) -> Column:
    return path.startswith("/assets/") | F.coalesce(destination.isin("script", "style", "font", "image"), F.lit(False))


def escape_html(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def embed_page(destination: Column, service: str) -> Column:
    """The page that preview agents get: title, description and a link, all escaped."""
    title = service.replace("%", "%%")
    text = F.concat(F.lit(f"This URL was compressed using {service}, your destination: "), destination)
    page = (
        '<!doctype html><html lang="en"><head><meta charset="UTF-8" />'
        f"<title>{title} compressed URL</title>"
        '<meta name="description" content="%1$s" /><meta property="og:title" content="' + title + ' compressed URL" />'
        '<meta property="og:description" content="%1$s" /><meta property="og:type" content="website" />'
        '</head><body><p><a href="%2$s">%2$s</a></p></body></html>'
    )
    return F.format_string(page, escape_html(text), escape_html(destination))


def without_trailing_slashes(origin: Column) -> Column:
    return F.regexp_replace(origin, r"/+\z", "")


def domain_index_url(domain_index: Column, path: Column) -> Column:
    """scheme://reversed.host. and path joined to a URL; null where no label is left."""
    at = F.instr(domain_index, "://")
    host = F.reverse(F.filter(F.split(F.rtrim(after(domain_index, at + 2), F.lit(".")), r"\."), lambda x: x != ""))
    ok = (at > 0) & (F.size(host) > 0)
    return F.when(ok, F.concat(F.lower(domain_index.substr(F.lit(1), at - 1)), F.lit("://"), F.lower(F.array_join(host, ".")), path))


def url_weight(url: Column, overhead: int = 24, cap: int = 256) -> Column:
    """Share of the longest useful saving, a quarter at least; a quarter of that without path and query."""
    parts = url_parts(url)
    room = F.greatest(F.octet_length(compression_body(url)) - overhead, F.lit(0))
    weight = F.greatest(F.least(room, F.lit(cap)).cast("double") / max(cap, 1), F.lit(0.25))
    return F.when((parts["path"] == "") & (parts["query"] == ""), weight * 0.25).otherwise(weight)
