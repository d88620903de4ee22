"""The link code as column functions: Arrow-batched, with the pure-Python kernel behind them.

try_ functions return an error text instead of failing; the strict forms raise on the first bad row.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import codec as C

CODE = "version string, normalized_url string, payload string, short_url string, carrier string, payload_family string, normalized_length int, payload_length int, short_url_length int, error string"
_CODE = pa.struct([*((f, pa.int32() if f.endswith("_length") else pa.string()) for f in C.Code._fields), ("error", pa.string())])
DECODED = "url string, error string"
_DECODED = pa.struct([("url", pa.string()), ("error", pa.string())])
PIECES = "array<struct<type: string, text_length: int, cost_bits: int>>"
_PIECES = pa.list_(pa.struct([("type", pa.string()), ("text_length", pa.int32()), ("cost_bits", pa.int32())]))


def _utf8(text: str) -> str:
    """Lone surrogates cannot leave as UTF-8; they become U+FFFD."""
    return text.encode("utf-8", "replace").decode() if not text.isascii() else text


def try_encode_url(url: Column, version: str = "1", allow_fragment: bool = False, cjk: bool = False, origin: str = C.ORIGIN, parsing: C.Parsing = C.Parsing()) -> Column:
    """struct CODE; null urls give null, bad ones only an error."""

    @F.arrow_udf(CODE)
    def run(urls: pa.Array) -> pa.Array:
        out = []
        for u in urls.to_pylist():
            if u is None:
                out.append(None)
                continue
            try:
                out.append(C.encode(u, version, allow_fragment, cjk, origin, parsing)._asdict() | {"error": None})
            except C.CodecError as e:
                out.append({"error": str(e)})
        return pa.array(out, _CODE)

    return run(url)


def encode_url(url: Column, **options) -> Column:
    """struct CODE; raises on a bad url."""
    code = try_encode_url(url, **options)
    return F.when(code["error"].isNotNull(), F.raise_error(code["error"])).otherwise(code)


def _decoder(function) -> object:
    @F.arrow_udf(DECODED)
    def run(links: pa.Array) -> pa.Array:
        out = []
        for x in links.to_pylist():
            if x is None:
                out.append(None)
                continue
            try:
                out.append({"url": _utf8(function(x)), "error": None})
            except C.CodecError as e:
                out.append({"url": None, "error": str(e)})
        return pa.array(out, _DECODED)

    return run


def try_decode_short_url(link: Column) -> Column:
    return _decoder(C.decode)(link)


def try_decode_payload(payload: Column, version: str = "1") -> Column:
    return _decoder(lambda x: C.decode_payload(x, version))(payload)


def try_decode_canonical(link: Column) -> Column:
    return _decoder(C.decode_canonical)(link)


RESOLVED = "url string, canonical boolean, error string"
_RESOLVED = pa.struct([("url", pa.string()), ("canonical", pa.bool_()), ("error", pa.string())])


def resolve_link(link: Column) -> Column:
    """struct(url, canonical, error): what a link stands for, whether it is the canonical link of that url, and
    the canonical decoder's error text where it is not. One decoding a link."""

    @F.arrow_udf(RESOLVED)
    def run(links: pa.Array) -> pa.Array:
        out = []
        for x in links.to_pylist():
            if x is None:
                out.append(None)
                continue
            try:
                out.append({"url": _utf8(C.decode_canonical(x)), "canonical": True, "error": None})
            except C.CodecError as e:
                try:
                    out.append({"url": _utf8(C.decode(x)), "canonical": False, "error": str(e)})
                except C.CodecError:
                    out.append({"url": None, "canonical": False, "error": str(e)})
        return pa.array(out, _RESOLVED)

    return run(link)


def encode_summary(code: Column) -> Column:
    """The line that tells what a code saves."""
    ratio = F.format_string("%.2f", (code["short_url_length"] / code["normalized_length"]).cast("double"))
    return F.concat(F.lit("visible length: "), code["short_url_length"].cast("string"), F.lit("/"), code["normalized_length"].cast("string"), F.lit(" chars ("), ratio, F.lit("x)"))


def decode_short_url(link: Column) -> Column:
    d = try_decode_short_url(link)
    return F.when(d["error"].isNotNull(), F.raise_error(d["error"])).otherwise(d["url"])


def is_canonical(link: Column) -> Column:
    return try_decode_canonical(link)["error"].isNull()


def tokenize_url(url: Column, parsing: C.Parsing = C.Parsing()) -> Column:
    """Pieces of a link's normal form, in order; null where it has none."""

    @F.arrow_udf(PIECES)
    def run(urls: pa.Array) -> pa.Array:
        out = []
        for u in urls.to_pylist():
            try:
                out.append(None if u is None else [{"type": p.kind, "text_length": p.size, "cost_bits": p.cost} for p in C.parse(C.units(C.normalize(u).body), parsing)])
            except C.CodecError:
                out.append(None)
        return pa.array(out, _PIECES)

    return run(url)


def materialized(url: Column) -> Column:
    """Text that a link's pieces give back."""

    @F.arrow_udf("string")
    def run(urls: pa.Array) -> pa.Array:
        return pa.array([None if u is None else C.joined(C.materialize(C.parse(C.units(C.normalize(u).body)))) for u in urls.to_pylist()], pa.string())

    return run(url)


def register_all(spark: SparkSession) -> None:
    """SQL names: encode_url(url) and decode_url(link), both null on bad input."""

    @F.arrow_udf("string")
    def encode(urls: pa.Array) -> pa.Array:
        def one(u):
            try:
                return None if u is None else C.encode(u).short_url
            except C.CodecError:
                return None

        return pa.array([one(u) for u in urls.to_pylist()], pa.string())

    @F.arrow_udf("string")
    def decode(links: pa.Array) -> pa.Array:
        def one(x):
            try:
                return None if x is None else _utf8(C.decode(x))
            except C.CodecError:
                return None

        return pa.array([one(x) for x in links.to_pylist()], pa.string())

    spark.udf.register("encode_url", encode)
    spark.udf.register("decode_url", decode)
