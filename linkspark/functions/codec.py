"""Kernel of the reversible link code: parse, bit code, radix, and back. Pure Python, no Spark.

Text is handled as UTF-16 units, one character of a Python string each. Bits are kept in one integer with
a count. A parse is the cheapest path through a lattice of pieces whose edges are found once for a
text; of equally cheap paths the one whose first edge was listed first wins, at every position.
"""

from __future__ import annotations

import re
from calendar import monthrange
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

from . import model as M

MAX_BITS = 64 * 1024
LEAST_REF, MOST_REF, FAR = 3, 66, 4095
HEADER = 19  # symbol, escape code, length
VIDEO_ID = 11
DATE_STYLES = ("slash", "dash", "compact")
TIME_STYLES = ("iso-z", "iso-ms-z", "slug-dash", "compact")
CODE = {"hex": 0, "uuid": 1, "percent": 2, "base64url": 3, "lower-hyphen": 4, "cjk": 5, "unit": 6, "share": 7, "youtube": 8}


class CodecError(ValueError):
    pass


class Piece(NamedTuple):
    """One edge: kind, text covered (length in units), its cost, and what the kind needs to be written."""

    kind: str
    size: int
    cost: int
    value: tuple = ()


@dataclass(frozen=True)
class Parsing:
    dictionary: bool = True
    numbers: bool = True
    references: bool = True
    share: bool = True
    routes: bool = True


def units(text: str) -> str:
    if text.isascii():
        return text
    raw = text.encode("utf-16-le", "surrogatepass")
    return "".join(chr(raw[i] | raw[i + 1] << 8) for i in range(0, len(raw), 2))


def joined(text: str) -> str:
    return text if text.isascii() else text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "surrogatepass")


# ---------------------------------------------------------------- normal form

_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*)://")
_AUTHORITY = re.compile(r"[^/?#]*")
_PORT = re.compile(r":[0-9]+\Z")
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


class Normal(NamedTuple):
    url: str
    body: str
    scheme: str
    https_omitted: bool


def host_lowered(authority: str) -> str:
    user, at, rest = authority.rpartition("@")
    if not rest:
        raise CodecError("Input URL must include a host after userinfo")
    if rest[0] == "[":
        host, bracket, port = rest.partition("]")
        if not bracket:
            raise CodecError("Invalid bracketed host")
        return user + at + host.lower() + bracket + port
    m = _PORT.search(rest)
    cut = m.start() if m else len(rest)
    return user + at + rest[:cut].lower() + rest[cut:]


def normalize(url: str) -> Normal:
    m = _SCHEME.match(url)
    if not m:
        raise CodecError("Input must be an absolute URL with a scheme followed by //")
    authority = _AUTHORITY.match(url, m.end()).group()
    if not authority:
        raise CodecError("Input URL must include a host")
    scheme = m.group(1).lower()
    rest = host_lowered(authority) + url[m.end() + len(authority) :]
    whole = f"{scheme}://{rest}"
    if _CONTROL.search(whole):
        raise CodecError("Input URL must not contain ASCII control characters")
    secure = scheme == "https"
    return Normal(whole, rest if secure else whole, scheme, secure)


# ---------------------------------------------------------------- lattice

_LITERAL = {c: i for i, c in enumerate(M.LITERALS)}


def _by_size(values: tuple[str, ...]) -> list[tuple[int, dict[str, int]]]:
    sizes: dict[int, dict[str, int]] = {}
    for i, v in enumerate(values):
        sizes.setdefault(len(v), {})[v] = i
    return sorted(sizes.items())


_DICTIONARY, _SHARED = _by_size(M.DICTIONARY), _by_size(M.SHARED)
_RUNS = re.compile("[一-鿿]{3,}")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_PERCENT = re.compile(r"(?:%[0-9a-fA-F]{2}){3,64}")
_HEX = re.compile(r"[0-9a-fA-F]{11,64}")
_WORD = re.compile(r"[A-Za-z0-9_-]{8,64}")
_SLUG = re.compile(r"[a-z-]{12,64}")
_DIGITS = re.compile(r"[0-9]{4,64}")
_ID = re.compile(r"[A-Za-z0-9_-]{11}")
_DATES = tuple(re.compile(p) for p in (r"([0-9]{4})/([0-9]{2})/([0-9]{2})", r"([0-9]{4})-([0-9]{2})-([0-9]{2})", r"([0-9]{4})([0-9]{2})([0-9]{2})"))
_TIMES = (
    ("iso-ms-z", re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})\.([0-9]{3})Z")),
    ("iso-z", re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})Z")),
    ("slug-dash", re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})-([0-9]{2})-([0-9]{2})-([0-9]{2})")),
    ("compact", re.compile(r"([0-9]{4})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})")),
)


def _hits(table: list[tuple[int, dict[str, int]]], s: str, at: int) -> list[tuple[int, int]]:
    """(index, size) of the entries that begin at a position, by index."""
    return sorted((d[p], n) for n, d in table if (p := s[at : at + n]) in d)


def _upper(digits: str) -> bool | None:
    """Whether hex digits are upper case; None if mixed."""
    high, low = digits != digits.lower(), digits != digits.upper()
    return None if high and low else high


def _decimal_bits(n: int) -> int:
    return (10**n - 1).bit_length()


def _real_day(y: int, m: int, d: int) -> bool:
    return 1970 <= y < 1970 + 256 and 1 <= m <= 12 and 1 <= d <= monthrange(y, m)[1]


def _structured(s: str, at: int):
    c = s[at]
    if (m := _RUNS.match(s, at)) is not None:
        yield Piece("cjk", len(m.group()), HEADER + 15 * len(m.group()), (m.group(),))
    if (m := _UUID.match(s, at)) and (up := _upper(m.group())) is not None:
        yield Piece("uuid", 36, 6 + 7 + 1 + 128, (m.group(), up))
    if c == "%" and (m := _PERCENT.match(s, at)) and (up := _upper(m.group())) is not None:
        yield Piece("percent", len(m.group()), HEADER + 1 + 8 * (len(m.group()) // 3), (m.group(), up))
    if (m := _HEX.match(s, at)) and (up := _upper(m.group())) is not None:
        yield Piece("hex", len(m.group()), HEADER + 1 + 4 * len(m.group()), (m.group(), up))
    if m := _WORD.match(s, at):
        yield Piece("base64url", len(m.group()), HEADER + 6 * len(m.group()), (m.group(),))
    if m := _SLUG.match(s, at):
        yield Piece("lower-hyphen", len(m.group()), HEADER + 5 * len(m.group()), (m.group(),))


def _numeric(s: str, at: int):
    if not ("0" <= s[at] <= "9"):
        return
    for style, pattern in _TIMES:
        if m := pattern.match(s, at):
            f = [int(x) for x in m.groups()] + [0] * (7 - len(m.groups()))
            if _real_day(*f[:3]) and f[3] < 24 and f[4] < 60 and f[5] < 60:
                yield Piece("datetime", len(m.group()), 48 + 10 * (style == "iso-ms-z"), (TIME_STYLES.index(style), *f))
    for style, pattern in enumerate(_DATES):
        if m := pattern.match(s, at):
            f = [int(x) for x in m.groups()]
            if _real_day(*f):
                yield Piece("date", len(m.group()), 31, (style, *f))
    if m := _DIGITS.match(s, at):
        t = m.group()
        yield Piece("num", len(t), 12 + _decimal_bits(len(t)), (int(t),))
        if 16 <= len(t) <= 20 and t[0] != "0" and int(t) < 1 << 64:
            yield Piece("u64", len(t), 76, (int(t),))


def reference_cost(offset: int, size: int) -> int:
    if offset < 16 and size - LEAST_REF < 16:
        return 15
    return 21 if offset < 256 and size - LEAST_REF < 32 else 26


def _references(s: str, at: int):
    """Longest first. Of all offsets that reach a length the smallest is never dearer, so it alone is listed."""
    head = s[at : at + LEAST_REF]
    if len(head) < LEAST_REF:
        return
    reach, found, top = LEAST_REF - 1, [], min(MOST_REF, len(s) - at)
    k = s.rfind(head, max(0, at - FAR), at + LEAST_REF - 1)
    while k >= 0 and reach < top:
        n = LEAST_REF
        while n < top and s[k + n] == s[at + n]:
            n += 1
        found += [(size, at - k) for size in range(reach + 1, n + 1)]
        reach = max(reach, n)
        k = s.rfind(head, max(0, at - FAR), k + LEAST_REF - 1)
    for size, offset in reversed(found):
        yield Piece("ref", size, reference_cost(offset, size), (offset,))


def edges(s: str, at: int, how: Parsing):
    c = s[at]
    yield Piece("lit", 1, 6 if c in _LITERAL else 13 if ord(c) < 128 else 29, (c,))
    if how.dictionary:
        for i, n in _hits(_DICTIONARY, s, at):
            yield Piece("dict", n, 6 if i < len(M.PRIMARY) else 13, (i,))
        if how.routes:
            for i, start in enumerate(M.VIDEO):
                if s.startswith(start, at) and (m := _ID.match(s, at + len(start))):
                    yield Piece("youtube", len(start) + VIDEO_ID, 81, (i, m.group()))
        if how.share:
            for i, n in _hits(_SHARED, s, at):
                yield Piece("share", n, 26, (i,))
        yield from _structured(s, at)
    if how.numbers:
        yield from _numeric(s, at)
    if how.references:
        yield from _references(s, at)


def parse(body: str, how: Parsing = Parsing()) -> list[Piece]:
    """The cheapest pieces of a text in UTF-16 units."""
    n = len(body)
    cost, choice = [0] * n + [6], [None] * n
    for at in range(n - 1, -1, -1):
        best = None
        for e in edges(body, at, how):
            c = e.cost + cost[at + e.size]
            if best is None or c < best:
                best, choice[at] = c, e
        cost[at] = best
    out, at = [], 0
    while at < n:
        out.append(choice[at])
        at += choice[at].size
    return out


# ---------------------------------------------------------------- bits


@dataclass
class Bits:
    value: int = 0
    size: int = 0

    def put(self, value: int, width: int) -> None:
        if value < 0 or value >> width:
            raise CodecError(f"Value {value} does not fit in {width} bits")
        self.value, self.size = self.value << width | value, self.size + width


@dataclass
class Reader:
    value: int
    size: int
    at: int = field(default=0)

    def take(self, width: int) -> int:
        if self.at + width > self.size:
            raise CodecError("Unexpected end of bitstream")
        self.at += width
        return self.value >> (self.size - self.at) & ((1 << width) - 1)


def _symbol_order() -> tuple[int, ...]:
    """Symbols by rank in version 1: the first 16 take 5 bits, the next 6, then 7 and 7."""
    lits, first = list(range(len(M.LITERALS))), len(M.LITERALS)
    front = [M.EXTENSION, M.NUMBER, M.ESCAPE, M.END, M.REFERENCE, *lits[:11], first, *lits[13:28], first + 1]
    return tuple(front + [x for x in range(M.SYMBOLS) if x not in front])


_ORDER = _symbol_order()
_RANK = {s: r for r, s in enumerate(_ORDER)}


def _put_symbol(out: Bits, symbol: int, version: str) -> None:
    if version == "0":
        out.put(symbol, 6)
        return
    tier, low = divmod(_RANK[symbol], 16)
    out.put((0, 0b10, 0b110, 0b111)[tier], (1, 2, 3, 3)[tier])
    out.put(low, 4)


def _take_symbol(r: Reader, version: str) -> int:
    if version == "0":
        return r.take(6)
    tier = 0
    while tier < 3 and r.take(1):
        tier += 1
    return _ORDER[16 * tier + r.take(4)]


def _put_text(out: Bits, text: str, alphabet: str, width: int) -> None:
    for c in text:
        out.put(alphabet.index(c), width)


def write(pieces: list[Piece], https_omitted: bool, version: str) -> Bits:
    out = Bits()
    out.put(0 if https_omitted else 1, 1)
    for p in pieces:
        kind, v = p.kind, p.value
        if kind == "lit":
            known = _LITERAL.get(v[0])
            if known is not None:
                _put_symbol(out, known, version)
                continue
            _put_symbol(out, M.ESCAPE, version)
            if ord(v[0]) < 128:
                out.put(ord(v[0]), 7)
            else:
                out.put(CODE["unit"], 7)
                out.put(ord(v[0]), 16)
        elif kind == "dict":
            near = v[0] < len(M.PRIMARY)
            _put_symbol(out, len(M.LITERALS) + v[0] if near else M.EXTENSION, version)
            if not near:
                out.put(v[0] - len(M.PRIMARY), 7)
        elif kind == "ref":
            _put_symbol(out, M.REFERENCE, version)
            tier = (15, 21, 26).index(reference_cost(v[0], p.size))
            out.put((0, 0b10, 0b11)[tier], (1, 2, 2)[tier])
            out.put(v[0], (4, 8, 12)[tier])
            out.put(p.size - LEAST_REF, (4, 5, 6)[tier])
        elif kind in ("num", "u64", "date", "datetime"):
            _put_symbol(out, M.NUMBER, version)
            out.put({"date": 0, "datetime": 1, "u64": 2}.get(kind, p.size - 1), 6)
            if kind == "num":
                out.put(v[0], _decimal_bits(p.size))
            elif kind == "u64":
                out.put(v[0], 64)
            else:
                for x, w in zip((v[0], v[1] - 1970, *v[2:]), (2, 8, 4, 5, 5, 6, 6, 10), strict=False):
                    if w < 10 or v[0] == TIME_STYLES.index("iso-ms-z"):
                        out.put(x, w)
        else:
            _put_symbol(out, M.ESCAPE, version)
            out.put(CODE[kind], 7)
            if kind == "share":
                out.put(v[0], 7)
            elif kind == "youtube":
                out.put(v[0], 2)
                _put_text(out, v[1], M.WORDS64, 6)
            elif kind == "uuid":
                out.put(int(v[1]), 1)
                out.put(int(v[0].replace("-", ""), 16), 128)
            elif kind == "percent":
                digits = v[0].replace("%", "")
                out.put(len(digits) // 2 - 1, 6)
                out.put(int(v[1]), 1)
                out.put(int(digits, 16), 4 * len(digits))
            elif kind == "hex":
                out.put(len(v[0]) - 1, 6)
                out.put(int(v[1]), 1)
                out.put(int(v[0], 16), 4 * len(v[0]))
            else:
                out.put(len(v[0]) - 1, 6)
                if kind == "cjk":
                    for c in v[0]:
                        out.put(ord(c) - M.CJK_FIRST, 15)
                else:
                    _put_text(out, v[0], *((M.WORDS64, 6) if kind == "base64url" else (M.LOWER27, 5)))
    _put_symbol(out, M.END, version)
    return out


def _take_text(r: Reader, n: int, alphabet: str, width: int) -> str:
    out = []
    for _ in range(n):
        i = r.take(width)
        if i >= len(alphabet):
            raise CodecError("Invalid structured alphabet index")
        out.append(alphabet[i])
    return "".join(out)


def _cased(digits: str, upper: int) -> str:
    return digits.upper() if upper else digits


def _read_escape(r: Reader, version: str) -> str:
    code = r.take(7)
    if code == CODE["hex"]:
        n, up = r.take(6) + 1, r.take(1)
        return _cased(f"{r.take(4 * n):0{n}x}", up)
    if code == CODE["uuid"]:
        up = r.take(1)
        h = _cased(f"{r.take(128):032x}", up)
        return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))
    if code == CODE["percent"]:
        n, up = r.take(6) + 1, r.take(1)
        h = _cased(f"{r.take(8 * n):0{2 * n}x}", up)
        return "".join("%" + h[i : i + 2] for i in range(0, 2 * n, 2))
    if code == CODE["base64url"]:
        return _take_text(r, r.take(6) + 1, M.WORDS64, 6)
    if code == CODE["lower-hyphen"]:
        return _take_text(r, r.take(6) + 1, M.LOWER27, 5)
    if code == CODE["cjk"]:
        out = []
        for _ in range(r.take(6) + 1):
            i = r.take(15)
            if i >= M.CJK_SIZE:
                raise CodecError("Invalid structured alphabet index")
            out.append(chr(M.CJK_FIRST + i))
        return "".join(out)
    if code == CODE["unit"]:
        return chr(r.take(16))
    if version == "1" and code == CODE["youtube"]:
        return M.VIDEO[r.take(2)] + _take_text(r, VIDEO_ID, M.WORDS64, 6)
    if version == "1" and code == CODE["share"]:
        i = r.take(7)
        if i >= len(M.SHARED):
            raise CodecError("Invalid share dictionary index")
        return M.SHARED[i]
    return chr(code)


def _read_number(r: Reader) -> str:
    code = r.take(6)
    if code == 2:
        return str(r.take(64))
    if code > 2:
        n = code + 1
        return str(r.take(_decimal_bits(n))).zfill(n)
    style = r.take(2)
    if code == 0 and style >= len(DATE_STYLES):
        raise CodecError("Invalid date format")
    y, m, d = r.take(8) + 1970, r.take(4), r.take(5)
    if code == 0:
        gap = ("/", "-", "")[style]
        return f"{y:04d}{gap}{m:02d}{gap}{d:02d}"
    h, i, s = r.take(5), r.take(6), r.take(6)
    name = TIME_STYLES[style]
    if name == "iso-z":
        return f"{y:04d}-{m:02d}-{d:02d}T{h:02d}:{i:02d}:{s:02d}Z"
    if name == "iso-ms-z":
        return f"{y:04d}-{m:02d}-{d:02d}T{h:02d}:{i:02d}:{s:02d}.{r.take(10):03d}Z"
    gap = "-" if name == "slug-dash" else ""
    return gap.join((f"{y:04d}", f"{m:02d}", f"{d:02d}", f"{h:02d}", f"{i:02d}", f"{s:02d}"))


def read(bits: Bits, version: str) -> tuple[bool, str]:
    """(https omitted, body in UTF-16 units)."""
    r = Reader(bits.value, bits.size)
    omitted, body = r.take(1) == 0, ""
    while r.at < r.size:
        s = _take_symbol(r, version)
        if s < len(M.LITERALS):
            body += M.LITERALS[s]
        elif s < M.ESCAPE:
            body += M.PRIMARY[s - len(M.LITERALS)]
        elif s == M.ESCAPE:
            body += _read_escape(r, version)
        elif s == M.NUMBER:
            body += _read_number(r)
        elif s == M.REFERENCE:
            tier = 0 if not r.take(1) else 1 + r.take(1)
            offset, size = r.take((4, 8, 12)[tier]), r.take((4, 5, 6)[tier]) + LEAST_REF
            if not 1 <= offset <= len(body):
                raise CodecError(f"Invalid reference offset: {offset}")
            for _ in range(size):
                body += body[-offset]
        elif s == M.EXTENSION:
            i = r.take(7)
            if i >= len(M.EXTENDED):
                raise CodecError("Invalid extended dictionary index")
            body += M.EXTENDED[i]
        elif s == M.END:
            return omitted, body
    raise CodecError("Missing end token")


# ---------------------------------------------------------------- radix


@lru_cache(maxsize=4)
def _digits(alphabet: str) -> dict[str, int]:
    return {c: i for i, c in enumerate(alphabet)}


CJK = "".join(chr(M.CJK_FIRST + i) for i in range(M.CJK_SIZE))


def _in_base(value: int, alphabet: str) -> str:
    base, out = len(alphabet), []
    while True:
        value, d = divmod(value, base)
        out.append(alphabet[d])
        if not value:
            return "".join(reversed(out))


def to_radix(bits: Bits, alphabet: str, version: str) -> str:
    if version == "1":
        return _in_base(1 << bits.size | bits.value, alphabet)
    base = len(alphabet)
    if bits.size >= base * base:
        raise CodecError(f"Payload too large for its bit-length header: {bits.size} bits")
    return alphabet[bits.size // base] + alphabet[bits.size % base] + _in_base(bits.value, alphabet)


def from_radix(text: str, alphabet: str, version: str) -> Bits:
    digit, base, size = _digits(alphabet), len(alphabet), None
    if version == "0":
        if len(text) < 2 or text[0] not in digit or text[1] not in digit:
            raise CodecError("Invalid radix bit-length header")
        size = digit[text[0]] * base + digit[text[1]]
        if size > MAX_BITS:
            raise CodecError(f"Radix bit-length header is too large: {size} bits")
        text = text[2:]
    value = 0
    for c in text:
        if c not in digit:
            raise CodecError(f"Invalid radix digit: {c}")
        value = value * base + digit[c]
    length = max(1, value.bit_length())
    if version == "0":
        if length > size:
            raise CodecError("Radix payload has more bits than declared")
        return Bits(value, size)
    if length - 1 > MAX_BITS:
        raise CodecError(f"Terminated radix payload is too large: {length - 1} bits")
    if not value:
        raise CodecError("Missing terminated radix sentinel")
    return Bits(value - (1 << length - 1), length - 1)


# ---------------------------------------------------------------- links

ORIGIN = "https://link.example"
_MARK = re.compile(r"/([01])/")
_ESCAPED = re.compile(r"%(?:[0-9A-Fa-f]{2})?")


class Code(NamedTuple):
    version: str
    normalized_url: str
    payload: str
    short_url: str
    carrier: str
    payload_family: str
    normalized_length: int
    payload_length: int
    short_url_length: int


def encode(url: str, version: str = "1", allow_fragment: bool = False, cjk: bool = False, origin: str = ORIGIN, how: Parsing = Parsing()) -> Code:
    n = normalize(url)
    if version == "0":
        how = Parsing(how.dictionary, how.numbers, how.references, False, False)
    bits = write(parse(units(n.body), how), n.https_omitted, version)
    payload = to_radix(bits, CJK if cjk else M.CLIENT if allow_fragment else M.SERVER, version)
    payload = "#" + payload if allow_fragment else payload
    short = f"{origin.rstrip('/')}/{version}/{payload}"
    length = lambda s: len(units(s))
    return Code(version, n.url, payload, short, "client-max" if "#" in payload else "server-safe", "unicode-cjk" if cjk else "ascii-safe", length(n.url), length(payload), length(short))


def surface_of(link: str) -> tuple[str, str]:
    """(version, payload) of a short link or bare payload."""
    m = _MARK.search(link)
    return (m.group(1), link[m.end() :]) if m else ("1", link)


def unescaped(payload: str) -> str:
    """Percent escapes decoded strictly."""
    if "%" not in payload:
        return payload
    try:
        raw = _ESCAPED.sub(lambda m: m.group() if len(m.group()) == 3 else "%!", payload)
        if "%!" in raw:
            raise ValueError
        return re.sub(r"(?:%[0-9A-Fa-f]{2})+", lambda m: bytes.fromhex(m.group().replace("%", "")).decode("utf-8"), payload)
    except ValueError:
        raise CodecError("Invalid percent-encoded payload surface") from None


def is_ascii_safe(payload: str) -> bool:
    return payload.isascii() and "%" not in payload


def is_cjk(payload: str) -> bool:
    body = payload[1:] if payload.startswith("#") else payload
    return bool(body) and all(0 <= ord(c) - M.CJK_FIRST < M.CJK_SIZE for c in body)


def decode_payload(payload: str, version: str = "1") -> str:
    surface = unescaped(payload)
    client = surface.startswith("#")
    if is_ascii_safe(surface):
        alphabet = M.CLIENT if client else M.SERVER
    elif is_cjk(surface):
        alphabet = CJK
    else:
        raise CodecError("Payload selects an unsupported Unicode codec")
    if version not in M.VERSIONS:
        raise CodecError(f"Unsupported payload version: {version}")
    omitted, body = read(from_radix(surface[1:] if client else surface, alphabet, version), version)
    return ("https://" if omitted else "") + joined(body)


def decode(link: str) -> str:
    version, payload = surface_of(link)
    return decode_payload(payload, version)


def decode_canonical(link: str) -> str:
    version, payload = surface_of(link)
    url = decode_payload(payload, version)
    surface = unescaped(payload)
    if version != "1" or encode(url, allow_fragment="#" in surface, cjk=is_cjk(surface)).payload != surface:
        raise CodecError("Non-canonical short URL payload")
    return url


def decode_leniently(link: str) -> tuple[str, bool]:
    """(url, whether the link is the canonical one of that url)."""
    try:
        return decode_canonical(link), True
    except CodecError:
        return decode(link), False


def materialize(pieces: list[Piece], seed: str = "") -> str:
    """Text of a piece sequence, by the kinds' own values; references copy from what is already there."""
    out = seed
    for p in pieces:
        v = p.value
        if p.kind == "ref":
            for _ in range(p.size):
                out += out[-v[0]]
        elif p.kind == "dict":
            out += M.DICTIONARY[v[0]]
        elif p.kind == "share":
            out += M.SHARED[v[0]]
        elif p.kind == "youtube":
            out += M.VIDEO[v[0]] + v[1]
        elif p.kind in ("num", "u64"):
            out += str(v[0]).zfill(p.size)
        elif p.kind in ("date", "datetime"):
            b = write([p], True, "0")
            r = Reader(b.value, b.size, 7)
            out += _read_number(r)
        else:
            out += v[0]
    return out
