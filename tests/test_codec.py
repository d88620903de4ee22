"""Golden values, round trips over generated links, and errors of the link code kernel."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkspark.functions import codec as C

VIDEO = "https://youtube.com/watch?v=dQw4w9WgXcQ"
OLD = "https://link.example/0/一亼篗帘鳀囻頸搧茁铃遹旰觇殮嘿"
LINKS = [
    "https://x.com/yanorei32/status/2059594850694283362",
    "https://http://x",
    "https://example.com/a%20b?x=%23",
    "https://example.com/item/00001234567890123456",
    "https://example.com/events/2026-05-28T03:14:15.123Z/details",
    "https://example.com/status/18446744073709551615",
    "https://example.com/items/550e8400-e29b-41d4-a716-446655440000",
    "https://example.com/commit/0123456789abcdef0123456789abcdef01234567",
    "https://example.com/redirect?to=https%3A%2F%2Fexample.org%2Ffoo%3Fx%3D1",
    "https://example.com/a#frag#two",
    "https://example.com/雪",
    "https://example.com/" + "漢" * 64,
    "http://me@[::a]:80/😀",
]
TEXT = st.text(st.characters(min_codepoint=32, exclude_characters="\x7f", exclude_categories=["Cs"]), max_size=60)


def test_old_golden():
    assert C.decode(OLD) == VIDEO
    assert C.encode(VIDEO, "0", cjk=True).payload == OLD.split("/0/")[1]


def test_sizes_of_the_video_link():
    assert C.write(C.parse(C.normalize(VIDEO).body), True, "1").size == 86
    assert (len(C.encode(VIDEO, cjk=True).payload), len(C.encode(VIDEO).payload)) == (6, 14)


@pytest.mark.parametrize("link", LINKS)
@pytest.mark.parametrize("version", "01")
@pytest.mark.parametrize("cjk", [False, True])
@pytest.mark.parametrize("fragment", [False, True])
def test_round_trip(link, version, cjk, fragment):
    c = C.encode(link, version, fragment, cjk)
    assert C.decode(c.short_url) == c.normalized_url
    assert c.carrier == ("client-max" if fragment else "server-safe")
    if version == "1":
        assert C.decode_canonical(c.short_url) == c.normalized_url


@settings(max_examples=300, deadline=None)
@given(TEXT, st.sampled_from("01"), st.booleans())
def test_round_trip_of_any_text(tail, version, cjk):
    try:
        c = C.encode("https://h.example/" + tail, version, cjk=cjk)
    except C.CodecError as e:  # a run of more than 64 CJK characters cannot be written
        assert "does not fit" in str(e)
        return
    assert C.decode(c.short_url) == c.normalized_url


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_parse_is_never_dearer_than_literals(tail):
    s = C.units(tail)
    pieces = C.parse(s)
    literal = sum(6 if c in C.M.LITERALS else 13 if ord(c) < 128 else 29 for c in s)
    assert sum(p.cost for p in pieces) <= literal
    assert C.joined(C.materialize(pieces)) == tail


@pytest.mark.parametrize(
    "bad, text",
    [
        ("example.com/x", "absolute URL"),
        ("http:///x", "include a host"),
        ("http://me@/x", "after userinfo"),
        ("http://[::1/x", "bracketed"),
        ("http://a/\x07", "control characters"),
    ],
)
def test_errors(bad, text):
    with pytest.raises(C.CodecError, match=text):
        C.encode(bad)


def test_normal_form():
    assert C.normalize("HtTpS://Sub.Example.COM/Foo?A=B#Frag").url == "https://sub.example.com/Foo?A=B#Frag"
    assert C.normalize("http://U@H:x/A").url == "http://U@h:x/A"


def test_aliases_decode_but_are_not_canonical():
    alias = C.encode(VIDEO, how=C.Parsing(share=False, routes=False)).short_url
    assert C.decode(alias) == VIDEO
    with pytest.raises(C.CodecError, match="Non-canonical"):
        C.decode_canonical(alias)


def test_version_swap_and_escapes():
    with pytest.raises(C.CodecError, match="header is too large"):
        C.decode(C.encode("https://github.com/a-b/c.d/tree/dev/e-templates/quantized/rooms", cjk=True).short_url.replace("/1/", "/0/"))
    from urllib.parse import quote

    c = C.encode("https://example.com/blog/2026/05/28/how-to-build-things", cjk=True)
    assert C.decode_payload(quote(c.payload)) == c.normalized_url
    for bad in ("%zz", "%E4%B8", "a%"):
        with pytest.raises(C.CodecError, match="percent-encoded"):
            C.decode_payload(bad)


def test_packing_helps():
    link = "https://example.com/events/2026-05-28T03:14:15.123Z/details"
    assert len(C.encode(link).payload) < len(C.encode(link, how=C.Parsing(numbers=False)).payload)
    assert len(C.encode(VIDEO).payload) < len(C.encode(VIDEO, how=C.Parsing(share=False, routes=False)).payload)


@pytest.mark.parametrize(
    "link",
    [
        "https://youtube.com/watch?v=dQw4w9WgXcQ",
        "https://soundcloud.com/aphex-twin/windowlicker",
        "https://open.spotify.com/track/6rqhFgbbKwnb9MLmUQDhG6?si=abc123",
        "https://github.com/someone/some-project/issues/123",
        "https://docs.google.com/document/d/1abcdEFGhijkLMNOPqrstUVwxyz/edit?usp=sharing",
        "https://stackoverflow.com/questions/12345678/how-to-do-the-thing",
    ],
)
def test_shared_links_are_shorter_with_their_tables(link):
    c = C.encode(link, cjk=True)
    assert len(c.payload) < len(C.encode(link, cjk=True, how=C.Parsing(share=False, routes=False)).payload) and C.decode(c.short_url) == link


@pytest.mark.parametrize(
    "link, off",
    [
        ("https://example.com/blog/2026/05/28/how-to-build-things", {"numbers": False}),
        ("https://example.com/items/550e8400-e29b-41d4-a716-446655440000", {"dictionary": False}),
        ("https://example.com/redirect?to=https%3A%2F%2Fexample.org%2Ffoo%3Fx%3D1", {"dictionary": False}),
    ],
)
def test_structured_text_is_shorter(link, off):
    assert len(C.encode(link).payload) < len(C.encode(link, how=C.Parsing(**off)).payload)


def test_pieces_and_costs_of_known_texts():
    """Kinds, sizes and bits by the format's widths: the parse, not only the round trip."""
    known = {
        "youtube.com/watch?v=dQw4w9WgXcQ": [("youtube", 31, 81)],
        "550e8400-e29b-41d4-a716-446655440000": [("uuid", 36, 142)],
        "2026-05-28T03:14:15.123Z": [("datetime", 24, 58)],
        "2026/05/28": [("date", 10, 31)],
        "18446744073709551615": [("u64", 20, 76)],
        "%3A%2F%2F": [("percent", 9, 44)],
        "www.": [("dict", 4, 6)],
        "page": [("dict", 4, 13)],
        "a94a8fe5ccb19ba61c4cd873": [("hex", 24, 116)],
        "漢字仮": [("cjk", 3, 64)],
        "~~~~": [("lit", 1, 13)] + [("ref", 3, 15)],
        "ea": [("lit", 1, 6), ("lit", 1, 6)],
    }
    for text, want in known.items():
        assert [(p.kind, p.size, p.cost) for p in C.parse(C.units(text))] == want, text


def test_equal_costs_take_the_earlier_kind():
    """One literal and a run of ten cost as much as a run of eleven; the literal comes first."""
    got = [(p.kind, p.size) for p in C.parse("dQw4w9WgXcQ")]
    assert got == [("lit", 1), ("base64url", 10)]


def test_lenient_decoding():
    assert C.decode_leniently(C.encode(VIDEO).short_url) == (VIDEO, True) and C.decode_leniently(OLD) == (VIDEO, False)
    with pytest.raises(C.CodecError):
        C.decode_leniently("https://link.example/1/A")
