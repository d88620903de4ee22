"""Token counts and packing against the tokenizer library itself; both must agree on every text."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from linkspark.llm import packing, token_counts, vocab

from .conftest import DOCS

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = [
    "", None, "  a  b\n\nc \t d<|endoftext|>e <|endoftext|> f", "don't  DON'T it's.x,y..z ,a .b é.è ×.÷ a b c\u3000d", "İstanbul ΣΑΣ ß ﬁ é.é , x",
    "a" * 5000 + " " + "b c " * 3000, "\n\n\n", "tab\t\tx\r\ny  ", "123,456.789 $$$ *** 1 2", "👍🏽 ok. 👍.a", "x \x1c y \x1f. z\x85q", " a", "a ", "é\u0301 x\u0301.y",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(ODD)), DOCS)


def check_packed(rows, ids):
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
    by_doc, by_seq = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == by_doc.get(r.doc_id, 0)
        by_doc[r.doc_id] = r.start + r.length
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by_seq.get(r.sequence_id, 0)
        by_seq[r.sequence_id] = r.offset + r.length
    assert max(by_seq.values()) <= 2048
    assert all(n == 2048 or n & (n - 1) == 0 for n in by_seq.values())


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_packing(which, spark, texts, docs):
    df = texts if which == "odd" else docs.select("doc_id", "text")
    t = Tokenizer.from_file(WORDS)
    ids = {r.doc_id: np.array(t.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4") for r in df.collect()}
    check_packed(packing.pack(df, WORDS, end_id=1).collect(), ids)


def test_packing_with_few_windows():
    p = packing.Packer(8, 2, 0)
    for doc, n in enumerate([5, 6, 4, 7, 3, 20, 1]):
        p.add(doc, np.arange(n, dtype="<u4"))
    p.finish(p.merge())
    sizes = {}
    for _, _, n, _, _, seq, _ in p.rows:
        sizes[seq] = sizes.get(seq, 0) + n
    assert sum(sizes.values()) == 46 and all(n == 8 or n & (n - 1) == 0 for n in sizes.values())


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_counts(which, texts, docs):
    df = texts if which == "odd" else docs.select("doc_id", "text")
    t = Tokenizer.from_file(BYTES)
    want = {r.doc_id: (len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df, BYTES).collect()} == want


@pytest.mark.parametrize("head", [0, 3, 200])
def test_counts_when_most_pretokens_are_joined(head, spark, docs, texts):
    """The equi-join beyond the broadcast head gives the same, for repeated and null ids too."""
    df = docs.select("doc_id", "text").unionByName(texts.select((texts.doc_id + 10_000).alias("doc_id"), "text"))
    df = df.unionByName(spark.createDataFrame([(None, "a bb ccc a"), (None, "a bb"), (0, "a bb")], DOCS))
    t = Tokenizer.from_file(BYTES)
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df, BYTES, head=head).collect()) == want


def test_each_pretoken_is_counted_once(docs, monkeypatch):
    found = token_counts.distinct_pretokens(docs.select("text"))
    monkeypatch.setattr(token_counts, "HELD", 50)
    small = token_counts.distinct_pretokens(docs.select("text"))
    rows = {(r.key, r.n) for r in found.collect()}
    assert rows == {(r.key, r.n) for r in small.collect()} and len({k for k, _ in rows}) == len(rows)


def test_empty_tables(texts):
    assert packing.pack(texts.limit(0), WORDS, end_id=1).count() == 0
    assert token_counts.count_tokens(texts.limit(0), BYTES).count() == 0


def test_odd_columns(odd):
    assert token_counts.count_tokens(odd.withColumnRenamed("score", "row"), BYTES, head=2).count() == odd.count()
    assert packing.pack(odd, WORDS, end_id=1).groupBy("doc_id").count().count() == 12


FOLDED = [
    "The the THE. the! The### the&&&", "H\u0331 h\u0331 J\u030cx T\u0308.W\u030a A\u0301 a\u0301 I\u0307 H\u0591\u0331", "<|ENDOFTEXT|> x", "a<|EndOfText|>B!", "<|endoftext|>A. <|startoftext|>!B",
    "a!b#c$d%e&f*g?H'S!'s A'LL!'ll #'s '.s '!re x'!S", "É!É é$$$é ß!× ×!x ÷.A", "ΑΣ! Σ.Σ A\u0338! !\u0338a =\u0338 \u212aX \u212bx!", "1!A2#b*3", "\U0001f44dA!\U0001f44d",
]


def word_ids(texts):
    column = packing.pa.array(texts, packing.pa.string())
    return [ids[a:b].tolist() for _, borders, ids in packing.document_ids(column, WORDS, 1) for a, b in zip(borders[:-1], borders[1:], strict=True)]


def test_folded_and_cut_words_are_the_librarys(monkeypatch):
    """Alone, all together, and through a table that is trimmed before every look-up."""
    t = Tokenizer.from_file(WORDS)
    r = np.random.default_rng(5)
    parts = list("aAhHsStT.,!?#$%&*'|<é É1") + ["\u0331", "\u0301", "\u0307", "'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "İ", "Σ", "\n"]
    texts = ODD + FOLDED + ["".join(r.choice(parts, k)) for k in r.integers(1, 40, 400)]
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]
    assert word_ids(texts) == want and [word_ids([x])[0] for x in texts] == want
    monkeypatch.setattr(vocab, "MAX_CHUNKS", 20)
    assert [word_ids([x])[0] for x in texts + texts[::-1]] == want + want[::-1]


def test_words_are_encoded_once(monkeypatch):
    """In whatever case, and beside whatever stop; a full table keeps what came again."""
    known = vocab.WordTable(WORDS)
    monkeypatch.setattr(packing, "table", lambda *_: known)
    word_ids(["The the THE. the! The### the&&&"])
    assert len(known.keys) == 5  # the . ! ### &&&
    monkeypatch.setattr(vocab, "MAX_CHUNKS", 8)
    word_ids(["the one two three four five"])
    new, encode = [], known._encode
    monkeypatch.setattr(known, "_encode", lambda texts: (new.extend(texts), encode(texts))[1])
    word_ids(["the one"])
    assert new == ["one"] and len(known.keys) == 2
