"""N-best segmentation against the library's own encoding and against every segmentation of small texts."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest

from linkspark.llm import piece_lattice as L

from .conftest import DOCS

PATH = P.path("piece_bpe_32k.model")


def every_segmentation(m, whole):
    """(cost, ids) of all segmentations: pieces of the library's encoding are free at their place."""
    own, at = set(), 0
    for p in m.merged(whole):
        own.add((at, at := at + len(p)))

    def from_(i):
        if i == len(whole):
            return [(0.0, ())]
        out = []
        for j in range(i + 1, len(whole) + 1):
            if (p := whole[i:j]) in m.ids:
                out.append((m.cost[p], (m.ids[p],), j))
        if whole[i] not in m.ids:
            raw = tuple(m.byte[b] for b in whole[i].encode())
            out.append((L.FALLBACK * len(raw), raw, i + 1))
        return [((0.0 if (i, j) in own else c) + d, ids + more) for c, ids, j in out for d, more in from_(j)]

    return sorted(from_(0))


@pytest.mark.parametrize("text", ["hello", "the cat", "éa ü.", "a  b", "Orre thsh, x.", "日本 x", "x\ny  z", "$$$ a&&", "aaaaaaaa", " lead", "a.b,c. d", "ꙮ ꙮ"])
@pytest.mark.parametrize("n", [1, 4, 7])
def test_n_best_against_all_segmentations(text, n):
    known = L.ChunkTable(PATH, n)
    m = known.model
    want = every_segmentation(m, m.prepare(text))
    got = L.encode(text, known)
    assert np.allclose([-s for s, _ in got], [c for c, _ in want[:n]]) and len(got) == min(n, len(want))
    assert len({tuple(i.tolist()) for _, i in got}) == len(got) and {tuple(i.tolist()) for _, i in got} <= {i for _, i in want}
    assert all(L.decode(i, m) == m.prepare(text) and L.decode_text(i, m) == text for _, i in got)
    assert got[0][1].tolist() == m.sp.encode(text) and got[0][0] == 0


def test_merges_are_the_librarys():
    m = L.load(PATH)
    r = np.random.default_rng(3)
    for text in ["".join(r.choice(list("abcdeinorst .,é日"), k)) for k in (1, 3, 9, 40, 200)] + ["ab" * 500]:
        assert [i for p in m.merged(m.prepare(text)) for i in ([m.ids[p]] if p in m.ids else [m.byte[b] for b in p.encode()])] == m.sp.encode(text)


def test_best_is_the_librarys_encoding_of_every_text(docs):
    m = L.load(PATH)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = L.n_best_summary(docs, PATH, with_ids=True).collect()
    assert len(rows) == len(text) and all(r.segmentations[0] == m.sp.encode(text[r.doc_id]) for r in rows)
    assert all(r.decodes and r.restores and r.score == 0 and r.n_found == 4 for r in rows)


def test_every_sequence_is_assembled_and_decoded(spark, docs, odd):
    m = L.load(PATH)
    long = spark.createDataFrame([(500, "ab" * 10_000), (501, "日本語の文" * 2_000), (502, "x" * 70 + " ,.y" * 50)], DOCS)
    for df in (docs.limit(40), odd.select("doc_id", "text"), long):
        text = {r.doc_id: r.text or "" for r in df.collect()}
        for r in L.n_best_summary(df, PATH, with_ids=True).collect():
            assert [x["rank"] for x in r.n_best] == list(range(1, r.n_found + 1)) and len(set(map(tuple, r.segmentations))) == r.n_found
            assert [x.ids_crc32 for x in r.n_best] == [zlib.crc32(np.array(s, "<u4").tobytes()) for s in r.segmentations]
            assert [x.n_pieces for x in r.n_best] == list(map(len, r.segmentations))
            assert [x.score for x in r.n_best] == sorted((x.score for x in r.n_best), reverse=True)
            assert r.decodes and all(x.decodes and L.decode(s, m) == m.prepare(text[r.doc_id]) for x, s in zip(r.n_best, r.segmentations, strict=True))
            assert r.segmentations[0] == m.sp.encode(text[r.doc_id])
            assert (r.n_pieces, r.ids_crc32, r.score, r.last_score) == (r.n_best[0].n_pieces, r.n_best[0].ids_crc32, r.n_best[0].score, r.n_best[-1].score)


def test_nulls_empty_tables_and_further_columns(spark, odd):
    got = {r.doc_id: r for r in L.n_best_summary(odd.withColumnRenamed("score", "n_pieces"), PATH).collect()}
    assert got[0].n_pieces == got[1].n_pieces == 0 and got[0].n_found == got[1].n_found == 1 and got[0].ids_crc32 == 0
    assert L.n_best_summary(odd.limit(0), PATH).count() == 0


def test_a_small_table_gives_the_same(monkeypatch, docs):
    """Emptying the worker's table bounds memory and changes nothing."""
    texts = [r.text or "" for r in docs.limit(30).collect()]
    want = L.ChunkTable(PATH, 4)
    monkeypatch.setattr(L, "MAX_CHUNKS", 50)
    monkeypatch.setattr(L, "TOGETHER", 30)
    small = L.ChunkTable(PATH, 4)
    for t in texts:
        assert [(s, i.tolist()) for s, i in L.encode(t, small)] == [(s, i.tolist()) for s, i in L.encode(t, want)]


def test_lines_share_their_words():
    """Texts are cut around line feeds and before full stops, so a word is solved once wherever it stands."""
    known = L.ChunkTable(PATH, 4)
    text = "orre thsh.\nLa thsh\nLa orre \n\nLa.\n thsh"
    assert known.model.lines and L.encode(text, known)[0][1].tolist() == known.model.sp.encode(text)
    assert set(known.index) == {"▁orre", "▁thsh", ".", "\n", "La", "▁"}
    for text in ("\n", "x².", "²..,²", "\nx", "x\n", " \n ", "x \n", "a\n\n b\n", "a  \nb", "a\r\nb", "\n\n\n"):
        got = L.encode(text, known)
        assert got[0][1].tolist() == known.model.sp.encode(text) and all(L.decode_text(i, known.model) == text for _, i in got)
        assert np.allclose([-s for s, _ in got], [c for c, _ in every_segmentation(known.model, known.model.prepare(text))[:4]])


def test_a_full_table_keeps_what_came_again(monkeypatch):
    known, fresh = L.ChunkTable(PATH, 4), L.ChunkTable(PATH, 4)
    monkeypatch.setattr(L, "MAX_CHUNKS", 8)
    L.encode("the cat, the cat. once two three four five six seven", known)
    solved = []
    add = known.add
    monkeypatch.setattr(known, "add", lambda chunks, begins: (solved.extend(chunks), add(chunks, begins)))
    text = "the cat again, once"
    want = [(s, i.tolist()) for s, i in L.encode(text, fresh)]
    assert [(s, i.tolist()) for s, i in L.encode(text, known)] == want
    assert "▁the" not in solved and "▁once" in solved and len(known.index) < 8
