"""Near duplicates and repeated passages against plain versions."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import helpers as h

from basalt.llm import components, ngram_jaccard, sketch, substring_dedup
from basalt.llm.textkernel import chunks, word_hashes, word_spans

COLUMNS = "doc_id long, text string, d1 string, component_id long, n string, tokens string, at string"


def frame(spark, docs, parts=3):
    """Documents with further columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, "x", -1, "x", "x", "x") for i, t in docs], COLUMNS).repartition(parts)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    bases = [h.text_of(rng, n) for n in (300, 120, 60, 800, 51, 50)]
    docs = [*bases]
    docs += [h.edited(rng, bases[0], n) for n in (1, 3, 6, 8, 9, 10, 12, 20, 40)]
    docs += [h.edited(rng, bases[1], n) for n in (1, 2, 3, 4, 5) for _ in range(4)]
    docs += [bases[0], bases[1], bases[1].upper(), bases[5], bases[5]]
    passage = h.text_of(rng, 55)
    docs += [h.text_of(rng, 80) + " " + passage + "\n" + h.text_of(rng, 30) for _ in range(8)]
    docs += [" ".join(["from"] * 120), " ".join(["from"] * 120) + " to", "a b c d", "A  b\tc d", "a b c d e", "e d c b a", "one", "one", "", " \n\t", None]
    docs += [h.text_of(rng, 20_000)]
    return list(enumerate(docs))


def test_jaccard(spark, corpus):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(frame(spark, corpus)).collect()}
    assert got == h.components(corpus)


def test_jaccard_of_many_near_copies(spark):
    """More copies than the frequent class needs, so that combinations of two tokens are what finds them."""
    rng = np.random.default_rng(6)
    base = h.text_of(rng, 60)
    docs = list(enumerate([h.edited(rng, base, int(n)) for n in rng.integers(0, 5, 600)]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(frame(spark, docs, 5)).collect()}
    assert got == h.components(docs)


def test_pairs_of_near_copies_are_made_once(spark, monkeypatch):
    """A few hundred entries with much the same unlinked members: their pairs are compared once a cluster, not once an entry."""
    for name, value in (("PAIRS", 32), ("LARGE", 48), ("TILE", 40)):
        monkeypatch.setattr(ngram_jaccard, name, value, raising=False)
    rng = np.random.default_rng(8)
    base = h.text_of(rng, 130)
    docs = list(enumerate([h.edited(rng, base, int(n)) for n in rng.integers(0, 9, 300)]))
    written, write = {}, ngram_jaccard.materialize

    def kept(df, name):
        written.setdefault(name, []).append(out := write(df, name))
        return out

    monkeypatch.setattr(ngram_jaccard, "materialize", kept)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(frame(spark, docs, 5)).collect()}
    assert got == h.components(docs) and len({c for _, c in got.values()}) > 20
    (index,), (left,) = written["index"], written["open"]
    of_entries = sum(r["count"] ** 2 for r in index.groupBy("sig").count().collect())
    assert of_entries > 20 * len(docs) ** 2  # entries hold the same pairs over and over
    assert sum(r["count"] ** 2 for r in left.groupBy("sig").count().collect()) < 4 * len(docs) ** 2


def test_jaccard_edges(spark):
    docs = frame(spark, [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, ""), (1, None)])
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(docs).collect()), key=repr)
    assert got == sorted([(3, 2, 3), (3, 2, 3), (None, 2, 3), (None, 0, None), (1, 0, 1)], key=repr)
    assert ngram_jaccard.jaccard_components(frame(spark, [(1, "a")]).filter("doc_id > 1")).count() == 0


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (9, 8), (8, 2), (20, 21), (30, 30)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 8: 2, 9: 2, 20: 20, 21: 20}


def test_repeats(spark, corpus):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(frame(spark, corpus)).collect()}
    assert got == h.without_repeats(corpus)


def test_repeats_edges(spark):
    rng = np.random.default_rng(7)
    text = h.text_of(rng, 70)
    docs = frame(spark, [(4, text), (4, text), (2, "x " + text), (None, text), (None, None)])
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs).collect()), key=repr)
    assert got == sorted([(4, 70, 70), (4, 70, 70), (2, 71, 0), (None, 70, 0), (None, 0, 0)], key=repr)
    assert substring_dedup.remove_repeats(frame(spark, [(1, "a")]).filter("doc_id > 1")).count() == 0


def _morse(doublings):
    a, b = "a", "b"
    for _ in range(doublings):
        a, b = a + b, b + a
    return a, b


def test_word_hashes():
    import pyarrow as pa

    words = ["a", "ab", "abcdefgh", "abcdefghi", "b" * 255, "b" * 256, "b" * 257, "é" * 40, *_morse(10), *_morse(11), *(f"w{i}" for i in range(20_000))]
    for kind in (0, 1):
        ((_, _, data, offsets),) = chunks(pa.array([" ".join(words + words)]), 1 << 30)
        starts, ends, _ = word_spans(data, offsets)
        h = word_hashes(data, starts, ends, kind)
        assert (h[: len(words)] == h[len(words) :]).all() and len(np.unique(h)) == len(set(words))


def test_repeats_of_words_that_a_polynomial_confuses(spark):
    rng = np.random.default_rng(12)
    around = [h.text_of(rng, 30), h.text_of(rng, 30)]
    docs = [(i, f"{around[0]} {w} {around[1]}") for i, w in enumerate((*_morse(10), *_morse(11)))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(frame(spark, docs)).collect()}
    assert got == h.without_repeats(docs) and all(removed == 0 for _, removed, _ in got.values())


def test_repeats_looked_up_in_a_shuffle(spark, corpus, monkeypatch):
    """The sketch in slices that are not broadcast, and windows of frequent anchors dealt out."""
    monkeypatch.setattr(sketch, "MAX_BITS", 10)
    monkeypatch.setattr(sketch, "SLICE_BITS", 8)
    monkeypatch.setattr(sketch, "HOT_PART", 64)
    monkeypatch.setattr(substring_dedup, "SALT_LEVEL", 2)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(frame(spark, corpus)).collect()}
    assert got == h.without_repeats(corpus)


def test_sketch_tells_as_much_at_any_size(spark, monkeypatch):
    """Tenfold data, no more keys taken for repeated; slices are what grows."""
    monkeypatch.setattr(sketch, "SLICE_BITS", 8)

    def keys(batch):
        for x in batch.column("text").to_pylist():
            yield np.array(x.split(" "), np.uint64)

    shares, slices = [], []
    for n in (20_000, 200_000):
        rng = np.random.default_rng(n)
        own = [rng.integers(1 << 62, 1 << 63, n // 20).astype(np.uint64) for _ in range(20)]
        texts = spark.createDataFrame([(" ".join(map(str, x)),) for x in own], "text string").repartition(4)
        built = sketch.build(texts, keys, 2, 20.0)
        ok, _ = built.lookup().seen(np.concatenate(own))
        shares.append(ok.mean())
        slices.append(built.slices.select("slice").distinct().count())
    assert max(shares) < 0.06 and slices[1] >= 8 * slices[0]


def test_counts_past_32_bits():
    packed, extra = sketch._pack(np.array([3, 4])), sketch._pack(np.array([0, (1 << 32) - 1]))
    counts = sketch._counted(iter([(packed, extra)] * 3), 16)
    assert counts[3] == 3 * (1 << 32) and counts[7] == 3 and counts.sum() == counts[3] + counts[7]


def _by_hand(spark, docs, parts=3):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(frame(spark, docs, parts)).collect()}


def test_jaccard_of_combinations(spark, monkeypatch):
    """Low counts for twos and threes, small groups: everything links through combinations."""
    monkeypatch.setattr(ngram_jaccard, "PAIRS", 4)
    monkeypatch.setattr(ngram_jaccard, "TRIPLES", 16)
    monkeypatch.setattr(ngram_jaccard, "GROUP", 6)
    rng = np.random.default_rng(16)
    docs = []
    for size in (7, 9, 14, 30, 75, 140):
        base = h.text_of(rng, size)
        docs += [base if i == 0 else h.edited(rng, base, int(rng.integers(0, max(2, size // 16)))) for i in range(40)]
        docs += [" ".join(h.edited(rng, base, 1).split(" ")[: -max(1, size // 12)]) for _ in range(20)]
    passages = [h.text_of(rng, 12) for _ in range(9)]
    docs += [" ".join(passages[int(i)] for i in rng.choice(9, int(n))) for n in rng.integers(1, 9, 80)]
    docs = list(enumerate(docs))
    assert _by_hand(spark, docs, 5) == h.components(docs)


def test_jaccard_with_a_full_sketch(spark, corpus, monkeypatch):
    """A sketch too small for its keys leaves all to the exact count; hot shingles are dealt out."""
    monkeypatch.setattr(sketch, "MAX_BITS", 6)
    monkeypatch.setattr(sketch, "HOT_LEAST", 400)
    assert _by_hand(spark, corpus) == h.components(corpus)


def test_combinations_lose_no_pair():
    """Sets that reach the similarity share a signature, whatever their classes."""
    rng = np.random.default_rng(17)
    for trial in range(400):
        n = int(rng.integers(1, 120))
        universe = rng.integers(0, 1 << 63, 400).astype(np.uint64)
        three = rng.random(400) < rng.random()
        x = rng.choice(400, n, replace=False)
        y = np.union1d(rng.choice(x, n - int(rng.integers(0, n // 7 + 1)), replace=False), rng.choice(400, int(rng.integers(0, n // 7 + 1))))
        shared = len(np.intersect1d(x, y))
        if 100 * shared < 75 * (len(x) + len(y) - shared):
            continue
        sigs = []
        for z in (x, y):
            z = z[np.lexsort((universe[z], three[z]))]
            parts = [(np.zeros(len(z), np.int64), np.full(len(z), p), universe[z], three[z]) for p in ngram_jaccard._powers(len(z), 75)]
            sigs.append(ngram_jaccard.combinations(*(np.concatenate(c) for c in zip(*parts, strict=True)), 75)[0])
        assert len(np.intersect1d(*sigs)), trial


def test_marks_bound_the_intersection():
    """Marks never allow less than two sets share, and tell unlike sets of some hundred shingles apart."""
    rng = np.random.default_rng(18)
    for size in (1, 5, 60, 300, 900, 4000):
        for _ in range(40):
            universe = rng.integers(0, 1 << 63, 3 * size).astype(np.uint64)
            x, y = (universe[rng.permutation(3 * size)[: int(rng.integers(1, size + 1))]] for _ in range(2))
            apart = sum(int(v).bit_count() for v in (ngram_jaccard.marks_of(x) ^ ngram_jaccard.marks_of(y)).view(np.uint64))
            assert (len(x) + len(y) - apart) // 2 >= len(np.intersect1d(x, y))
    x, y = (rng.integers(0, 1 << 63, 400).astype(np.uint64) for _ in range(2))
    apart = sum(int(v).bit_count() for v in (ngram_jaccard.marks_of(x) ^ ngram_jaccard.marks_of(y)).view(np.uint64))
    assert (800 - apart) * 175 < 150 * 800


def test_jaccard_of_unlinked_documents_that_share_a_rare_passage(spark):
    """Many documents with one passage in common and nothing else, some with near copies: entries of many components."""
    rng = np.random.default_rng(19)
    passage = h.text_of(rng, 40)
    docs = [h.text_of(rng, int(n)) + " " + passage for n in rng.integers(20, 200, 120)]
    docs += [h.edited(rng, docs[int(i)], 2) for i in rng.integers(0, 120, 40)]
    docs = list(enumerate(docs))
    assert _by_hand(spark, docs, 5) == h.components(docs)


def test_jaccard_of_long_near_copies(spark):
    rng = np.random.default_rng(18)
    base, long = h.text_of(rng, 2000), h.text_of(rng, 20_000)
    docs = list(enumerate([h.edited(rng, base, int(n)) for n in rng.integers(0, 60, 300)] + [h.edited(rng, long, int(n)) for n in rng.integers(0, 500, 8)]))
    assert _by_hand(spark, docs, 6) == h.components(docs)
