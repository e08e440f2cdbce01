"""Decontamination, spelling variants and collocations against plain versions."""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from basalt.llm import collocations, decontamination, spelling

sys.path.insert(0, str(Path(__file__).resolve().parent))
from helpers import LOWER, UPPER

LOWERED = str.maketrans(UPPER, LOWER)


def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- decontamination


def _item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWERED))


def _plain_hits(docs, items, size=10):
    out = []
    for i, text in docs:
        w, hit, names = _item_words(text), set(), set()
        for name, item in items:
            q = _item_words(item)
            n = min(size, len(q))
            for o in range(len(q) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == q[o : o + n]:
                        hit |= set(range(p, p + n))
                        names |= {str(name)} if name is not None else set()
        out.append((i, len(w), sorted(hit), sorted(names)))
    return sorted(out, key=repr)


def _hits(found):
    rows = [(r["doc_id"], r["n_words"], [q for s in r["spans"] for q in range(s["start"], s["end"])], list(r["items"])) for r in found.collect()]
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def leaks():
    rng = np.random.default_rng(3)
    draw = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 6, n))
    items = [(k, draw(int(rng.integers(10, 30)))) for k in range(12)]
    items += [(12, "Only three words"), (13, ""), (None, "nameless item here"), (7, "a second text of item seven"), (14, None), (100, "é" * 3 + " ß 東京")]
    docs = [(k, draw(int(rng.integers(0, 60)))) for k in range(40)]
    docs += [(50, f"before {items[3][1]} after {items[3][1]}"), (51, "ONLY-three,words! only three"), (52, None), (53, ""), (None, items[5][1]), (54, "nameless item here"), (54, "nameless item here"), (55, "w1 " * 30_000 + items[2][1]), (56, "ééé ß 東京 x")]
    return docs, items


def test_phrases_equal_a_plain_search(spark, leaks, monkeypatch):
    docs, items = leaks
    frame = _frame(spark, [(i, t, "x") for i, t in docs], "doc_id long, text string, items string")
    tests = _frame(spark, items, "item_id long, text string")
    short = [d for d in docs if d[0] != 55]
    found = _hits(decontamination.phrases(decontamination.build_index(frame), tests))
    assert [r for r in found if r[0] != 55] == _plain_hits(short, items)
    long = next(r for r in found if r[0] == 55)
    assert "2" in long[3] and 30_005 in long[2]
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 100)  # many blocks of items, small rounds of candidates
    monkeypatch.setattr(decontamination, "CANDIDATES", 50)
    assert _hits(decontamination.phrases(decontamination.build_index(frame), tests)) == found
    none = decontamination.phrases(decontamination.build_index(frame), tests.limit(0))
    assert none.count() == len(docs) and none.filter("size(spans) + size(items) > 0").count() == 0
    assert decontamination.phrases(decontamination.build_index(frame.limit(0)), tests).count() == 0


def test_near_matches(spark):
    docs = [(1, "red x blue y green"), (2, "green blue red"), (3, "red a b c d e blue green"), (4, "red blue"), (5, "blue red red green z z red blue green"), (6, None)]
    items = [(1, "green red blue"), (2, "red red blue")]

    def plain(text, item, within):
        w, need = _item_words(text), set(_item_words(item))
        out = set()
        for p in range(len(w)):
            part = w[p : p + within]
            if w[p] in need and need <= set(part):
                out |= set(range(p, p + len(part)))
        return out

    index = decontamination.build_index(_frame(spark, docs, "doc_id long, text string"))
    for within in (3, 5):
        got = {r["doc_id"]: (sorted(q for s in r["spans"] for q in range(s["start"], s["end"])), r["items"]) for r in decontamination.near(index, _frame(spark, items, "item_id long, text string"), within).collect()}
        for i, text in docs:
            sets = {k: plain(text, t, within) for k, t in items}
            assert got[i] == (sorted(set().union(*sets.values())), [str(k) for k in sorted(sets) if sets[k]])


# --- spelling


def _apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_fm_index_finds_all_pairs():
    rng = np.random.default_rng(5)
    for alphabet in ("ab", "aé", "abcdefgh"):
        for longest in (4, 9, 40):
            words = sorted({"".join(rng.choice(list(alphabet), int(rng.integers(1, longest)))) for _ in range(60)})
            got = set()
            for rightwards in (False, True):
                for who, other in spelling.near_pairs(words, np.ones(len(words), bool), rightwards):
                    got |= set(zip(who.tolist(), other.tolist(), strict=True))
            assert got == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if _apart(a, b)}


def _plain_words(docs):
    total = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWERED)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def test_variants_equal_a_plain_search(spark):
    rng = np.random.default_rng(8)
    stems = ["separate", "occurrence", "définition", "münchen", "Straßenbahn", "aaaaaaaa", "×÷straight"]
    docs = []
    for i in range(60):
        words = []
        for _ in range(60):
            w = stems[int(rng.integers(0, len(stems)))]
            if rng.random() < 0.3:
                p = int(rng.integers(0, len(w)))
                w = w[:p] + str(rng.choice(["", "a", "é", w[p] * 2])) + w[p + 1 :]
            words.append(w)
        docs.append((i, " ".join(words)))
    docs += [(None, "separate separate"), (99, None), (98, ""), (97, "x" * 3000 + " " + "x" * 2999 + "y " + "x" * 3000 + " " + "x" * 2999 + "y"), (5, "separate"), (5, "separate")]
    words = _plain_words(docs)
    frame = _frame(spark, [(i, t, 1) for i, t in docs], "doc_id long, text string, n int")
    got = {r["word"]: tuple(r)[1:] for r in spelling.group_variants(spelling.vocabulary(frame)).collect()}
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and _apart(w, v)] for w in words}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    want = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        want[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    assert got == want and any(f for f in form.values())


def test_a_hot_half_is_split(spark):
    """Many words of one left half: their texts are dealt out, no pair is lost and none comes twice."""
    words = [(f"prefixes{a}{b}{c}", 2) for a in "abcdefg" for b in "abcdefg" for c in "abcdefg"]
    got = [(r["word"], r["other"]) for r in spelling.near_words(_frame(spark, words, "word string, n long"), shard_rows=200).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, _ in words for b, _ in words if a != b and _apart(a, b)}


def test_empty_vocabulary(spark):
    empty = _frame(spark, [], "doc_id long, text string")
    assert spelling.group_variants(spelling.vocabulary(empty)).count() == 0


# --- collocations


def _plain_phrases(docs, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWERED)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for p in range(len(w) - k + 1):
                    f[lang][tuple(w[p : p + k])] += 1
    out = []
    for lang, count in f.items():
        rows = []
        for phrase, a in count.items():
            if len(phrase) < 2 or a < least:
                continue
            if len(phrase) == 2 and any(len(q) == 3 and b >= least and 2 * b >= a and phrase in (q[:2], q[1:]) for q, b in count.items()):
                continue
            cuts = [(10**6 * a * a // (count[phrase[:k]] * count[phrase[k:]]), k) for k in range(1, len(phrase))]
            s, k = min(cuts)
            rows.append((-s, -a, " ".join(phrase).encode(), count[phrase[:k]], count[phrase[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]  # noqa: E741
    return sorted(out)


@pytest.mark.parametrize("budget", [16, 400, 1 << 20])
def test_collocations_equal_plain_counts(spark, budget):
    """With a small budget most words' prefixes are extended and phrases of frequent words come from several groups."""
    rng = np.random.default_rng(11)
    odd = ["A", "b c", "É", "<x>", "東京", "a"]
    docs = []
    for i in range(120):
        w = [odd[int(x)] if x < 6 else f"w{int(x)}" for x in np.minimum(rng.zipf(1.3, 60), 40)]
        docs.append(([None, "en", "und", "de"][i % 4], " ".join(w).replace("w7", "w7.").replace("w8", "w8\n")))
    docs += [("en", None), ("en", ""), ("fr", " . , "), ("de", "hot pair " * 5000), ("de", "x\ty\tz. " * 12)]
    frame = _frame(spark, [(a, b, 3) for a, b in docs], "lang string, text string, word int")
    got = sorted(tuple(r) for r in collocations.collocations(frame, budget=budget).collect())
    assert got == _plain_phrases(docs)
    few = sorted(tuple(r) for r in collocations.collocations(frame, top=3, budget=budget).collect())
    assert few == _plain_phrases(docs, top=3)


def test_words_of_one_id_get_another_seed(spark, monkeypatch):
    plain = collocations._count_words

    def clashing(seed):
        import pyarrow as pa

        task = plain(seed)

        def one_id(batches):
            for b in task(batches):
                yield b if seed else b.set_column(0, "id", pa.array([7] * b.num_rows, pa.int64()))

        return one_id

    monkeypatch.setattr(collocations, "_count_words", clashing)
    words, seed = collocations._words(_frame(spark, [("en", "one two three two")], "lang string, text string"))
    assert seed == 2 and sorted((r["word"], r["n"]) for r in words.collect()) == [("one", 1), ("three", 1), ("two", 2)]


def test_no_collocations(spark):
    assert collocations.collocations(_frame(spark, [], "lang string, text string")).count() == 0
    assert collocations.collocations(_frame(spark, [("en", None), (None, "a b")], "lang string, text string")).count() == 0
