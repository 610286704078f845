"""Near-duplicates against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
from conftest import PROSE
from conftest_llm import by_row

from canvass.llm import near_dups
from canvass.llm.decontaminate import words_of


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def alike_plain(a, b):
    if not a or not b:
        return False
    common = sum((Counter(a) & Counter(b)).values())
    if common < 0.8 * (len(a) + len(b) - common):
        return False
    n = lcs(a, b)
    return n >= 0.8 * (len(a) + len(b) - n) - 1e-9


def classes_plain(rows):
    first = {}
    for doc, text in sorted((r for r in rows if r[0] is not None and words_of(r[1])), key=lambda r: r[0]):
        first.setdefault(tuple(words_of(text)), doc)
    heads = [(ws, list(ws)) for ws in first]
    parent = {d: d for d, _ in heads}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(heads):
        for e, b in heads[:i]:
            if alike_plain(a, b):
                x, y = sorted((root(d), root(e)))
                parent[y] = x
    least = {}
    for ws in parent:
        least[root(ws)] = min(first[ws], least.get(root(ws), first[ws]))
    return sorted(repr((d, least[root(tuple(words_of(t)))] if d is not None and words_of(t) else d)) for d, t in rows)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        i = rng.randrange(len(words))
        words[i:i + 1] = rng.choice([[], ["new"], [words[i], "more"]])
    return words


@pytest.fixture(scope="module")
def planted(spark):
    rng, rows = random.Random(7), []
    for base in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 13, 40, 300]))]
        rows.append(" ".join(words))
        for k in range(9):
            rows.append(" ".join(edited(rng, words, k)))
    common = [f"p{i}" for i in range(60)]
    for _ in range(40):  # a long passage shared by texts that differ otherwise
        rows.append(" ".join(common + [f"u{rng.randrange(10**6)}" for _ in range(rng.choice([3, 10, 20, 60]))]))
    rows += ["", None, "four words are here", "four words are here", "Four, words ARE here!", "x " * 300, "x " * 280]
    rng.shuffle(rows)
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


@pytest.mark.parametrize("which", ["odd", "planted", "small", "clashing", "none"])
def test_classes_match_all_pairs(which, request):
    docs = request.getfixturevalue(which)
    got = near_dups.classes(docs).select("doc_id", "class_id")
    assert by_row(got) == classes_plain([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_one_of_each_class_stays(clashing):
    kept = near_dups.one_of_each(clashing)
    assert kept.columns == clashing.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    want = [r[0] for r in near_dups.classes(clashing).where("doc_id is null or doc_id = class_id").select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and set(ids) == set(want)


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    unique = "a text that nothing else in the table is like at all, with words of its own"
    docs = spark.createDataFrame([(1, PROSE, 1), (2, PROSE, 2), (2, unique, 3), (2, unique, 3), (3, PROSE + " more", 4),
                                  (3, "", 5), (3, None, 6), (None, PROSE, 7)], "doc_id long, text string, row int")
    kept = sorted(r[0] for r in near_dups.one_of_each(docs).select("row").collect())
    assert kept == [1, 3, 5, 6, 7]
    got = sorted((r[0] or 0, r[1] or 0) for r in near_dups.classes(docs).select("doc_id", "class_id").collect())
    assert got == [(0, 0), (1, 1), (2, 1), (2, 2), (2, 2), (3, 1), (3, 3), (3, 3)]


def test_near_copies_share_a_sketch():
    """Recall of the candidates among texts that all pairs would link, for edits of 1 to 10 % of the words."""
    rng = random.Random(11)
    for share in (0.01, 0.02, 0.03, 0.05, 0.08, 0.1):
        alike = met = 0
        for n in [5, 9, 12, 25, 28, 31, 60, 200, 500] * 12:
            a = np.array([rng.randrange(2**32) for _ in range(n)], np.uint64)
            b = a.tolist()
            for i in sorted(rng.sample(range(n), max(1, round(share * n))), reverse=True):
                b[i:i + 1] = rng.choice([[], [rng.randrange(2**32)], [b[i], rng.randrange(2**32)]])
            b = np.array(b, np.uint64)
            if near_dups.alike(a, b) >= near_dups.SIMILARITY:
                alike += 1
                met += bool(set(near_dups.sketches(a).tolist()) & set(near_dups.sketches(b).tolist()))
        assert alike >= 80 and met >= 0.95 * alike, (share, alike, met)


def test_long_copies_take_little_time_and_memory():
    """Two copies of 500,000 words with an edit near each end, and two of which every tenth word differs."""
    import tracemalloc

    rng = np.random.default_rng(2)
    a = rng.integers(0, 50_000, 500_000).astype(np.uint64)
    b = a.copy()
    b[3], b[-4] = 1 << 40, 1 << 41
    tracemalloc.start()
    assert near_dups.alike(a, b) == (len(a) - 2) / (len(a) + 2)
    keys = [near_dups.sketches(x) for x in (a, b)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(keys[0]) & set(keys[1]) and peak < 200 << 20
    a, b = a[:20_000], a[:20_000].copy()
    b[::10] = 1 << 40
    assert abs(near_dups.alike(a, b) - 18_000 / 22_000) < 1e-9


def test_slices_of_a_text_change_no_sketch(monkeypatch):
    x = np.random.default_rng(1).integers(0, 10**6, 700).astype(np.uint64)
    want = near_dups.sketches(x).tolist()
    monkeypatch.setattr(near_dups, "SLICE", 50)
    assert near_dups.sketches(x).tolist() == want


def test_alignment_is_exact_when_it_reaches_what_is_needed():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randrange(8, 40))]
        b = edited(rng, a, rng.randrange(6)) or [1]
        b = [x if isinstance(x, int) else 9 for x in b]
        want = lcs(a, b)
        for needed in {want, max(0, want - 2)}:
            assert near_dups.aligned(np.array(a), np.array(b), needed) == want
        assert near_dups.aligned(np.array(a), np.array(b), want + 1) <= want


def test_places_by_search_equal_masks(monkeypatch):
    rng = random.Random(8)
    pairs = [(np.array([rng.randrange(9) for _ in range(rng.randrange(1, 90))]), np.array([rng.randrange(9) for _ in range(60)]))
             for _ in range(40)]
    want = [near_dups.aligned(a, b, 0) for a, b in pairs]
    assert want == [lcs(a.tolist(), b.tolist()) for a, b in pairs]
    monkeypatch.setattr(near_dups, "MASKED", 0)
    assert want == [near_dups.aligned(a, b, 0) for a, b in pairs]


def test_sketches_keep_order():
    a = np.arange(1, 60, dtype=np.uint64)
    turned = np.concatenate([a[30:], a[:30]])
    one, two = (set(near_dups.sketches(x).tolist()) for x in (a, turned))
    assert one != two and one == set(near_dups.sketches(a.copy()).tolist())
