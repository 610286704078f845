"""The trie against dictionaries."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from canvass.llm import lm_trie


def plain(rows):
    texts = []
    for doc, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        held = zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 1
        texts.append((doc, held, re.findall(r"[^\x20\x09-\x0D]+", low) + [None]))
    one = Counter(t for _, h, ts in texts if not h for t in ts)
    two = Counter(p for _, h, ts in texts if not h for p in zip(ts, ts[1:]))
    three = Counter(p for _, h, ts in texts if not h for p in zip(ts, ts[1:], ts[2:]))
    n, v = sum(one.values()), len(one)
    out = []
    for doc, held, ts in texts:
        base = [(one[t] + 0.5) / (n + 0.5 * (v + 1)) for t in ts]
        full = base[:1]
        for a, b, p in zip(ts, ts[1:], base[1:]):
            w = one[a] + lm_trie.PRIOR
            full.append(two[a, b] / w + lm_trie.PRIOR / w * p)
        for i in range(2, len(ts)):
            seen = two[ts[i - 2], ts[i - 1]]
            if seen >= lm_trie.CONTEXT_COUNT:
                w = seen + lm_trie.PRIOR
                full[i] = three[tuple(ts[i - 2:i + 1])] / w + lm_trie.PRIOR / w * full[i]
        out.append((str(doc), held, len(ts), sum(one[t] > 0 for t in ts), n, sum(map(math.log10, base)), sum(map(math.log10, full))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("which", ["odd", "small", "clashing", "none"])
@pytest.mark.parametrize("tiny", [False, True])
def test_scores(which, tiny, request, monkeypatch):
    if tiny:  # many blocks, many shards and hot contexts
        monkeypatch.setattr(lm_trie, "BLOCK_TOKENS", 3000)
        monkeypatch.setattr(lm_trie, "SHARD_KEYS", 5000)
    docs = request.getfixturevalue(which)
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
           for r in lm_trie.score(docs).collect()]
    want = plain([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: repr(r[:5]) + f"{r[5]:.6f}"), sorted(want, key=lambda r: repr(r[:5]) + f"{r[5]:.6f}")):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert abs(g[6] - w[6]) <= g[2] * 1.02 / lm_trie.STEP + 1e-6  # the quantiser's step, of a probability and a weight


def test_held_out_texts_gain(small):
    rows = [r for r in lm_trie.score(small).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_elias_fano_finds_successors():
    rng = np.random.default_rng(5)
    for n, most in [(0, 1), (1, 1), (5, 3), (300, 10**6), (2000, 2**52), (1000, 1000), (3, 2**60)]:
        values = np.sort(rng.integers(0, most, n).astype(np.uint64)) if n else np.zeros(0, np.uint64)
        held = lm_trie.EliasFano(lm_trie.EliasFano.pack(values))
        asked = np.concatenate([values, rng.integers(0, most * 2, 500).astype(np.uint64), values + np.uint64(1)])
        at, found = held.successor(asked)
        assert (at == np.searchsorted(values, asked)).all()
        assert (found == np.isin(asked, values)).all()
        assert (held.values(np.arange(n)) == values).all()


def test_levels_can_be_mapped(tmp_path):
    contexts, words = np.array([1, 1, 4, 9, 9]), np.array([2, 7, 0, 3, 8])
    codes = np.array([5, 6, 7, 8, 9], np.uint16)
    (tmp_path / "level").write_bytes(lm_trie.Successors.pack(contexts, words, codes, 10))
    level = lm_trie.Successors(np.memmap(tmp_path / "level", np.uint8, "r"))
    got = level.find(np.array([1, 9, 9, 4, 2, 9, 1]), np.array([7, 3, 4, 0, 2, 9, 2]))
    assert got.tolist() == [6, 8, lm_trie.UNSEEN, 7, lm_trie.UNSEEN, lm_trie.UNSEEN, 5]


def test_model_is_kept(odd):
    _, _, asked, _, two, _, _ = lm_trie.fit(odd)
    rows = lm_trie.model(asked, two["span"]).collect()
    assert rows and all(lm_trie.Successors(bytes(r.level)).words.n >= 0 for r in rows)


def test_second_word_back_decides(spark):
    """After "is" both endings are as frequent; the word before it tells which."""
    texts = ["sky is blue"] * 40 + ["grass is green"] * 40
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, "sky is blue"), (1001, "sky is green")]
    got = {r.doc_id: r.score for r in lm_trie.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1000] > got[1001] + 0.5


def test_longer_context_gains_on_held_out_texts(small, monkeypatch):
    three = sum(r.score for r in lm_trie.score(small).collect() if r.held_out)
    monkeypatch.setattr(lm_trie, "CONTEXT_COUNT", 10**9)  # no pair is a context: two levels
    assert three > sum(r.score for r in lm_trie.score(small).collect() if r.held_out)
