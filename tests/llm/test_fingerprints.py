"""Fingerprints against a plain version, and what sums of paragraphs promise."""

import base64
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import by_row

from canvass.llm import fingerprints as fp

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lanes_plain(text):
    wide, fine = [0] * 8, [0] * 256
    for line in text.split("\n"):
        raw = b"".join(hashlib.sha256(h + line.encode()).digest() for h in (b"0", b"1"))
        wide = [(w + int.from_bytes(raw[8 * i:8 * i + 8], "big")) % 2**64 for i, w in enumerate(wide)]
        h = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in WORD.findall(line)]
        for a, b in zip(h, h[1:], strict=False) if len(h) > 1 else [(x, 0) for x in h]:
            code = (a * fp.FACTORS[0] + b * fp.FACTORS[1] + fp.FACTORS[2]) % 2**64
            fine[code >> 56] += -1 if code >> 55 & 1 else 1
    return wide, fine


def written_plain(lanes):
    wide, fine = lanes
    return base64.b64encode(b"".join(w.to_bytes(8, "big") for w in wide)
                            + b"".join((x % 2**24).to_bytes(3, "big") for x in fine)).decode()


def near_plain(a, b):
    if a == b:
        return 1.0
    dot, x, y = (sum(p * q for p, q in zip(u, v, strict=True)) for u, v in ((a[1], b[1]), (a[1], a[1]), (b[1], b[1])))
    return min(1.0, max(0.0, dot / math.sqrt(float(x) * float(y)))) if x and y else 0.0


def rows_plain(rows, hashed):
    """The rows in order of descending ids; equal ids go by the engine's hash of their text."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1] or ""]))
    out = []
    for (doc, text), (_, other) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        text, other = text or "", other or ""
        n, cut = len(text), len(text) // 2
        edited = text[:n - cut] + other[:cut]
        a, b, c = lanes_plain(text), lanes_plain(edited), lanes_plain(other)
        out.append((doc, n, hashlib.sha256(edited.encode()).hexdigest(), written_plain(a), written_plain(b),
                    near_plain(a, b), near_plain(a, c)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("which", ["odd", "clashing", "none", "small"])
@pytest.mark.parametrize("chunk_rows", [3, 4000])
def test_rows_match_plain_version(spark, which, chunk_rows, request):
    docs = request.getfixturevalue(which)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    from pyspark.sql import functions as F

    hashed = dict(docs.select(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).collect())
    assert by_row(fp.fingerprints(docs, chunk_rows)) == rows_plain(rows, hashed)


def test_no_partition_holds_a_repeated_id_alone(spark):
    """A third of all rows have no id and one text; they still spread over chunks."""
    rows = [(None, "same text\nagain")] * 400 + [(i, f"text {i}\nline") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = [len(p) for p in fp.followed(docs, 50).rdd.glom().collect()]
    assert max(sizes) < 300 and sum(sizes) == 1200 + len(sizes)
    got = fp.fingerprints(docs, 50).where("doc_id is null").groupBy("near_next").count().collect()
    assert dict(got)[1.0] == 399


def test_order_does_not_matter_and_edits_add_up():
    text = "one two three\n\nfour five\nfour five\nsix " * 30
    lines = text.split("\n")
    assert fp.of_texts([text]).written() == fp.of_texts(["\n".join(reversed(lines))]).written()
    sums = fp.of_texts([text, "other"])
    sums.add([b"new one", b"four five", b"x"], [0, 0, 1], [1, -1, 1])
    left = lines.copy()
    left.remove("four five")
    assert sums.written() == fp.of_texts(["\n".join([*left, "new one"]), "other\nx"]).written()
    again = fp.read(sums.written())
    assert again.written() == sums.written() and fp.likeness(again, sums) == [1.0, 1.0]


def test_very_long_lines_and_texts_give_the_same(monkeypatch):
    texts = ["word " * 40 + "\n" + "x" * 300 + "\n" + "y" * 200 + "  \n" + "a bc def " * 30, "one", "", "  \n "]
    want = fp.of_texts(texts).written()
    assert want == [written_plain(lanes_plain(t)) for t in texts]
    for size in (7, 50, 150):
        monkeypatch.setattr(fp, "SLICE", size)
        assert fp.of_texts(texts).written() == want


def test_likeness_follows_shared_pairs():
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(5000)])
    for kept in (0.0, 0.3, 0.6, 0.9):
        a, b = rng.choice(words, 400), rng.choice(words, 400)
        b[:int(400 * kept)] = a[:int(400 * kept)]
        pairs = [Counter(zip(x, x[1:], strict=False)) for x in (a.tolist(), b.tolist())]
        want = sum((pairs[0] & pairs[1]).values()) / 399
        got = fp.likeness(fp.of_texts([" ".join(a)]), fp.of_texts([" ".join(b)]))[0]
        assert abs(got - want) < 0.25
