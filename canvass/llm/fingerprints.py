"""Document fingerprints by a homomorphic multiset hash of paragraphs.

A paragraph (a line, by default) is hashed to a wide vector, and a text's fingerprint
is the sum of its paragraphs' vectors, lane by lane, modulo a power of two.  So texts
of the same paragraphs in any order have one fingerprint, and a paragraph is inserted
or deleted by adding or subtracting its vector: an edit costs what it touches.

The vector has two parts.  ``IDENTITY`` lanes of 64 bits come from SHA-256 of the whole
paragraph and tell texts apart.  ``BUCKETS`` lanes of 24 bits hold a signed count sketch
of the paragraph's word pairs, so the angle between two fingerprints estimates how much
of two texts is alike, with a standard error of about ``1 / sqrt(BUCKETS)``.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.common import BoundedCache, on_worker, slices

IDENTITY = 8
BUCKETS = 256
LANE = 1 << 24
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)  # of a multiply-shift hash of word pairs
SLICE = 1 << 21  # bytes of text looked at in one go; bounds memory, not results
CACHE_BYTES = 24 << 20
SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
DOCS_A_CHUNK, MOST_CHUNKS, SAMPLES = 4000, 50_000, 10  # a chunk streams, so its memory does not follow its size


def word_numbers(words: list[bytes]):
    """A 32-bit number per word, from MD5."""
    import numpy as np

    known = on_worker("pair_words", lambda: BoundedCache(CACHE_BYTES))
    distinct = list(set(words))
    numbers = known.lookup(distinct, lambda new: [int.from_bytes(hashlib.md5(w).digest()[:4], "big") for w in new])
    return np.fromiter(map(dict(zip(distinct, numbers, strict=True)).__getitem__, words), np.uint64, len(words))


def _sliced(lines):
    """Lines as lists of words, and whether a list is all of its line; a very long line comes in parts that overlap by a word."""
    for at, line in enumerate(lines):
        if len(line) <= SLICE:
            yield at, line.split(), True
            continue
        last, pos = [], 0
        while pos < len(line):
            space = SPACE.search(line, pos + SLICE)
            end = space.start() if space else len(line)
            words = line[pos:end].split()
            yield at, last + words, not last and not line[end:].strip()
            last, pos = (words or last)[-1:], end


class Sums:
    """The sums of ``n`` fingerprints, as lanes."""

    def __init__(self, n: int):
        import numpy as np

        self.n = n
        self.identity = np.zeros((n, IDENTITY), np.uint64)
        self.likeness = np.zeros((n, BUCKETS), np.int64)

    def add(self, lines: list[bytes], owners: list[int], signs: list[int] | None = None) -> None:
        """Insert (sign 1) or delete (sign -1) paragraphs; owners ascend."""
        at = held = 0
        for end, line in enumerate(lines, 1):
            held += len(line) + 64
            if held >= SLICE or end == len(lines):
                self._add(lines[at:end], owners[at:end], signs[at:end] if signs else None)
                at, held = end, 0

    def _add(self, lines, owners, signs) -> None:
        import numpy as np

        sha = hashlib.sha256
        raw = b"".join([sha(half + p).digest() for p in lines for half in (b"0", b"1")])
        lanes = np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, IDENTITY)
        owner = np.asarray(owners, np.int64)
        sign = np.ones(len(lines), np.int64) if signs is None else np.asarray(signs, np.int64)
        lanes = np.concatenate([np.zeros((1, IDENTITY), np.uint64), lanes * sign.view(np.uint64)[:, None]])
        to = np.cumsum(lanes, axis=0, dtype=np.uint64)
        ends = np.searchsorted(owner, np.arange(self.n + 1))
        self.identity += to[ends[1:]] - to[ends[:-1]]

        held, size = [], 0
        for part in _sliced(lines):
            held.append(part)
            size += len(part[1])
            if size >= SLICE // 4:
                self._pairs(held, owner, sign)
                held, size = [], 0
        self._pairs(held, owner, sign)

    def _pairs(self, parts, owner, sign) -> None:
        import numpy as np

        parts = [p for p in parts if p[1]]
        if not parts:
            return
        counts = np.array([len(words) for _, words, _ in parts])
        h = word_numbers(list(itertools.chain.from_iterable(words for _, words, _ in parts)))
        ends = np.cumsum(counts)
        second = np.append(h[1:], np.uint64(0))
        second[ends - 1] = 0
        use = np.ones(len(h), bool)
        alone = (counts == 1) & np.array([whole for _, _, whole in parts])  # a line of one word pairs with nothing
        use[ends[~alone] - 1] = False
        if not use.any():
            return
        line = np.repeat(np.array([at for at, _, _ in parts]), counts)[use]
        code = h[use] * np.uint64(FACTORS[0]) + second[use] * np.uint64(FACTORS[1]) + np.uint64(FACTORS[2])
        bucket = (code >> np.uint64(56)).astype(np.int64)
        weight = (1 - 2 * ((code >> np.uint64(55)) & np.uint64(1)).astype(np.int64)) * sign[line]
        first, last = owner[line[0]], owner[line[-1]]
        got = np.bincount((owner[line] - first) * BUCKETS + bucket, weights=weight,
                          minlength=(last - first + 1) * BUCKETS)
        self.likeness[first:last + 1] += got.astype(np.int64).reshape(-1, BUCKETS)

    def edited(self, which: list[int], texts: list[str], following: list[str]) -> tuple[Sums, list[str]]:
        """The fingerprints after each text's edit: its touched paragraphs deleted, their new ones inserted."""
        out, made = Sums(len(which)), []
        lines, owners, signs = [], [], []
        for k, (text, other) in enumerate(zip(texts, following, strict=True)):
            cut = len(text) // 2
            kept = text[:len(text) - cut]
            made.append(kept + other[:cut])
            if cut:
                untouched = kept.count("\n")
                old = text.encode().split(b"\n")[untouched:]
                new = made[-1].encode().split(b"\n")[untouched:]
                lines += old + new
                owners += [k] * (len(old) + len(new))
                signs += [-1] * len(old) + [1] * len(new)
        out.identity += self.identity[which]
        out.likeness += self.likeness[which]
        out.add(lines, owners, signs)
        return out, made

    def pick(self, which: list[int]) -> Sums:
        out = Sums(len(which))
        out.identity[:], out.likeness[:] = self.identity[which], self.likeness[which]
        return out

    def lanes(self):
        """The likeness lanes as signed numbers, as a fingerprint holds them."""
        low = self.likeness % LANE
        return low - LANE * (low >= LANE // 2)

    def written(self) -> list[str]:
        """Fingerprints as text: the lanes, highest byte first, in base 64."""
        import base64

        import numpy as np

        wide = self.identity.astype(">u8").view(np.uint8).reshape(self.n, -1)
        fine = (self.likeness % LANE).astype(">u4").view(np.uint8).reshape(self.n, BUCKETS, 4)[:, :, 1:]
        raw = np.concatenate([wide, fine.reshape(self.n, -1)], axis=1)
        return [base64.b64encode(r.tobytes()).decode() for r in raw]


def of_texts(texts: list[str]) -> Sums:
    """The fingerprints of whole texts."""
    sums, lines, owners = Sums(len(texts)), [], []
    for k, text in enumerate(texts):
        new = text.encode().split(b"\n")
        lines += new
        owners += [k] * len(new)
    sums.add(lines, owners)
    return sums


def read(fingerprints: list[str]) -> Sums:
    """The sums that ``written`` has written, for later insertions and deletions."""
    import base64

    import numpy as np

    out = Sums(len(fingerprints))
    for k, text in enumerate(fingerprints):
        raw = np.frombuffer(base64.b64decode(text), np.uint8)
        out.identity[k] = raw[:IDENTITY * 8].view(">u8")
        fine = raw[IDENTITY * 8:].reshape(BUCKETS, 3).astype(np.int64)
        out.likeness[k] = (fine[:, 0] << 16) | (fine[:, 1] << 8) | fine[:, 2]
    return out


def likeness(one: Sums, two: Sums) -> list[float]:
    """Cosine of the likeness lanes, 0 at least; 1 for equal fingerprints, 0 if one of unequal ones has no words."""
    import numpy as np

    a, b = one.lanes(), two.lanes()
    dot = (a * b).sum(axis=1).astype(float)
    norm = np.sqrt((a * a).sum(axis=1).astype(float) * (b * b).sum(axis=1).astype(float))
    near = np.clip(np.divide(dot, norm, out=np.zeros(one.n), where=norm > 0), 0.0, 1.0)
    same = (one.identity == two.identity).all(axis=1) & (a == b).all(axis=1)
    return np.where(same, 1.0, near).tolist()


def followed(docs: DataFrame, chunk_rows: int = DOCS_A_CHUNK) -> DataFrame:
    """``doc_id, text, last`` so that each row is followed by its next document, descending ids, in its partition.

    A bounded sample of keys splits the order into chunks, each a partition.  The first
    row of a chunk goes to the chunk before it once more (``last``), that of the first
    chunk to the end, so one shuffle of the texts is enough.  Ids that repeat, nulls
    among them, go by a hash of their text and their place, so no id is too large to split.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({
        "_null": F.col("doc_id").isNull(), "_down": F.coalesce(F.expr("~cast(doc_id as bigint)"), F.lit(0)),
        "_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order = ["_null", "_down", "_hash", "_row"]
    chunks = min(MOST_CHUNKS, 1 + docs.count() // chunk_rows)
    share = min(1.0, SAMPLES * chunks / max(1, chunk_rows * (chunks - 1)))
    key = F.struct(*order)
    # at most about SAMPLES * MOST_CHUNKS keys come to the driver, whatever the number of rows
    drawn = keyed.select(key.alias("key"), (F.rand(7) < share).alias("drawn"))
    got = drawn.agg(F.min("key").alias("first"), F.collect_list(F.when(F.col("drawn"), F.col("key"))).alias("some")).first()
    first = [tuple(got["first"])] if got["first"] else [(False, 0, 0, 0)]
    some = sorted({tuple(k) for k in got["some"]} - set(first)) if chunks > 1 else []
    starts = first + [some[i * len(some) // chunks] for i in range(1, chunks) if some]
    starts = sorted(set(starts))
    held = docs.sparkSession.sparkContext.broadcast(starts)

    @F.pandas_udf("chunk int, opens boolean")
    def place(null: pd.Series, down: pd.Series, hashed: pd.Series, row: pd.Series) -> pd.DataFrame:
        bounds = held.value
        keys = list(zip(null.tolist(), down.tolist(), hashed.tolist(), row.tolist(), strict=True))
        at = [max(0, bisect.bisect_right(bounds, k) - 1) for k in keys]
        return pd.DataFrame({"chunk": at, "opens": [bounds[i] == k for i, k in zip(at, keys, strict=True)]})

    placed = keyed.withColumn("_at", place(*order))
    before = F.struct(F.pmod(F.col("_at.chunk") - 1, F.lit(len(starts))).alias("chunk"), F.lit(True).alias("last"))
    here = F.struct(F.col("_at.chunk").alias("chunk"), F.lit(False).alias("last"))
    dealt = placed.withColumn("_to", F.explode(F.when(F.col("_at.opens"), F.array(here, before)).otherwise(F.array(here))))
    dealt = dealt.select("doc_id", "text", *order, F.col("_to.chunk").alias("_chunk"), F.col("_to.last").alias("last"))
    return dealt.repartitionById(len(starts), F.col("_chunk")).sortWithinPartitions("last", *order).select(
        "doc_id", "text", "last")


def fingerprints(docs: DataFrame, chunk_rows: int = DOCS_A_CHUNK) -> DataFrame:
    """Fingerprints of whole texts and of their edited versions.

    In the edited text the last half of the code points gives way to as many of the next
    document's first ones (or all).  Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.  Ids are integers.  A null text is empty;
    an empty text is one empty paragraph; repeated rows follow each other; rows without
    an id come last; a lone row follows itself; no rows give none; other columns are left out.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    key_type = docs.schema["doc_id"].dataType
    fields = [("doc_id", to_arrow_type(key_type)), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
              ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
              ("near_next", pa.float64())]

    def finished(ids, texts, sums, whose):
        """Rows for the documents ``whose``, each with the one after it."""
        mine, after = sums.pick(whose), sums.pick([k + 1 for k in whose])
        new, made = sums.edited(whose, [texts[k] for k in whose], [texts[k + 1] for k in whose])
        values = [[ids[k] for k in whose], [len(texts[k]) for k in whose],
                  [hashlib.sha256(t.encode()).hexdigest() for t in made], mine.written(), new.written(),
                  likeness(mine, new), likeness(mine, after)]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(values, fields, strict=True)],
                                          names=[n for n, _ in fields])

    def run(batches):
        ids, texts, last, sums = [], [], [], None
        for part in slices(batches, 1, 2 * SLICE, 500):
            new = part.column(1).to_pylist()
            fresh = of_texts(new)
            if sums is not None:  # the row held back meets its follower
                both = Sums(1 + fresh.n)
                both.identity[:1], both.likeness[:1] = sums.identity[-1:], sums.likeness[-1:]
                both.identity[1:], both.likeness[1:] = fresh.identity, fresh.likeness
                fresh = both
            ids, texts, last = ids[-1:] + part.column(0).to_pylist(), texts[-1:] + new, last[-1:] + part.column(2).to_pylist()
            sums = fresh
            whose = [k for k in range(len(ids) - 1) if not last[k]]
            if whose:
                yield finished(ids, texts, sums, whose)

    kinds = f"doc_id {key_type.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, " \
            "edited_fingerprint string, near_edited double, near_next double"
    return followed(docs, chunk_rows).mapInArrow(run, kinds)
