"""Near-duplicates by order MinHash, verified by banded alignment.

A text is the sequence of its words.  A sketch takes the few smallest of its k-mers
(words in a row, each labelled with how often it has stood in the text before) under one
hash function and keeps them in their order in the text, so it answers to edit
similarity; texts that share a sketch are candidates.

The first text of a sketch leads it.  A text is first compared with the leader that it
shares most sketches with; most copies join their class so, at a comparison each.
Sketches that hold several classes still are looked at in full, a chunk of their texts against another, where
products of small matrices give the words in common.  Nothing is capped.  Two
texts are alike if aligning their words leaves at least ``SIMILARITY`` of both
together; classes are the connected components.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canvass.llm.common import marked, slices, small_batches, stage
from canvass.llm.decontaminate import words_of

SIMILARITY = 0.8
SKETCHES = 40


class Tier(NamedTuple):
    """How texts of ``least`` to ``below`` words are sketched; tiers overlap by more than the similarity allows."""

    least: int
    below: float
    kept: int  # labelled k-mers of a sketch


#: Words in a k-mer.  A replaced word costs as many k-mers, so at one word a text of which a tenth is replaced
#: keeps 0.82 of them and shares one of 40 sketches of ten but in 3 of 1,000 cases; texts that merely have
#: words or a passage in common seldom have ten such words in one order.
KMER = 1
#: Texts of under four words have no near copies but equal ones.
TIERS = [Tier(4, 10, 3), Tier(8, 30, 6), Tier(24, float("inf"), 10)]
CHUNK, CHUNK_BYTES = 64, 1 << 17  # texts of a sketch, and bytes of their words, that meet another chunk at a time
WIDTH = 4096  # labelled words of a slice when two chunks are compared
SLICE = 1 << 14  # k-mers ranked at a time
MASKED = 4096  # texts of more words find a word's places by search instead of by masks as wide as the text
TEXT = "decimal(38,0)"  # a text is named by a digest of its words; a number, so that it is aggregated by hash
SKETCHED = f"raw long, t {TEXT}, n_words long, sketches array<long>"


def mix(x):
    """A bijective scramble of unsigned 64-bit numbers (the public splitmix finaliser)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]):
    """A 64-bit number per word."""
    import numpy as np
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def kmers(hashes, k: int):
    """A number per ``k`` words in a row; a shorter text is one."""
    import numpy as np

    n = max(1, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(hashes))):
        out = mix(out + hashes[i:i + n] + np.uint64(i + 1))
    return out


def labelled(values):
    """Tell repeated values apart by how often they have stood before."""
    import numpy as np

    order = np.argsort(values, kind="stable")
    ordered = values[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    starts = np.flatnonzero(first)
    before = np.arange(len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values))))
    out = np.empty(len(values), np.uint64)
    out[order] = mix(ordered + before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def least_ranked(labels, factors, kept: int):
    """Ranks of the few least labels under each factor, in text order; long texts go slice by slice."""
    import numpy as np

    ranks = places = None
    for at in range(0, len(labels), SLICE):
        new = labels[None, at:at + SLICE] * factors[:, None]
        where = np.broadcast_to(np.arange(at, at + new.shape[1]), new.shape)
        if ranks is not None:
            new, where = np.concatenate([ranks, new], axis=1), np.concatenate([places, where], axis=1)
        if new.shape[1] > kept:
            least = np.argpartition(new, kept - 1, axis=1)[:, :kept]
            new, where = np.take_along_axis(new, least, 1), np.take_along_axis(where, least, 1)
        ranks, places = new, where
    return np.take_along_axis(ranks, np.argsort(places, axis=1), 1)


def sketches(hashes):
    """Keys of a text's sketches, which fold the least labelled k-mers in text order."""
    import numpy as np

    base = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    keys = [np.zeros(0, np.uint64)]
    for number, tier in enumerate(TIERS):
        if tier.least <= len(hashes) < tier.below:
            key = mix(~base + np.uint64(number))
            for rank in least_ranked(labelled(kmers(hashes, KMER)), base, tier.kept).T:
                key = mix(key + rank)
            keys.append(key)
    return np.unique(np.concatenate(keys)).view(np.int64)


def raw_digest(text: str = "text"):
    """Tells rows of one id apart."""
    return F.xxhash64(text)


def name_of(words: list[bytes]):
    """The name of a text."""
    import decimal

    import xxhash

    return decimal.Decimal(xxhash.xxh3_128_intdigest(b" ".join(words)) % 10**38)


def sketch(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, a digest of the row's text, one of its words (``t``), their number, and the sketches' keys."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    key_type = docs.schema["doc_id"].dataType

    def run(batches):
        import numpy as np

        for b in slices(batches, 2, 2 << 20):
            digests, counts, keys = [], [], []
            for t in b.column(2).to_pylist():
                words = words_of(t)
                digests.append(name_of(words))
                counts.append(len(words))
                keys.append(sketches(word_hashes(words)))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(to_arrow_type(key_type)), b.column(1), pa.array(digests, pa.decimal128(38, 0)),
                 pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["doc_id", "raw", "t", "n_words", "sketches"])

    return docs.select("doc_id", raw_digest(text).alias("raw"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {key_type.simpleString()}, {SKETCHED}")


def aligned(a, b, needed: int) -> int:
    """Length of the best alignment of two word sequences if it reaches ``needed``, else less than that.

    An alignment that leaves out few words stays within a band about the diagonal.  Bands
    are tried from narrow to wide until one is wide enough to be sure of its answer.
    """
    import numpy as np

    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(np.argmin(same))
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = a[len(a) - n:][::-1] == b[len(b) - n:][::-1]
    tail = n if same.all() else int(np.argmin(same))
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    total = head + tail
    if not len(a) or not len(b):
        return total
    values, numbers = np.unique(np.concatenate([a, b]), return_inverse=True)
    mine, other = numbers[:len(a)], numbers[len(a):]
    k = len(values)
    if total + np.minimum(np.bincount(mine, minlength=k), np.bincount(other, minlength=k)).sum() < needed:
        return 0
    places = Places(other, k)
    both, widest = len(a) + len(b), max(len(a) + len(b) - 2 * (needed - total), abs(len(a) - len(b)))
    width = min(widest, max(64, 2 * abs(len(a) - len(b))))
    rows = mine.tolist()
    while True:
        found = in_band(rows, places, width)
        if width >= widest or both - 2 * found <= width:
            return total + found
        width = min(widest, 4 * width)


class Places:
    """Where the numbers of a sequence stand, as bits of a window."""

    def __init__(self, sequence, k: int):
        import numpy as np

        self.n, self.at = len(sequence), None
        if self.n <= MASKED:
            self.at = [0] * k
            for j, v in enumerate(sequence.tolist()):
                self.at[v] |= 1 << j
        else:  # masks would take memory with the square of the length
            self.order = np.argsort(sequence, kind="stable")
            self.starts = np.searchsorted(sequence[self.order], np.arange(k + 1))

    def window(self, value: int, low: int, size: int) -> int:
        """Bit p is set where the value stands at ``low + p``."""
        import numpy as np

        if self.at is not None:
            hits = self.at[value]
            return (hits >> low if low >= 0 else hits << -low) & ((1 << size) - 1)
        held = self.order[self.starts[value]:self.starts[value + 1]]
        first, last = np.searchsorted(held, [low, low + size])
        held = held[first:last] - low
        if len(held) <= 16:
            return sum(1 << p for p in held.tolist())
        bits = np.zeros(size, np.uint8)
        bits[held] = 1
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def in_band(rows: list[int], places: Places, width: int) -> int:
    """The best alignment that matches words at most ``width`` places apart.

    A row of the table is held as bits, 0 where a column adds to the alignment; only the
    columns of the band are held, and those that leave it are counted.
    """
    size = 2 * width + 1
    full = (1 << size) - 1
    row, found = full, 0  # column j is bit j - (i - width)
    for i, value in enumerate(rows):
        if i:
            found += 1 - (row & 1)
            row = (row >> 1) | (1 << (size - 1))
        u = row & places.window(value, i - width, size)
        if u:
            row = ((row + u) | (row - u)) & full
    return found + size - row.bit_count()


def alike(a, b) -> float:
    """Aligned words over all words of both texts; 0 where it can't reach the threshold."""
    import math

    both = len(a) + len(b)
    needed = math.ceil(SIMILARITY * both / (1 + SIMILARITY) - 1e-9)
    if min(len(a), len(b)) < needed:
        return 0.0
    length = aligned(a, b, needed)
    return length / (both - length) if length >= needed else 0.0


def numbers_of(raw: bytes):
    import numpy as np

    return np.frombuffer(raw, np.uint32).astype(np.uint64)


def sequences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Word numbers (32 bits each) of the wanted texts (``doc_id, raw, t``); the only place where texts are shuffled, and those only."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        for b in slices(batches, 1, 2 << 20):
            rows = [word_hashes(words_of(t)).astype(np.uint32).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["t", "seq"])

    # one row stands for all of a text; rows equal to it in id and text are copies of it
    rows = marked(docs.select("doc_id", raw_digest().alias("raw"), "text"), "raw", wanted.select("raw"), "_may").where("_may")
    rows = rows.drop("_may").join(wanted, ["doc_id", "raw"])
    return rows.select("t", "text").mapInArrow(run, f"t {TEXT}, seq binary").dropDuplicates(["t"])


def verified(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    """The pairs ``(doc, leader)`` of texts that align, with their similarity."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            leaders: dict[bytes, object] = {}
            keep, sims = [], []
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if y not in leaders:
                    leaders = {y: numbers_of(y)}
                sim = alike(numbers_of(x), leaders[y])
                if sim >= SIMILARITY:
                    keep.append(i)
                    sims.append(sim)
            took = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([took.column(0), took.column(1), pa.array(sims, pa.float64())],
                                             names=["doc", "leader", "similarity"])

    one = seqs.select(F.col("t").alias("doc"), F.col("seq").alias("seq_a"))
    two = seqs.select(F.col("t").alias("leader"), F.col("seq").alias("seq_b"))
    both = pairs.join(one, "doc").join(two, "leader").select("doc", "leader", "seq_a", "seq_b")
    return both.mapInArrow(run, f"doc {TEXT}, leader {TEXT}, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """``(doc, class_id)`` for the ends of the edges: the smallest that can be reached.

    Every round takes the least label of the neighbours and then that label's own
    label, so chains halve.
    """
    both = edges.select(F.col("doc").alias("u"), F.col("leader").alias("v")).unionByName(
        edges.select(F.col("leader").alias("u"), F.col("doc").alias("v")))
    both = stage(both, "edges")
    labels = stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(
            F.min("label").alias("_near"))
        low = labels.join(near, "u").select("u", F.least("label", "_near").alias("label"), F.col("label").alias("_old"))
        up = labels.select(F.col("u").alias("label"), F.col("label").alias("_up"))
        new = stage(low.join(up, "label", "left").select(
            "u", F.least("label", F.coalesce("_up", "label")).alias("label"), "_old"), "labels")
        labels = new.select("u", "label")
        if new.where("label != _old").isEmpty():
            return labels.select(F.col("u").alias("doc"), F.col("label").alias("class_id"))


def shared_sketches(sketched: DataFrame) -> DataFrame:
    """``(key, doc, leader, n_words)`` for sketches that different texts share; a text is named by its digest.

    Copies of a text are one here, before its sketches are dealt out, which happens once.
    """
    texts = sketched.where("doc_id is not null").select("t", "n_words", "sketches").dropDuplicates(["t"])
    each = texts.select(F.col("t").alias("doc"), "n_words", F.explode("sketches").alias("key"))
    same = Window.partitionBy("key")
    each = each.withColumns({"leader": F.min("doc").over(same), "_n": F.count(F.lit(1)).over(same)})
    return each.where("_n > 1").select("key", "doc", "leader", "n_words")


def common_words(rows: list, others: list):
    """How many labelled words each of one list of texts shares with each of another."""
    import numpy as np

    flat, which = np.unique(np.concatenate([*rows, *others]), return_inverse=True)
    owner = np.repeat(np.arange(len(rows) + len(others)), [len(r) for r in (*rows, *others)])
    out = np.zeros((len(rows), len(others)), np.float32)
    order = np.argsort(which, kind="stable")
    which, owner = which[order], owner[order]
    for at in range(0, len(flat), WIDTH):  # bounded memory, however long the texts
        a, b = np.searchsorted(which, [at, at + WIDTH])
        held = np.zeros((len(rows) + len(others), min(WIDTH, len(flat) - at)), np.float32)
        held[owner[a:b], which[a:b] - at] = 1
        out += held[:len(rows)] @ held[len(rows):].T
    return out


def chunk_links(key, same: bool, one: list, two: list) -> list[tuple]:
    """Links that join classes between two chunks of a sketch's documents (or within one).

    Pairs of documents that share several sketches are looked at in the lowest one.
    """
    import numpy as np

    seqs = [[numbers_of(d["seq"]) for d in ds] for ds in (one, two)]
    common = common_words(*[[labelled(s) for s in ss] for ss in seqs])
    sizes = [np.array([len(s) for s in ss], float) for ss in seqs]
    both = sizes[0][:, None] + sizes[1][None, :]
    numbers = {c: i for i, c in enumerate({d["class_id"] for d in (*one, *two)})}
    classes = [np.array([numbers[d["class_id"]] for d in ds]) for ds in (one, two)]
    may = (common >= SIMILARITY * (both - common) - 1e-3) & (classes[0][:, None] != classes[1][None, :])
    joined: dict = {}

    def root(c):
        while c in joined:
            c = joined[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(may), strict=True):
        x, y = one[i], two[j]
        if same and j <= i or root(x["class_id"]) == root(y["class_id"]):
            continue
        if min(set(x["keys"]) & set(y["keys"])) != key:
            continue
        sim = alike(seqs[0][i], seqs[1][j])
        if sim >= SIMILARITY:
            joined[root(x["class_id"])] = root(y["class_id"])
            out.append((x["class_id"], y["class_id"], sim))
    return out


def chunked(both: DataFrame, seqs: DataFrame) -> DataFrame:
    """Links among all documents of the open sketches.

    A sketch's documents are dealt into chunks of bounded number and bytes, those of its
    largest class apart; each chunk meets the others of its sketch, so a pair of documents
    is never a row, and the largest class is not compared with itself.
    """
    import pyarrow as pa

    per_class = both.groupBy("key", "class_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("w"))
    size = per_class.groupBy("key").agg(F.max(F.struct("n", "class_id", "w")).alias("_m"), F.sum("n").alias("_n"),
                                        F.sum("w").alias("_w"))
    parts = lambda n, w: F.greatest(F.lit(1), F.ceil(F.greatest(n / CHUNK, w * 4 / CHUNK_BYTES)))
    inner = F.col("class_id") == F.col("_m.class_id")
    place = F.when(inner, -F.pmod(F.xxhash64("doc"), parts(F.col("_m.n"), F.col("_m.w"))) - 1).otherwise(
        F.pmod(F.xxhash64("doc"), parts(F.col("_n") - F.col("_m.n"), F.col("_w") - F.col("_m.w"))))
    spot = F.struct("key", place.alias("chunk"))
    # words join a text once, and then go to its sketches: at most two for each hash function
    held = both.join(size, "key").groupBy("doc").agg(F.min("class_id").alias("class_id"), F.collect_list(spot).alias("spots"))
    held = held.join(seqs.select(F.col("t").alias("doc"), "seq"), "doc").select(
        F.explode("spots").alias("spot"), F.struct("doc", "class_id", "seq", F.col("spots.key").alias("keys")).alias("d"))
    chunks = stage(held.groupBy("spot.key", "spot.chunk").agg(F.collect_list("d").alias("docs")), "chunks")
    other = chunks.select(F.col("key").alias("_key"), F.col("chunk").alias("_chunk"), F.col("docs").alias("_docs"))
    # chunks below zero hold the largest class of their sketch, in which there is nothing left to join
    pairs = chunks.join(other, (F.col("key") == F.col("_key")) & (F.col("chunk") <= F.col("_chunk")) & (F.col("_chunk") >= 0))

    def run(batches):
        for b in batches:
            rows = [r for key, x, y, one, two in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True)
                    for r in chunk_links(key, x == y, one, two)]
            kinds = pa.decimal128(38, 0), pa.decimal128(38, 0), pa.float64()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                                             names=["one", "two", "similarity"])

    return pairs.select("key", "chunk", "_chunk", "docs", "_docs").mapInArrow(
        run, f"one {TEXT}, two {TEXT}, similarity double")


def open_sketches(held: DataFrame, parts: DataFrame) -> DataFrame:
    """``(key, doc, n_words, class_id)`` of the sketches whose texts are of several classes."""
    both = held.join(parts, "doc", "left").select(
        "key", "doc", "n_words", F.coalesce("class_id", "doc").alias("class_id"))
    several = both.groupBy("key").agg(F.min("class_id").alias("_a"), F.max("class_id").alias("_b"))
    several = several.where("_a != _b").select("key")
    return stage(both.join(several, "key", "left_semi"), "open-sketches")


def linked(docs: DataFrame, sketched: DataFrame) -> DataFrame:
    """``(doc, class_id)`` of texts that are linked to another.

    The first text of a sketch leads it.  Each text is compared with the leader that it
    shares most sketches with; most copies join their class here, at one comparison each.
    Texts that are outside the largest class of a sketch are then compared with that class's
    first text.  Sketches whose texts are of several classes still are then looked at in full, chunk by
    chunk, so no pair of candidates is left that could join two classes.
    """
    spark = docs.sparkSession
    held = stage(shared_sketches(sketched), "shared-sketches")
    first_rows = sketched.where("doc_id is not null").groupBy("t").agg(F.min(F.struct("doc_id", "raw")).alias("_r"))
    wanted = stage(first_rows.join(held.select(F.col("doc").alias("t")).distinct(), "t").select("t", "_r.doc_id", "_r.raw"),
                   "wanted")
    seqs = stage(sequences(docs, wanted), "word-numbers")
    shared = held.where("doc != leader").groupBy("doc", "leader").agg(F.count(F.lit(1)).alias("_n"))
    pairs = shared.groupBy("doc").agg(F.max_by("leader", F.struct("_n", "leader")).alias("leader"))
    links = stage(verified(pairs, seqs), "links")
    both = open_sketches(held, components(links))
    # texts outside the largest class of a sketch meet that class's first text: most near copies that are left join it
    sizes = both.groupBy("key", "class_id").agg(F.count(F.lit(1)).alias("_n"), F.min("doc").alias("leader"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("_n", "class_id", "leader")).alias("_m"))
    others = both.join(largest, "key").where("class_id != _m.class_id").select("doc", "_m.leader").distinct()
    links = links.unionByName(stage(verified(others, seqs), "links"))
    first = components(links)
    both = open_sketches(held, first)
    small_batches(spark, 16)
    found = stage(chunked(both, seqs), "links")
    small_batches(spark)
    later = components(found.select(F.col("one").alias("doc"), F.col("two").alias("leader")).distinct())
    later = later.select(F.col("doc").alias("_old"), F.col("class_id").alias("_new"))
    # classes of the first step that have grown together, and documents that had none
    moved = first.join(later, F.col("class_id") == F.col("_old"), "left").select(
        "doc", F.coalesce("_new", "class_id").alias("class_id"))
    alone = later.select(F.col("_old").alias("doc"), F.col("_new").alias("class_id")).join(
        first.select("doc"), "doc", "left_anti")
    return moved.unionByName(alone)


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id, raw, n_words`` of every row with its class's first row (``_first``: id and ``raw``).

    Rows without an id, or without words, have no class.
    """
    sketched = stage(sketch(docs.select("doc_id", "text")), "sketches")
    parts = linked(docs, sketched)
    texts = sketched.where("n_words > 0 and doc_id is not null").groupBy("t").agg(
        F.min(F.struct("doc_id", "raw")).alias("_least"))
    named = texts.join(parts.withColumnRenamed("doc", "t"), "t", "left").select(
        "t", "_least", F.coalesce("class_id", "t").alias("_class"))
    first = named.groupBy("_class").agg(F.min("_least").alias("_first"))
    named = named.join(first, "_class").select(F.col("t").alias("_t"), "_first")
    with_class = F.when((F.col("n_words") > 0) & F.col("doc_id").isNotNull(), F.col("t"))
    return sketched.withColumn("_t", with_class).join(named, "_t", "left").select("doc_id", "raw", "n_words", "_first")


def classes(docs: DataFrame) -> DataFrame:
    """One row per document with its class, named by the class's smallest id.

    Null texts and texts without words, and rows without an id, are classes of their
    own.  Texts of fewer than four words match equal words only.  Repeated rows share
    a class; rows of one id are judged each by its own text; no rows give none.  Other
    columns are left out.
    """
    return judged(docs).select("doc_id", F.coalesce("_first.doc_id", "doc_id").alias("class_id"), "n_words")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, that come first in their class; rows without an id stay.

    The first is the one of the smallest id.  Rows equal in id and text are one document:
    any one of them stays.  Rows that share an id but not their text are judged each by its own.
    """
    rows = stage(judged(docs).where("doc_id is not null"), "classes")
    place = F.struct("doc_id", "raw")
    dropped = stage(rows.where(place != F.col("_first")).select(F.col("doc_id").alias("_gone"), F.col("raw").alias("_raw")).distinct(),
                    "copies")
    places = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    key, text = places["doc_id"], places["text"]
    moved = docs.toDF(*places.values()).withColumn("raw", raw_digest(text))
    again = rows.groupBy("doc_id", "raw").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    again = stage(again.select(F.col("doc_id").alias("_again"), F.col("raw").alias("_same")), "repeated-rows")
    # rows that surely stay, which are most, are not shuffled
    moved = marked(moved, "raw", dropped.select("_raw").unionByName(again.select(F.col("_same").alias("_raw"))), "_may")
    sure, left = (moved.where(c).drop("_may") for c in (~F.col("_may"), F.col("_may")))
    left = left.join(dropped, (F.col("_gone") == F.col(key)) & (F.col("_raw") == F.col("raw")), "left_anti")
    if not again.isEmpty():
        met = (F.col(key) == F.col("_again")) & (F.col("raw") == F.col("_same"))
        repeated = left.join(again, met, "left_semi").dropDuplicates([key, "raw"])
        left = left.join(again, met, "left_anti").unionByName(repeated)
    left = sure.unionByName(left)
    return left.drop("raw").toDF(*docs.columns)
