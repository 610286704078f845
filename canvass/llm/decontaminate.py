"""Benchmark decontamination with suffix arrays.

Documents are cut into shards of a bounded number of words.  Each shard gets a
suffix array over its words; every suffix of every benchmark item is searched in
it by bisection, which gives the range of places where its first window stands, and
from there the longest verbatim matches.  Words that no item holds end a suffix, so the
array keeps only places that a match can reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.llm.common import stage, words_udf_table

WINDOW = 10
SHARD_WORDS = 1_000_000  # a longer document is a shard of its own
BLOCK_BYTES = 32_000_000  # benchmark text held by a task at a time
ASKED = 500_000  # suffixes bisected at a time
LETTERS = words_udf_table(bytes(range(48, 58)) + bytes(range(97, 123)))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and all other characters beyond ASCII."""
    return (text or "").encode().translate(LETTERS).split()


class Items:
    """A block of benchmark items as one row of word numbers, from 1, an item after the other.

    A suffix is a place in it, so memory grows with the words of the block, whatever
    the longest item is.
    """

    def __init__(self, items: list[tuple[str, str]], window: int):
        import numpy as np

        self.window, self.names, self.vocabulary = window, [], {}
        rows = []
        for name, text in items:
            ws = words_of(text)
            if ws:
                self.names.append(name)
                rows.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], np.int32))
        sizes = np.array([len(r) for r in rows], np.int64)
        self.longest = int(sizes.max()) if len(rows) else 0
        self.flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.owner = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
        ends = np.cumsum(sizes)
        # how many words each suffix has, and how much of it makes a window
        self.lengths = np.repeat(ends, sizes) - np.arange(len(self.flat))
        whole = self.lengths == np.repeat(sizes, sizes)
        self.need = np.where(self.lengths >= window, window, np.where(whole, self.lengths, 0))


def suffix_array(words, longest: int):
    """Places with a word number above 0, ordered by the ``longest`` words that follow (prefix doubling)."""
    import numpy as np

    rank = words.astype(np.int64)
    places = np.flatnonzero(rank)
    known = 1
    while known < longest and len(places):
        ahead = np.zeros(len(places), np.int64)
        inside = places + known < len(rank)
        ahead[inside] = rank[places[inside] + known]
        pair = rank[places] * (rank.max() + 1) + ahead
        values, new = np.unique(pair, return_inverse=True)
        rank = np.zeros(len(rank), np.int64)
        rank[places] = new + 1
        known *= 2
        if len(values) == len(places):
            break
    return places[np.argsort(rank[places], kind="stable")]


def compare(words, starts, flat, begins, upto):
    """Sign of (document suffix - item suffix) over ``upto`` words each, and how many words agree."""
    import numpy as np

    n = len(begins)
    sign, same = np.zeros(n, np.int64), np.zeros(n, np.int64)
    live, k = np.arange(n), 0
    while True:
        live = live[k < upto[live]]
        if not len(live):
            break
        at = starts[live] + k
        there = np.where(at < len(words), words[np.minimum(at, len(words) - 1)], 0)
        diff = there - flat[begins[live] + k]
        sign[live] = np.sign(diff)
        live = live[diff == 0]
        same[live] += 1
        k += 1
    return sign, same


def bounds(words, order, flat, begins, upto, after: bool):
    """Bisection of all suffixes at once: the first place not below (or beyond) each."""
    import numpy as np

    low, high = np.zeros(len(begins), np.int64), np.full(len(begins), len(order), np.int64)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        sign, _ = compare(words, order[np.minimum(mid, len(order) - 1)], flat, begins, upto)
        right = open_ & ((sign < 0) | ((sign == 0) & after))
        low = np.where(right, mid + 1, low)
        high = np.where(open_ & ~right, mid, high)
    return low


def search_shard(items: Items, texts: list[list[bytes]]):
    """For each text: words, words hit, names of items found, longest match, its place and its item."""
    import numpy as np

    sizes = [len(t) for t in texts]
    begins = np.concatenate([[0], np.cumsum([s + 1 for s in sizes])]).astype(np.int64)
    words = np.zeros(begins[-1], np.int64)  # a 0 after each text keeps matches inside it
    get = items.vocabulary.get
    for t, begin in zip(texts, begins, strict=False):
        words[begin:begin + len(t)] = [get(w, 0) for w in t]
    found: list[set] = [set() for _ in texts]
    best: list[tuple] = [(0, None, None)] * len(texts)
    hits = np.zeros(len(words) + 1, np.int64)
    order = suffix_array(words, items.longest)
    asked = np.flatnonzero(items.need) if len(order) else np.zeros(0, np.int64)
    last, starts_before, same_before = -2, None, None
    for part in np.array_split(asked, -(-len(asked) // ASKED) or 1):  # bounded memory, however large the block
        low = bounds(words, order, items.flat, part, items.need[part], False)
        high = bounds(words, order, items.flat, part, items.need[part], True)
        met = low < high
        for i, a, b in zip(part[met].tolist(), low[met], high[met], strict=True):
            starts = np.sort(order[a:b])
            np.add.at(hits, starts, 1)
            np.add.at(hits, starts + items.need[i], -1)
            name, docs = items.names[items.owner[i]], np.searchsorted(begins, starts, "right") - 1
            # how far each occurrence agrees with the rest of the item; one that goes on from the
            # place before has a word less than there, and was longer there
            same, new = np.zeros(len(starts), np.int64), np.ones(len(starts), bool)
            if last == i - 1 and items.owner[last] == items.owner[i]:
                at = np.minimum(np.searchsorted(starts_before, starts - 1), len(starts_before) - 1)
                new = starts_before[at] != starts - 1
                same = same_before[at] - 1
            _, same[new] = compare(words, starts[new], items.flat, np.full(new.sum(), i), np.full(new.sum(), items.lengths[i]))
            last, starts_before, same_before = i, starts, same
            for d in np.unique(docs).tolist():
                found[d].add(name)
            for d, n, place in zip(docs[new].tolist(), same[new].tolist(), (starts - begins[docs])[new].tolist(), strict=True):
                best[d] = longer(best[d], (n, place, name))
    covered = np.cumsum(hits[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    doc_of = np.searchsorted(begins, edges[::2], "right") - 1
    spans = [[] for _ in texts]
    for d, a, b in zip(doc_of, edges[::2], edges[1::2], strict=True):
        spans[d] += [int(a - begins[d]), int(b - begins[d])]
    out = []
    for d, n in enumerate(sizes):
        out.append((n, spans[d], sorted(found[d]), *best[d]))
    return out


def longer(a: tuple, b: tuple) -> tuple:
    """The longer of two matches (words, place, item); ties: the earlier place, then the lower name."""
    if not a[0] or not b[0]:
        return b if b[0] else a
    return min(a, b, key=lambda m: (-m[0], m[1], m[2]))


def merged(a: list[int], b: list[int]) -> list[int]:
    """Union of two lists of word spans ``[begin, end, begin, end, ...]``."""
    out: list[int] = []
    for begin, end in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and begin <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [begin, end]
    return out


def joined(old: tuple, new: tuple) -> tuple:
    """Results of one document over two blocks of items."""
    return (new[0], merged(old[1], new[1]), sorted({*old[2], *new[2]}), *longer(tuple(old[3:]), tuple(new[3:])))


def blocks_of(benchmark: DataFrame, size: int = BLOCK_BYTES):
    """The benchmark in blocks of bounded bytes, one in memory at a time."""
    block, held = [], 0
    for r in benchmark.select(F.col("item_id").cast("string"), "text").where("text is not null").toLocalIterator():
        block.append((r[0] or "", r[1]))
        held += len(r[1].encode())
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


MATCHES = ("n_words long, hit_spans array<long>, items array<string>, longest long, longest_at long, "
           "longest_item string")


def _one_block(moved: DataFrame, items: list[tuple[str, str]], window: int, at: int, again: bool) -> DataFrame:
    """Matches of one block next to the rows; ``again``: put together with those of earlier blocks."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    sent = moved.sparkSession.sparkContext.broadcast(items)  # at most BLOCK_BYTES of text
    added = T._parse_datatype_string(MATCHES)
    kinds = [to_arrow_type(f.dataType) for f in added]
    kept = moved.columns[:-len(added)] if again else moved.columns

    def run(batches):
        block = Items(sent.value, window)

        def flush(held, texts):
            got, done = search_shard(block, texts), 0
            for b in held:
                part = got[done:done + b.num_rows]
                done += b.num_rows
                if again:
                    old = zip(*[b.column(len(kept) + k).to_pylist() for k in range(len(kinds))], strict=True)
                    part = [joined(o, n) for o, n in zip(old, part, strict=True)]
                columns = [b.column(i) for i in range(len(kept))]
                columns += [pa.array([r[k] for r in part], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *added.names])

        held, texts, total = [], [], 0
        for b in batches:
            held.append(b)
            for t in b.column(at).to_pylist():
                texts.append(words_of(t))
                total += len(texts[-1])
            if total >= SHARD_WORDS:
                yield from flush(held, texts)
                held, texts, total = [], [], 0
        if held:
            yield from flush(held, texts)

    return moved.mapInArrow(run, T.StructType([*[moved.schema[c] for c in kept], *added.fields]))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text",
            block_bytes: int = BLOCK_BYTES):
    """Attach the columns of ``MATCHES`` to the rows, without a join or shuffle.

    Gives the frame, in which input columns are called ``_0``, ``_1``, ..., and a
    function that restores them.  Null and empty texts have no words and no matches;
    so has everything when the benchmark is empty.  Null or empty items match
    nothing, and short items are one window.  Repeated rows are judged each for
    itself.  A benchmark of several blocks takes a written pass over the rows each.
    """
    names = docs.columns
    places = [f"_{i}" for i in range(len(names))]
    frame, again = docs.toDF(*places), False
    for block in blocks_of(benchmark, block_bytes):
        frame = stage(frame, "block") if again else frame
        frame, again = _one_block(frame, block, window, names.index(text), again), True
    if not again:
        frame = _one_block(frame, [], window, names.index(text), False)
    return frame, lambda f: f.select(*[F.col(p).alias(n) for p, n in zip(places, names, strict=True)])


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: words, spans of words inside a window of an item, items, longest match."""
    frame, _ = matches(docs.select("doc_id", "text"), benchmark, window)
    return frame.select(F.col("_0").alias("doc_id"), *T._parse_datatype_string(MATCHES).names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, that hold no window of any item."""
    frame, restored = matches(docs, benchmark, window)
    return restored(frame.where(F.size("items") == 0))


def n_hit(spans: str = "hit_spans"):
    """Words inside the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda done, x: x - done)


def items_digest(items: str = "items"):
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)
