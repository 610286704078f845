"""Language-model scores from a trigram trie of Elias-Fano coded levels.

The trie has a level of words, one of their successors, and one of the successors of
word pairs.  The lower levels are cut into shards by context; the successors of a
context that is very frequent are dealt out over further shards.  A shard holds, in
flat buffers that can be viewed in place: its contexts, monotone pointers to their
successors, the successors as one monotone sequence, and quantised probabilities and
back-off weights.  A successor is looked for in its context's range only, as the
pointers give it.  A pair is a context of the last level if training documents hold it
``CONTEXT_COUNT`` times or more; it is named there by its place in its shard.

Texts stay where they are: blocks of documents send each shard the distinct n-grams
they hold, with their counts in training documents, and get back what the shard
knows of them.  So a task holds a block or a shard, whatever the size of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.llm.common import slices, stage
from canvass.llm.near_dups import mix, word_hashes

BLOCK_TOKENS = 1_000_000
SHARD_KEYS = 1_000_000
CONTEXT_COUNT = 2  # the model's count cut-off: rarer pairs are no contexts of the last level
PRIOR = 10.0  # a context's own counts weigh count / (count + PRIOR), the words' frequencies the rest
STEP = 4096  # probabilities are kept as whole parts of a decade, 16 bits
UNSEEN = 65535
FOLDS, HELD_OUT = 5, 1
END = 0  # stands for the end of a text among word numbers

BLOCK = ("block long, docs array<string>, held array<boolean>, lengths array<int>, n_tokens long, n_train long, "
         "n_words long, vocabulary binary, train_counts binary, tokens binary")
SENT = ["block", "held", "lengths", "tokens"]  # what of a block meets the answers
ASKED = "shard long, block long, keys binary, counts binary, totals binary"
ANSWER = "level int, block long, shard long, codes binary, places binary, known long"


# --- Elias-Fano sequences
class EliasFano:
    """A sorted sequence: low bits side by side, high bits in unary, and how many zeros precede each byte."""

    def __init__(self, buffer, at: int = 0):
        import numpy as np

        self.n, self.low_bits, n_low, n_high = (int(x) for x in np.frombuffer(buffer, np.int64, 4, at))
        at += 32
        self.low = np.ndarray(n_low - 7, np.uint64, buffer, at, (1,))  # the eight bytes from each byte on
        self.high = np.frombuffer(buffer, np.uint64, n_high // 8, at + n_low)
        self.zeros = np.frombuffer(buffer, np.int64, n_high // 8 + 1, at + n_low + n_high)
        self.end = at + n_low + n_high + self.zeros.nbytes

    @staticmethod
    def pack(values) -> bytes:
        import numpy as np

        values = values.astype(np.uint64)
        n = len(values)
        most = int(values[-1]) if n else 0
        bits = max(0, (most // n).bit_length() - 1) if n else 0
        low = np.zeros(0, np.uint8)
        if bits:
            parts = [((values >> np.uint64(k)) & np.uint64(1)).astype(np.uint8) for k in range(bits)]
            low = np.packbits(np.stack(parts, axis=1).ravel(), bitorder="little")
        low = np.concatenate([low, np.zeros(-len(low) % 8 + 8, np.uint8)])
        top = (values >> np.uint64(bits)).astype(np.int64)
        unary = np.zeros((int(top[-1]) if n else 0) + n + 1, np.uint8)
        unary[top + np.arange(n)] = 1
        high = np.packbits(unary, bitorder="little")
        high = np.concatenate([high, np.zeros(-len(high) % 8, np.uint8)])
        ones = np.bitwise_count(high).astype(np.int64).reshape(-1, 8).sum(axis=1)
        zeros = np.concatenate([[0], np.cumsum(64 - ones)]).astype(np.int64)
        return np.array([n, bits, len(low), len(high)], np.int64).tobytes() + low.tobytes() + high.tobytes() + zeros.tobytes()

    def _low(self, i):
        import numpy as np

        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        return (self.low[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def _select(self, k, one: bool):
        """Place of the k-th zero or one (from 0) among the high bits, for all k at once."""
        import numpy as np

        before = np.arange(len(self.zeros)) * 64 - self.zeros if one else self.zeros
        word = np.clip(np.searchsorted(before, k, "right") - 1, 0, len(before) - 2)
        rest = k - before[word]
        bits = self.high[word] if one else ~self.high[word]
        place = word * 64
        for size in (32, 16, 8, 4, 2, 1):  # halve the word until it is found
            count = np.bitwise_count(bits & np.uint64((1 << size) - 1)).astype(np.int64)
            beyond = rest >= count
            rest = rest - count * beyond
            bits = bits >> (beyond * np.uint64(size))
            place = place + beyond * size
        return place

    def successor(self, x, within=None):
        """Index of the first value that is not below each ``x``, and whether it equals it.

        ``within`` gives the ranges (first, end) that are searched.
        """
        import numpy as np

        x = np.asarray(x, np.uint64)
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        top = (x >> np.uint64(self.low_bits)).astype(np.int64)
        rest = x & np.uint64((1 << self.low_bits) - 1)
        buckets = int(len(self.high) * 64 - self.n)  # zeros, those of the padding too
        start = np.where(top > 0, self._select(np.clip(top - 1, 0, buckets - 1), False) - top + 1, 0)
        stop = self._select(np.clip(top, 0, buckets - 1), False) - top
        start, stop = (np.where(top >= buckets, self.n, np.minimum(v, self.n)) for v in (start, stop))
        if within is not None:
            start, stop = (np.clip(v, *within) for v in (start, stop))
        low, high = start, stop
        while (open_ := low < high).any():
            mid = (low + high) // 2
            less = open_ & (self._low(np.minimum(mid, self.n - 1)) < rest)
            low = np.where(less, mid + 1, low)
            high = np.where(open_ & ~less, mid, high)
        found = (low < stop) & (self._low(np.minimum(low, self.n - 1)) == rest)
        return low, found

    def values(self, i):
        """The values at the places ``i``."""
        import numpy as np

        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        return ((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)


class Successors:
    """One shard of a level, read from a flat buffer (bytes, or a mapped file)."""

    def __init__(self, buffer):
        import numpy as np

        self.span, weighed = (int(x) for x in np.frombuffer(buffer, np.int64, 2))
        self.contexts = EliasFano(buffer, 16)
        self.pointers = EliasFano(buffer, self.contexts.end)
        self.words = EliasFano(buffer, self.pointers.end)
        self.codes = np.frombuffer(buffer, np.uint16, self.words.n, self.words.end)
        self.weights = np.frombuffer(buffer, np.uint16, self.words.n if weighed else 0, self.words.end + self.codes.nbytes)

    @staticmethod
    def pack(contexts, words, codes, span: int, weights=None) -> bytes:
        """Sorted by context and word; ``span`` is above every word number.

        ``weights``: back-off weights of those that are contexts of the next level, else ``UNSEEN``.
        """
        import numpy as np

        own, first = np.unique(contexts, return_index=True)
        rank = np.repeat(np.arange(len(own)), np.diff(np.append(first, len(contexts))))
        pointers = np.append(first, len(contexts))
        return (np.array([span, weights is not None], np.int64).tobytes() + EliasFano.pack(own) + EliasFano.pack(pointers)
                + EliasFano.pack(rank.astype(np.uint64) * np.uint64(span) + words.astype(np.uint64)) + codes.tobytes()
                + (b"" if weights is None else weights.tobytes()))

    def place(self, contexts, words):
        """Places of the n-grams (sorted by context) in the level, -1 where there are none."""
        import numpy as np

        out = np.full(len(contexts), -1, np.int64)
        first = np.concatenate([[True], contexts[1:] != contexts[:-1]])[:len(contexts)]
        each, of = contexts[first], np.cumsum(first) - 1
        which, known = self.contexts.successor(each)
        which = np.where(known, which, 0)
        first = self.pointers.values(which).astype(np.int64)
        end = self.pointers.values(which + known).astype(np.int64)
        asked = known[of]
        of = of[asked]
        at, found = self.words.successor(which[of].astype(np.uint64) * np.uint64(self.span) + words[asked].astype(np.uint64),
                                         (first[of], end[of]))
        out[asked] = np.where(found, at, -1)
        return out

    def find(self, contexts, words):
        """Codes of the n-grams, ``UNSEEN`` where there are none."""
        return at_place(self.codes, self.place(contexts, words))


def at_place(codes, place):
    import numpy as np

    return np.where(place >= 0, codes[np.maximum(place, 0)], UNSEEN).astype(np.uint16) if len(codes) else np.full(
        len(place), UNSEEN, np.uint16)


def planes(values, kind) -> bytes:
    """Whole numbers byte by byte, first all lowest bytes and so on, and compressed."""
    import numpy as np
    import zstandard

    v = np.ascontiguousarray(values, kind)
    return zstandard.compress(np.ascontiguousarray(v.view(np.uint8).reshape(-1, v.itemsize).T), 1) if len(v) else b""


def unplanes(raw: bytes, kind):
    import numpy as np
    import zstandard

    size = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.decompress(raw) if raw else b"", np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel()


def sorted_planes(keys) -> bytes:
    import numpy as np

    return planes(np.diff(keys, prepend=np.uint64(0)), np.uint64)


def sorted_unplanes(raw: bytes):
    import numpy as np

    return np.cumsum(unplanes(raw, np.uint64), dtype=np.uint64)


# --- blocks of documents
def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT


def blocks(docs: DataFrame) -> DataFrame:
    """Documents as blocks: word hashes, and each token's place among them."""
    import pyarrow as pa

    def run(batches):
        import numpy as np
        import pyarrow.compute as pc
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, held, counts, words, total = [], [], [], [], 0

        def block():
            coded = pa.concat_arrays(words).dictionary_encode()  # a word is hashed once
            hashes = word_hashes(coded.dictionary.cast(pa.large_binary()).to_pylist())
            vocabulary, places = np.unique(np.append(hashes, np.uint64(END)), return_inverse=True)
            lengths = np.array(counts)
            local = np.full(lengths.sum(), places[-1])
            inside = np.ones(len(local), bool)
            inside[np.cumsum(lengths) - 1] = False
            local[inside] = places[coded.indices.to_numpy()]
            train = np.repeat(~np.array(held, bool), lengths)
            seen = np.bincount(local[train], minlength=len(vocabulary))
            row = {"block": number, "docs": list(ids), "held": list(held), "lengths": lengths.tolist(), "n_tokens": len(local),
                   "n_train": int(train.sum()), "n_words": len(vocabulary), "vocabulary": sorted_planes(vocabulary),
                   "train_counts": planes(seen, np.uint32), "tokens": planes(local, np.uint32)}
            return pa.RecordBatch.from_pylist([row], schema=out_schema)

        for b in slices(batches, 2):
            split = pc.ascii_split_whitespace(pc.ascii_lower(b.column(2)))
            flat, offsets = split.flatten(), split.offsets.to_numpy()
            full = pc.not_equal(flat, "")  # space at either end of a text leaves an empty word
            ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[offsets - offsets[0]]
            flat, start = flat.filter(full), 0
            for i, (doc, out) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                ids.append(doc)
                held.append(out)
                counts.append(int(ends[i + 1] - ends[i]) + 1)  # with the end
                total += counts[-1]
                if total >= BLOCK_TOKENS:
                    words.append(flat.slice(start, int(ends[i + 1]) - start))
                    start = int(ends[i + 1])
                    yield block()
                    number += 1
                    ids, held, counts, words, total = [], [], [], [], 0
            words.append(flat.slice(start))
        if ids:
            yield block()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out_schema = to_arrow_schema(_parse_datatype_string(BLOCK))
    rows = docs.select(F.col("doc_id").cast("string").alias("doc"), held_out(F.col("doc_id")).alias("held"),
                       F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, BLOCK)


# --- first level
def word_requests(held: DataFrame, shards: int) -> DataFrame:
    def run(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            for r in f.itertuples():
                keys, counts = sorted_unplanes(r.vocabulary), unplanes(r.train_counts, np.uint32)
                # shards are ranges of hashes, so the answers side by side are in the order of the vocabulary
                shard = np.minimum(keys // np.uint64((2**64 - 1) // shards), np.uint64(shards - 1)).astype(np.int64)
                yield pd.DataFrame([(s, r.block, sorted_planes(keys[shard == s]), planes(counts[shard == s], np.uint32), b"")
                                    for s in np.unique(shard)], columns=["shard", "block", "keys", "counts", "totals"])

    return held.select("block", "vocabulary", "train_counts").mapInPandas(run, ASKED)


def answer_words(asked: DataFrame) -> DataFrame:
    """Per shard: the number of each word in training documents and its place in the shard."""
    def run(key, frame):
        import numpy as np
        import pandas as pd

        keys = [sorted_unplanes(x) for x in frame["keys"]]
        words, which = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(which, weights=np.concatenate([unplanes(x, np.uint32) for x in frame["counts"]]).astype(float),
                             minlength=len(words)).astype(np.int64)
        known = counts > 0
        place = np.where(known, np.cumsum(known) - 1, -1)
        out, at = [], 0
        for b, k in zip(frame["block"], keys, strict=True):
            mine = which[at:at + len(k)]
            at += len(k)
            codes = planes(np.concatenate([counts[mine], place[mine]]), np.int64)
            out.append((1, b, key[0], codes, b"", int(known.sum()) if not out else 0))
        return pd.DataFrame(out, columns=["level", "block", "shard", "codes", "places", "known"])

    return asked.groupBy("shard").applyInPandas(run, ANSWER)


def words_of_block(answers, shards: int):
    """Training counts and word numbers (-1: not in training) of a block's vocabulary."""
    import numpy as np

    counts, numbers = [], []
    for r in answers[answers["level"] == 1].sort_values("shard").itertuples():
        count, place = np.split(unplanes(r.codes, np.int64), 2)
        counts.append(count)
        numbers.append(np.where(place >= 0, place * shards + r.shard, -1))
    return np.concatenate(counts), np.concatenate(numbers)


def bigrams_of_block(block, counts, number, span: int, shards: int, hot: int):
    """Distinct bigrams of known words: key, count in training documents, shard; and each token's bigram or -1."""
    import numpy as np

    tokens = unplanes(block["tokens"], np.uint32).astype(np.int64)
    lengths = np.array(block["lengths"], np.int64)
    inside = np.ones(len(tokens), bool)
    inside[np.cumsum(lengths) - lengths] = False  # the first token of a text has no context
    before = np.concatenate([[0], tokens[:-1]])
    ok = inside & (number[tokens] >= 0) & (number[before] >= 0)
    places = np.flatnonzero(ok)
    keys = number[before[places]].astype(np.uint64) * np.uint64(span) + number[tokens[places]].astype(np.uint64)
    own, which = np.unique(keys, return_inverse=True)
    train = np.repeat(~np.array(block["held"], bool), lengths)[places]
    seen = np.bincount(which[train], minlength=len(own))
    totals = np.zeros(len(own), np.int64)
    totals[which] = counts[before[places]]
    context = own // np.uint64(span)
    dealt = np.where(totals > hot, mix(own + np.uint64(1)), mix(context + np.uint64(1)))
    of_token = np.full(len(tokens), -1, np.int64)
    of_token[places] = which
    return own, seen, totals, (dealt % np.uint64(shards)).astype(np.int64), of_token, tokens, before


def by_shard(shard):
    """Each shard with the places of what goes there, in their order."""
    import numpy as np

    narrow = shard.astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard  # these are sorted by counting
    order = np.argsort(narrow, kind="stable")
    ends = np.flatnonzero(np.diff(shard[order])) + 1
    return [(int(shard[mine[0]]), mine) for mine in np.split(order, ends) if len(mine)]


# --- second level
def bigram_requests(held: DataFrame, answers: DataFrame, one: dict, two: dict) -> DataFrame:
    def run(key, block, got):
        import numpy as np
        import pandas as pd

        b = block.iloc[0]
        counts, number = words_of_block(got, one["shards"])
        own, seen, totals, shard, _, _, _ = bigrams_of_block(b, counts, number, **two)
        out = []
        for s, mine in by_shard(shard):
            context = own[mine] // np.uint64(two["span"])
            first = np.concatenate([[True], context[1:] != context[:-1]])
            out.append((s, b["block"], sorted_planes(own[mine]), planes(seen[mine], np.uint32),
                        planes(totals[mine][first], np.int64)))
        return pd.DataFrame(out, columns=["shard", "block", "keys", "counts", "totals"])

    return held.select(*SENT).groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, ASKED)


def quantised(probability):
    """Codes of probabilities, the lowest one for those below the range."""
    import numpy as np

    return np.minimum(np.rint(-np.log10(probability) * STEP), UNSEEN - 1).astype(np.uint16)


def pack_shard(frame, span: int) -> tuple:
    """The second level of a shard, its distinct keys, and which of them each block asked."""
    import numpy as np

    keys = [sorted_unplanes(x) for x in frame["keys"]]
    totals = []
    for k, raw in zip(keys, frame["totals"], strict=True):
        context = k // np.uint64(span)
        totals.append(unplanes(raw, np.int64)[np.cumsum(np.concatenate([[0], context[1:] != context[:-1]])).astype(np.int64)])
    own, first, seen, asked = counted(frame, keys)
    total = np.concatenate(totals)[first]
    kept = seen > 0
    codes = quantised(seen[kept] / (total[kept] + PRIOR))
    weights = np.where(seen[kept] >= CONTEXT_COUNT, quantised(PRIOR / (seen[kept] + PRIOR)), UNSEEN).astype(np.uint16)
    return Successors.pack(own[kept] // np.uint64(span), own[kept] % np.uint64(span), codes, span, weights), own, asked


def counted(frame, keys):
    """Distinct keys of a shard, the first place of each, their training counts over all blocks, and which each block asked."""
    import numpy as np

    own, first, which = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    counts = np.concatenate([unplanes(x, np.uint32) for x in frame["counts"]]).astype(float)
    return own, first, np.bincount(which, weights=counts, minlength=len(own)), np.split(which, np.cumsum([len(k) for k in keys])[:-1])


def answer_bigrams(asked: DataFrame, span: int) -> DataFrame:
    """Per pair its code, and of the contexts of the last level their places among those of the shard."""
    def run(key, frame):
        import numpy as np
        import pandas as pd

        packed, own, asked_by = pack_shard(frame, span)
        level = Successors(packed)
        place = level.place(own // np.uint64(span), own % np.uint64(span))  # an n-gram is looked for once
        codes, is_context = at_place(level.codes, place), at_place(level.weights, place) != UNSEEN
        among = np.cumsum(is_context) - 1
        out = [(2, b, key[0], planes(codes[mine], np.uint16), sorted_planes(among[mine[is_context[mine]]].astype(np.uint64)), 0)
               for b, mine in zip(frame["block"], asked_by, strict=True)]
        return pd.DataFrame(out, columns=["level", "block", "shard", "codes", "places", "known"])

    return asked.groupBy("shard").applyInPandas(run, ANSWER)


def pairs_of_block(answers, own, shard, totals):
    """Codes, back-off weights and places of a block's distinct pairs.

    A pair's count follows from its code and the count of its first word (exactly so
    for counts that a step of the codes can tell apart), and its weight from that.
    """
    import numpy as np

    codes, places = np.full(len(own), UNSEEN, np.uint16), np.full(len(own), -1, np.int64)
    weights = np.full(len(own), UNSEEN, np.uint16)
    mine, answers = dict(by_shard(shard)), answers[answers["level"] == 2]
    for r in answers.itertuples():
        codes[mine[r.shard]] = unplanes(r.codes, np.uint16)
    seen = np.rint(probabilities(codes) * (totals + PRIOR))
    context = seen >= CONTEXT_COUNT
    weights[context] = quantised(PRIOR / (seen[context] + PRIOR))
    for r in answers.itertuples():
        places[mine[r.shard][context[mine[r.shard]]]] = sorted_unplanes(r.places).astype(np.int64)
    return codes, weights, places


# --- last level
def trigrams_of_block(block, number, of_token, tokens, weights, places, shard, span: int, shards: int, hot: int):
    """Distinct trigrams with a known context: shard, key there, training count, context weight; each token's or -1.

    A context's shard is that of its pair, so keys are relative to it; a context with
    more than ``hot`` tokens is dealt over as many shards as its count asks for.
    """
    import numpy as np

    context = np.concatenate([[-1], of_token[:-1]])
    inside = np.flatnonzero((of_token >= 0) & (context >= 0))
    inside = inside[places[context[inside]] >= 0]
    local = context[inside].astype(np.uint64) * np.uint64(span) + number[tokens[inside]].astype(np.uint64)
    own, which = np.unique(local, return_inverse=True)
    held = np.repeat(np.array(block["held"], bool), np.array(block["lengths"], np.int64))[inside]
    seen = np.bincount(which[~held], minlength=len(own))
    pair, word = (own // np.uint64(span)).astype(np.int64), own % np.uint64(span)
    found = PRIOR * 10.0 ** (weights[pair].astype(float) / STEP) - PRIOR
    parts = np.maximum(1, np.ceil(found / hot)).astype(np.uint64)
    # pairs are in the order of their places, so what goes to a shard is in the order of its keys
    group = shard[pair] + shards * (mix(word + np.uint64(1)) % parts).astype(np.int64)
    of_all = np.full(len(tokens), -1, np.int64)
    of_all[inside] = which
    return group, places[pair].astype(np.uint64) * np.uint64(span) + word, seen, weights[pair], of_all


def trigram_requests(held: DataFrame, answers: DataFrame, one: dict, two: dict) -> DataFrame:
    def run(key, block, got):
        import numpy as np
        import pandas as pd

        b = block.iloc[0]
        counts, number = words_of_block(got, one["shards"])
        own, _, totals, shard, of_token, tokens, _ = bigrams_of_block(b, counts, number, **two)
        _, weights, places = pairs_of_block(got, own, shard, totals)
        group, keys, seen, weight, _ = trigrams_of_block(
            b, number, of_token, tokens, weights, places, shard, **two)
        out = [(s, b["block"], sorted_planes(keys[mine]), planes(seen[mine], np.uint32), planes(weight[mine], np.uint16))
               for s, mine in by_shard(group)]
        return pd.DataFrame(out, columns=["shard", "block", "keys", "counts", "totals"])

    return held.select(*SENT).groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, ASKED)


def answer_trigrams(asked: DataFrame, span: int) -> DataFrame:
    def run(key, frame):
        import numpy as np
        import pandas as pd

        keys = [sorted_unplanes(x) for x in frame["keys"]]
        own, first, seen, asked_by = counted(frame, keys)
        weight = np.concatenate([unplanes(x, np.uint16) for x in frame["totals"]])[first].astype(float)
        kept = seen > 0
        codes = quantised(seen[kept] / PRIOR * 10.0 ** (-weight[kept] / STEP))
        level = Successors(Successors.pack(own[kept] // np.uint64(span), own[kept] % np.uint64(span), codes, span))
        found = level.find(own // np.uint64(span), own % np.uint64(span))
        return pd.DataFrame([(3, b, key[0], planes(found[mine], np.uint16), b"", 0)
                             for b, mine in zip(frame["block"], asked_by, strict=True)],
                            columns=["level", "block", "shard", "codes", "places", "known"])

    return asked.groupBy("shard").applyInPandas(run, ANSWER)


def model(asked: DataFrame, span: int) -> DataFrame:
    """The packed second level itself, a row per shard, to be kept."""
    def run(key, frame):
        import pandas as pd

        return pd.DataFrame([(key[0], pack_shard(frame, span)[0])], columns=["shard", "level"])

    return asked.groupBy("shard").applyInPandas(run, "shard long, level binary")


def probabilities(codes):
    """What the codes stand for, 0 for ``UNSEEN``."""
    import numpy as np

    return np.append(10.0 ** (np.arange(UNSEEN) / -STEP), 0.0)[codes]


def decoded(codes, places):
    """Probabilities of the codes at the places, 0 where there is none."""
    return probabilities(at_place(codes, places))


def scored(held: DataFrame, answers: DataFrame, one: dict, two: dict, total: int, distinct: int, key_type: str) -> DataFrame:
    def run(key, block, got):
        import numpy as np
        import pandas as pd

        b = block.iloc[0]
        counts, number = words_of_block(got, one["shards"])
        own, _, totals, shard, of_token, tokens, before = bigrams_of_block(b, counts, number, **two)
        codes, weights, places = pairs_of_block(got, own, shard, totals)
        group, keys, _, _, of_three = trigrams_of_block(
            b, number, of_token, tokens, weights, places, shard, **two)
        third = np.full(len(keys), UNSEEN, np.uint16)
        if len(keys):
            answered = {r.shard: r.codes for r in got[got["level"] == 3].itertuples()}
            for s, mine in by_shard(group):
                third[mine] = unplanes(answered[s], np.uint16)
        base = (counts + 0.5) / (total + 0.5 * (distinct + 1))
        alone = base[tokens]
        lengths = np.array(b["lengths"], np.int64)
        starts = np.cumsum(lengths) - lengths
        context = counts[before].astype(float)
        context[starts] = 0
        rest = PRIOR / (context + PRIOR)  # 1 without a context, or with one that is not in training
        both = decoded(codes, of_token) + rest * alone
        pair = np.concatenate([[-1], of_token[:-1]])  # the pair before a token; none at a text's first two
        pair[starts] = -1
        weight = decoded(np.where(places >= 0, weights, UNSEEN), pair)
        both = np.where(weight > 0, decoded(third, of_three) + weight * both, both)
        return pd.DataFrame({
            "doc": b["docs"], "held_out": b["held"], "n_tokens": lengths,
            "n_known": np.add.reduceat((counts[tokens] > 0).astype(np.int64), starts), "train_tokens": total,
            "base_score": np.add.reduceat(np.log10(alone), starts), "score": np.add.reduceat(np.log10(both), starts)})

    out = held.select("docs", *SENT).groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        run, "doc string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("doc_id", F.col("doc").cast(key_type)).drop("doc")


def fit(docs: DataFrame):
    """Blocks, first-level answers, second-level requests and the sizes they were made with."""
    held = stage(blocks(docs), "blocks")
    size = held.agg(F.sum("n_words"), F.sum("n_train"), F.sum("n_tokens")).first()
    one = {"shards": max(1, -(-(size[0] or 0) // SHARD_KEYS))}
    answers = stage(answer_words(word_requests(held, one["shards"])), "words")
    distinct = answers.agg(F.sum("known"), F.max("known")).first()
    two = {"span": ((distinct[1] or 0) + 1) * one["shards"], "shards": max(1, -(-(size[2] or 0) // SHARD_KEYS)),
           "hot": SHARD_KEYS // 4}
    asked = bigram_requests(held, answers, one, two)
    return held, answers, asked, one, two, size[1] or 0, distinct[0] or 0


def score(docs: DataFrame) -> DataFrame:
    """Learn from the training documents and score all of them.

    ``score`` is the log10 probability under words smoothed as in the base score,
    mixed with the successors of one word and of two.  A null text counts as empty: the end alone.  A null
    id counts as empty text when folds are drawn.  Without training documents every
    token is unknown.  Repeated rows count each for itself; other columns are left out.
    """
    held, answers, asked, one, two, total, distinct = fit(docs)
    answers = answers.unionByName(stage(answer_bigrams(asked, two["span"]), "successors"))
    third = answer_trigrams(trigram_requests(held, answers, one, two), two["span"])
    answers = answers.unionByName(stage(third, "last-level"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return scored(held, answers, one, two, total, distinct, kind)
