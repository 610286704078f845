"""Pack token sequences by histogram, shortest pack first.

Only the histogram of lengths (at most ``capacity`` numbers) reaches the driver.
Lengths are placed longest first; each goes onto the packs that are shortest so
far.  Packs of one make-up are one pattern with a count, so the plan's size
depends on the capacity alone.  Patterns meet the pieces again by the rank of a
piece among all pieces of its length.
"""

from __future__ import annotations

import heapq
import itertools
import re
import struct
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canvass.llm.common import BoundedCache, on_worker, slices, stage

END_ID = 1
CAPACITY = 2048
CACHE_BYTES = 96 << 20  # of words that a worker remembers; bounds memory, not results

PIECES = "start long, length long, doc_tokens long, ids_crc32 long, ids binary, rank_here long"


#: Latin letters that lower case and composition leave to themselves, and closing punctuation after one.
SMALL = "a-z\u00df-\u00f6\u00f8-\u00ff"
CLOSING = f"([{SMALL}])([.,;:!?|]+)(\\s|$)"
PLAIN = re.compile(f"[{SMALL}\u00c0-\u00d6\u00d8-\u00deA-Z]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be printed."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordIds:
    """Ids of white-space separated words, as little-endian unsigned 32-bit numbers.

    No token of this tokenizer spans white space, nor a letter and the punctuation that
    closes its word, so a text's ids are those of its words in a row.  Distinct words of a
    batch are found by Arrow; those lately used are remembered, in bounded memory.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = BoundedCache(CACHE_BYTES)
        self.letters = byte_letters()

    def batch(self, texts) -> list[bytes]:
        """The ids of each text of an Arrow column (or list); a null text is empty."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        odd = pc.match_substring(texts, "<|")  # may hold special tokens, which lower case would make or undo
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(
            pc.ascii_lower(pc.if_else(odd, "", texts)), pattern=CLOSING, replacement=r"\1 \2\3"))
        words = split.flatten().dictionary_encode()
        blobs = self.known.lookup(words.dictionary.to_pylist(), self._encode)
        ids = np.frombuffer(b"".join(blobs), "<u4")
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        which = words.indices.to_numpy()
        each = sizes[which]
        ends = np.cumsum(each)
        # where each token of each word lies among the ids of the distinct words
        at = np.arange(ends[-1] if len(ends) else 0)
        at += np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - each), each)
        raw = ids[at].tobytes()
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        bounds = (4 * np.concatenate([[0], ends])[offsets]).tolist()
        out = [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self._packed(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids)
        return out

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode(self, new: list[str]) -> list[bytes]:
        """A word of Latin letters is one pre-token, so the model alone is asked; others take the whole way."""
        done, rest = {}, []
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        for w in new:
            if PLAIN.fullmatch(w):
                shown = w if w.isascii() else w.lower().encode().decode("latin-1").translate(letters)
                done[w] = self._packed([t.id for t in tokenize(shown)])
            else:
                rest.append(w)
        for at in range(0, len(rest), 4096):
            part = rest[at:at + 4096]
            ids = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            done.update(zip(part, (self._packed(e.ids) for e in ids), strict=True))
        return [done[w] for w in new]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, text: str = "text",
           end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """The rows' ids, each row's last being ``end_id``, cut every ``capacity`` ids.

    ``rank_here`` numbers the pieces of one length within a partition.  A null text
    counts as empty: one piece that holds the end.  Without ``keep_ids`` their digest goes on alone.
    """
    import pyarrow as pa

    key_type = docs.schema["doc_id"].dataType

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        words = on_worker(("word_ids", tokenizer_path), lambda: WordIds(tokenizer_path))
        end = end_id.to_bytes(4, "little")
        ranks = [0] * (capacity + 1)
        kinds = [to_arrow_type(key_type), *[pa.int64()] * 4, pa.binary(), pa.int64()]
        for b in slices(batches, 1):
            out = [[] for _ in kinds]
            for doc, blob in zip(b.column(0).to_pylist(), words.batch(b.column(1)), strict=True):
                blob += end
                total = len(blob) // 4
                for start in range(0, total, capacity):
                    part = blob[start * 4:(start + capacity) * 4]
                    n = len(part) // 4
                    values = (doc, start, n, total, zlib.crc32(part), part if keep_ids else None, ranks[n])
                    for column, v in zip(out, values, strict=True):
                        column.append(v)
                    ranks[n] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(out, kinds, strict=True)],
                names=["doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids", "rank_here"])

    rows = docs.select("doc_id", F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {key_type.simpleString()}, {PIECES}")


def plan_packs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[list[int]]]]:
    """Patterns ``(count, [[length, how many], ...])``, longest lengths first, shortest packs first."""
    open_: list = []  # (-space left, order of making, count, pattern); the most space comes first
    made = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and open_ and -open_[0][0] >= length:
            space, _, count, pattern = heapq.heappop(open_)
            taken = min(left, count)
            if taken < count:
                heapq.heappush(open_, (space, made, count - taken, [list(p) for p in pattern]))
                made += 1
            if pattern[-1][0] == length:
                pattern[-1][1] += 1
            else:
                pattern.append([length, 1])
            heapq.heappush(open_, (space + length, made, taken, pattern))
            made += 1
            left -= taken
        if left:
            heapq.heappush(open_, (length - capacity, made, left, [[length, 1]]))
            made += 1
    return [(count, pattern) for _, _, count, pattern in sorted(open_, key=lambda p: p[1])]


def slots_of(patterns) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, first rank, rank after the last, how many a pack, first pack, offset in the pack)``."""
    rows, ranks, base = [], {}, 0
    for count, pattern in patterns:
        offset = 0
        for length, many in pattern:
            first = ranks.get(length, 0)
            ranks[length] = first + count * many
            rows.append((length, first, ranks[length], many, base, offset))
            offset += length * many
        base += count
    return rows


def pack(staged: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece of a written table its sequence and its offset in it.

    The table has ``length``, ``rank_here`` and ``part``, the partition that wrote it.
    """
    spark = staged.sparkSession
    sizes = staged.groupBy("length", "part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    before = stage(before, "rank-offsets")
    # at most one row for each length up to the capacity
    histogram = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("_n")).collect()}
    slots = spark.createDataFrame(
        slots_of(plan_packs(histogram, capacity)),
        "_length long, _from long, _to long, _many long, _base long, _offset long")
    ranked = staged.join(before, ["length", "part"]).withColumn("_rank", F.col("rank_here") + F.col("_before"))
    # the plan is bounded by the capacity, whatever the number of rows
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("_length"))
                         & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    nth = F.col("_rank") - F.col("_from")
    return placed.select(
        *[staged[c] for c in staged.columns if c not in ("rank_here", "part")],
        (F.col("_base") + F.expr("(_rank - _from) div _many")).alias("sequence_id"),
        (F.col("_offset") + (nth % F.col("_many")) * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Tokenize and pack whole documents; one row per piece.

    Columns: doc_id, start, length, doc_tokens, ids_crc32, sequence_id, offset, and the
    ids themselves unless ``keep_ids`` is off.  Repeated rows are packed each for itself;
    null ids stay null; no rows give no sequences; other columns are left out.
    """
    cut = pieces(docs, tokenizer_path, capacity, keep_ids=keep_ids)
    cut = cut if keep_ids else cut.drop("ids")
    return pack(stage(cut.withColumn("part", F.spark_partition_id()), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence with its ids in order; a sequence holds at most ``capacity`` ids."""
    got = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    joined = F.aggregate("_p", F.lit(b"").cast("binary"), lambda done, p: F.concat(done, p["ids"]))
    whole = got.select("sequence_id", joined.alias("ids"))
    return whole.withColumn("length", (F.octet_length("ids") / 4).cast("long"))
