"""Hard negatives by a vertical scan of vectors (BOND).

A block of vectors is held by columns.  For each anchor the columns are read in the
order of the anchor's descending magnitudes; what the columns not yet read can add at
least and at most follows from their smallest and largest values in the block.  Rows
whose bounds show that they can't be in a result leave the candidate bitmap, and the
few that stay are scored to the end, so every returned score is exact.

Anchors are the query set: a bounded number of them meets all rows in one pass, in
which the rows stay where they are and each task answers with its best few an anchor.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.llm.common import stage

SCALE = 256
LARGEST = 1 << 26  # of a scaled component, so that sums stay whole numbers of 64 bits
POSITIVES, NEGATIVES = 5, 10
LOWER, UPPER = 30, 90  # per cent of the positive's score that a negative's may have
ANCHORS_A_PASS = 16_384  # bounds what is broadcast: at 64 columns 8 MB
BLOCK_ROWS = 8192
STEP = 16  # columns read before bounds are looked at again


def usable(embeddings: DataFrame) -> DataFrame:
    """``_row, vec_id, label, v`` of rows that have a label and only finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(
        F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))))
    rows = embeddings.select("vec_id", "label", "embedding").where(F.col("label").isNotNull() & F.col("embedding").isNotNull())
    return rows.where(finite).select(F.monotonically_increasing_id().alias("_row"), F.col("vec_id").cast("long"),
                                     F.col("label").cast("long"), scaled.alias("v"))


def matrix(vectors, columns: int | None = None):
    """An Arrow column of lists as columns by rows; missing components count as 0."""
    import numpy as np

    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.asarray(vectors.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    width = max(int(lengths.max(initial=0)), columns or 0)
    if len(lengths) and (lengths == width).all():
        return np.ascontiguousarray(flat.reshape(len(lengths), width).T)
    out = np.zeros((width, len(lengths)), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), row] = flat
    return out


class Anchors:
    """The anchors of a pass, their vectors by rows, and their windows once positives are known."""

    def __init__(self, row, label, v, windows):
        self.row, self.label, self.v, self.windows = row, label, v, windows

    def plain(self):
        return self.row, self.label, self.v, self.windows

    def set_windows(self, found: list) -> None:
        for f in found:
            low, high = -(-LOWER * f["score"] // 100), UPPER * f["score"] // 100
            self.windows[f["anchor"]].append((low, high))


def anchors_of(rows: list) -> Anchors:
    import numpy as np

    v = np.zeros((len(rows), max((len(r["v"]) for r in rows), default=0)), np.int64)
    for k, r in enumerate(rows):
        v[k, :len(r["v"])] = r["v"]
    return Anchors(np.array([r["_row"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64), v,
                   [[] for _ in rows])


class Block:
    """Some rows by columns, grouped by label, with the smallest and largest value of each column."""

    def __init__(self, rows, ids, labels, v, anchors: Anchors):
        import numpy as np

        order = np.argsort(labels, kind="stable")
        self.rows, self.ids, self.labels = rows[order], ids[order], labels[order]
        width = max(len(v), anchors.v.shape[1])
        self.v = np.zeros((width, len(order)), np.int64)
        self.v[:len(v)] = v[:, order]
        q = np.zeros((len(anchors.row), width), np.int64)
        q[:, :anchors.v.shape[1]] = anchors.v
        # products and sums are exact as doubles while they stay below 2 ** 53, and faster
        if width * float(np.abs(self.v).max(initial=0)) * float(np.abs(q).max(initial=0)) < 2**52:
            self.v, q = self.v.astype(np.float64), q.astype(np.float64)
        low, high = (f(axis=1) if len(order) else np.zeros(width) for f in (self.v.min, self.v.max))
        self.order = np.argsort(-np.abs(q), axis=1, kind="stable")
        self.q = np.take_along_axis(q, self.order, 1)
        ends = np.take_along_axis(q * low, self.order, 1), np.take_along_axis(q * high, self.order, 1)
        rest = [np.cumsum(f(*ends)[:, ::-1], axis=1)[:, ::-1] for f in (np.minimum, np.maximum)]
        none = np.zeros((len(q), 1), q.dtype)
        self.least, self.most = (np.concatenate([r, none], axis=1) for r in rest)
        self.width = width

    def scan(self, k: int, alive, shrink):
        """Rows of the bitmap that outlive all bounds, and their exact scores with anchor ``k``."""
        import numpy as np

        at = np.flatnonzero(alive)
        score = np.zeros(len(at), self.v.dtype)
        for c in range(0, self.width, STEP):
            if not len(at):
                break
            columns = self.order[k, c:c + STEP]
            score = score + self.q[k, c:c + STEP] @ self.v[columns][:, at]
            done = min(c + STEP, self.width)
            if done < self.width:
                stay = shrink(score + self.least[k, done], score + self.most[k, done])
                at, score = at[stay], score[stay]
        return at, score.astype(np.int64)


def _kth(values, n: int):
    """The n-th largest value, or None if there are fewer."""
    import numpy as np

    return np.partition(values, len(values) - n)[len(values) - n] if len(values) >= n else None


class Best:
    """The best few rows so far: higher scores first, then smaller ids (null ids last)."""

    def __init__(self, most: int):
        import numpy as np

        self.most, self.score, self.id, self.row = most, *(np.zeros(0, np.int64) for _ in range(3))

    def floor(self):
        return self.score[-1] if len(self.score) == self.most else None

    def add(self, score, ids, rows) -> None:
        import numpy as np

        score, ids, rows = (np.concatenate(p) for p in ((self.score, score), (self.id, ids), (self.row, rows)))
        order = np.lexsort((rows, ids, -score))[:self.most]
        self.score, self.id, self.row = score[order], ids[order], rows[order]


NO_ID = (1 << 63) - 1


def nearest(block: Block, anchors: Anchors, best: list[list[Best]]) -> None:
    """Each anchor's best rows of its own label but itself."""
    import numpy as np

    first, last = (np.searchsorted(block.labels, anchors.label, side) for side in ("left", "right"))
    for k in range(len(anchors.row)):
        if first[k] == last[k]:
            continue
        mine = best[k][0]
        alive = np.zeros(len(block.labels), bool)
        alive[first[k]:last[k]] = block.rows[first[k]:last[k]] != anchors.row[k]

        def shrink(least, most, mine=mine):
            floors = [f for f in (mine.floor(), _kth(least, mine.most)) if f is not None]
            return most >= max(floors) if floors else np.ones(len(most), bool)

        at, score = block.scan(k, alive, shrink)
        mine.add(score, block.ids[at], block.rows[at])


def in_windows(block: Block, anchors: Anchors, best: list[list[Best]]) -> None:
    """The best rows of other labels in each window of an anchor."""
    import numpy as np

    for k, windows in enumerate(anchors.windows):
        mine = [(b, low, high) for b, (low, high) in zip(best[k], windows, strict=True) if low <= high]
        if not mine:
            continue

        def shrink(least, most, mine=mine):
            stay = np.zeros(len(most), bool)
            for b, low, high in mine:
                sure = least[(least >= low) & (most <= high)]
                floor = max([low, *(f for f in (b.floor(), _kth(sure, b.most)) if f is not None)])
                stay |= (least <= high) & (most >= floor)
            return stay

        at, score = block.scan(k, block.labels != anchors.label[k], shrink)
        for b, low, high in mine:
            inside = (score >= low) & (score <= high)
            b.add(score[inside], block.ids[at[inside]], block.rows[at[inside]])


def scanned(rows: DataFrame, anchors: Anchors, look, places: int, most: int) -> DataFrame:
    """Each task's best rows: ``anchor, place, score, id, row``; a task holds a block and its answers."""
    import pyarrow as pa

    held = rows.sparkSession.sparkContext.broadcast(anchors.plain())

    def run(batches):
        import numpy as np

        anchors, waiting, n = Anchors(*held.value), [], 0
        best = [[Best(most) for _ in range(places or len(anchors.windows[k]))] for k in range(len(anchors.row))]

        def flush():
            columns = pa.Table.from_batches(waiting).combine_chunks()
            v = columns.column(3)
            v = v.chunk(0) if v.num_chunks else pa.array([], v.type)
            numbers = [columns.column(i).fill_null(NO_ID).to_numpy() for i in range(3)]
            look(Block(*numbers, matrix(v), anchors), anchors, best)

        for b in batches:
            waiting.append(b)
            n += b.num_rows
            if n >= BLOCK_ROWS:
                flush()
                waiting, n = [], 0
        if n:
            flush()
        found = [(k, p, b) for k, bs in enumerate(best) for p, b in enumerate(bs) if len(b.score)]
        for i in range(0, len(found), 1000):
            some = found[i:i + 1000]
            sizes = [len(b.score) for _, _, b in some]
            ids = np.concatenate([b.id for _, _, b in some])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([k for k, _, _ in some], sizes), pa.int32()),
                 pa.array(np.repeat([p for _, p, _ in some], sizes), pa.int32()),
                 pa.array(np.concatenate([b.score for _, _, b in some]), pa.int64()),
                 pa.array(ids, pa.int64(), mask=ids == NO_ID),
                 pa.array(np.concatenate([b.row for _, _, b in some]), pa.int64())],
                names=["anchor", "place", "score", "id", "row"])

    # no more tasks than cores: each answers once an anchor, so fewer tasks send less
    few = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    return rows.select("_row", "vec_id", "label", "v").coalesce(few).mapInArrow(
        run, "anchor int, place int, score long, id long, row long")


def ranked(found: DataFrame, most: int) -> DataFrame:
    """The best of all tasks, numbered; a group holds a few rows of each task."""
    first = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)


def hard_negatives(embeddings: DataFrame, is_anchor: Column, relabel: Column | None = None,
                   anchors_a_pass: int = ANCHORS_A_PASS) -> DataFrame:
    """Triples of anchors, their best rows of the same label, and rows of other labels scored not far below.

    Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    Rows with a null label or vector, or a component that is null or not finite, take no
    part.  Components become ``floor(256 * x)``, beyond 2 ** 26 that; components that a
    shorter vector lacks are 0.  Repeated ids are rows of their own, so each of them is an
    anchor and another row to the others; null ids come last among equal scores.  A
    positive's score below zero leaves no window.  No rows, or no anchors, give none;
    other columns are left out.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings)
    if relabel is not None:
        rows = rows.withColumn("label", relabel)
    rows = stage(rows.withColumn("_anchor", F.coalesce(is_anchor, F.lit(False))), "vectors")
    chosen = rows.where("_anchor")
    passes = max(1, -(-chosen.count() // anchors_a_pass))
    parts = []
    for n in range(passes):
        # about ``anchors_a_pass`` rows, whatever the size of the table
        mine = chosen.where(F.pmod(F.xxhash64("_row"), F.lit(passes)) == n).select("_row", "vec_id", "label", "v").collect()
        mine.sort(key=lambda r: r["_row"])
        anchors = anchors_of(mine)
        near = ranked(scanned(rows, anchors, nearest, 1, POSITIVES), POSITIVES)
        near = near.select("anchor", (F.col("rank") - 1).alias("place"), "score", F.col("id").alias("positive_id")).collect()
        near.sort(key=lambda f: (f["anchor"], f["place"]))
        anchors.set_windows(near)
        known = spark.createDataFrame(
            [(f["anchor"], f["place"], mine[f["anchor"]]["vec_id"], f["positive_id"], f["score"]) for f in near],
            "anchor int, place int, anchor_id long, positive_id long, positive_score long")
        found = ranked(scanned(rows, anchors, in_windows, 0, NEGATIVES), NEGATIVES)
        # at most five rows an anchor of the pass
        part = found.join(F.broadcast(known), ["anchor", "place"]).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"))
        parts.append(part if passes == 1 else stage(part, "negatives"))
    return reduce(DataFrame.unionByName, parts)
