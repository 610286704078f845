"""Helpers shared by the text operators."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.session import shared_folder

_STAGED: list[str] = []
#: Shuffle files go when the frame that needed them is written, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

MARKS = 1 << 24  # bits of ``marked``, 64 a row of its table


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write the frame to the shared folder and read it back: lineage is cut, sizes are known, shuffle files go."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.parquet(folder)  # a new frame, which takes the setting up
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    _STAGED.append(folder)
    return spark.read.schema(df.schema).parquet(folder)


def marked(rows: DataFrame, number: str, wanted: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: false where ``number`` is surely none of those in ``wanted`` (one column).

    The wanted numbers (hashes, so evenly spread) set bits of a table of bounded size that every task holds; so rows
    without a partner need not be shuffled to find that out.  True proves nothing: such rows go on to an exact join.
    """
    bit = F.pmod(F.col(wanted.columns[0]), F.lit(MARKS))
    words = wanted.select(F.shiftright(bit, 6).alias("_slot"), bit.bitwiseAND(F.lit(63)).cast("int").alias("_bit")).groupBy(
        "_slot").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit"))).alias("_bits"))
    mine = F.pmod(F.col(number), F.lit(MARKS))
    held = rows.join(F.broadcast(words), F.shiftright(mine, 6) == F.col("_slot"), "left")
    set_ = F.call_function("shiftright", F.col("_bits"), mine.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return held.withColumn(name, F.coalesce(set_, F.lit(False))).drop("_slot", "_bits")


def drop_staged(spark: SparkSession) -> None:
    """Delete what ``stage`` wrote; call it once results are written elsewhere."""
    jvm = spark.sparkContext._jvm
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Long texts: fewer rows travel to Python at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def on_worker(key, make):
    """A value kept in a Python worker for tasks of its kind, such as a loaded tokenizer.

    A worker that is used again for other work drops what earlier work has left, so what
    it holds does not add up over the stages of a job.
    """
    store = sys.modules.setdefault("_canvass_kept", types.ModuleType("_canvass_kept")).__dict__.setdefault("kept", {})
    if key not in store:
        store.clear()
        store[key] = make()
    return store[key]


class BoundedCache:
    """Values by key in two generations of bounded bytes: what is used stays, the rest is forgotten.

    It changes no result, as a value can always be worked out again.
    """

    def __init__(self, most_bytes: int):
        self.half, self.new, self.old, self.size = most_bytes // 2, {}, {}, 0

    def lookup(self, keys: list, make_all) -> list:
        """The values of distinct keys; ``make_all(list of keys)`` gives the values of those not held."""
        out = list(map(self.new.get, keys))
        lacking = [i for i, v in enumerate(out) if v is None]
        unknown = []
        for i in lacking:
            out[i] = self.old.get(keys[i])
            if out[i] is None:
                unknown.append(i)
        for i, v in zip(unknown, make_all([keys[i] for i in unknown]), strict=True):
            out[i] = v
        self.new.update((keys[i], out[i]) for i in lacking)
        self.size += sum(170 + len(keys[i]) + (len(out[i]) if isinstance(out[i], bytes) else 0) for i in lacking)
        if self.size > self.half:
            self.old, self.new, self.size = self.new, {}, 0
        return out


def slices(batches, text: int, most_bytes: int = 8 << 20, most_rows: int = 4000):
    """Arrow batches cut or put together to a bounded number of bytes of text and of rows.

    ``text`` is the place of the text column; a longer text is a slice of its own.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    held, size, rows = [], 0, 0

    def joined():
        table = pa.Table.from_batches(held).combine_chunks()
        return table.to_batches()[0] if table.num_rows else held[0]

    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_pylist()
        start = 0
        for i, n in enumerate(sizes):
            if rows and (size + n > most_bytes or rows >= most_rows):
                if i > start:
                    held.append(b.slice(start, i - start))
                yield joined()
                held, size, rows, start = [], 0, 0, i
            size += n
            rows += 1
        if len(sizes) > start:
            held.append(b.slice(start))
    if held:
        yield joined()


def attach(df: DataFrame, schema: str, fn, *inputs: str):
    """Add columns worked out in Python, next to all columns of the input, without a join.

    ``fn(values...)`` gets lists of the named input columns and gives a list per new
    column.  Input columns are renamed by position meanwhile, so no name can clash;
    the second value gives them back their names.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    names = df.columns
    places = [f"_{i}" for i in range(len(names))]
    read = [names.index(c) for c in inputs]
    added = T._parse_datatype_string(schema)
    kinds = [to_arrow_type(f.dataType) for f in added]

    def run(batches):
        for b in batches:
            new = fn(*[b.column(i).to_pylist() for i in read])
            columns = [b.column(i) for i in range(b.num_columns)]
            columns += [pa.array(v, kind) for v, kind in zip(new, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[*places, *added.names])

    moved = df.toDF(*places)
    out = moved.mapInArrow(run, T.StructType([*moved.schema.fields, *added.fields]))
    return out, lambda frame: frame.select(*[F.col(p).alias(n) for p, n in zip(places, names, strict=True)])


def numbered(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """Gapless numbers from 0 within groups of any size.

    Rows are range partitioned on group and order, numbered per partition and
    shifted by the sizes of earlier partitions, so no task holds a whole group.
    """
    from pyspark.sql import Window

    ranged = df.repartitionByRange(*groups, *order).withColumn("_pid", F.spark_partition_id())
    ranged = stage(ranged, "numbered")
    sizes = ranged.groupBy(*groups, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*groups, "_pid", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    here = Window.partitionBy("_pid", *groups).orderBy(*order)
    counted = ranged.withColumn("_rn", F.row_number().over(here))
    return counted.join(offsets, [*groups, "_pid"]).select(
        *[counted[c] for c in df.columns], (F.col("_before") + F.col("_rn") - 1).alias(name))


def words_udf_table(keep: bytes) -> bytes:
    """A byte translation that lower-cases A-Z and turns all but ``keep`` and non-ASCII bytes into spaces."""
    table = bytearray(range(256))
    for b in range(128):
        low = b + 32 if 65 <= b <= 90 else b
        table[b] = low if low in keep else 32
    return bytes(table)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))
