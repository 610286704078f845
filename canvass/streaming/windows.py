"""Windows that begin at a key's own first event, over a whole log at once.

A limiter opens a window at a key's first request; the next one opens at the
first request after the window has run out.  That looks sequential, yet every
event knows where the next window would open if one opened at it, so the real
openings are found by pointer doubling: log2(windows in a row) joins on
(key, time), evenly spread whatever key is hot.  No key is ever gathered in one
task: lookups meet in slots a thousandth of a window long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canvass import config as C
from canvass.session import cut_lineage


def _grain(width: int) -> int:
    """Length of a lookup slot: a small part of the width, at least a second."""
    return max(width // 1024, 1_000_000)


def _jumps(points: DataFrame, width: int, strict: bool) -> DataFrame:
    """(key, t) -> nxt: the first event after the window that would open at t.

    Probes for t + width and events meet in short time slots of their key.  The
    event sought lies in the probe's slot, or is the first of a later one.
    """
    grain = _grain(width)
    probes = points.select("key", (F.col("t") + width).alias("at"), "t", F.lit(0).alias("is_event"))
    events = points.select("key", F.col("t").alias("at"), "t", F.lit(1).alias("is_event"))
    both = probes.unionByName(events).withColumn("slot", F.floor(F.col("at") / grain))
    event_at = F.when(F.col("is_event") == 1, F.col("at"))
    # scanning back in time, an event as late as the probe itself counts only
    # when the window's end is open
    tie = F.col("is_event").asc() if strict else F.col("is_event").desc()
    back = Window.partitionBy("key", "slot").orderBy(F.col("at").desc(), tie).rowsBetween(Window.unboundedPreceding, -1)
    in_slot = both.withColumn("in_slot", F.last(event_at, ignorenulls=True).over(back)).where("is_event = 0")
    # first event of any later slot: a table as long as a key's time span
    slots = both.groupBy("key", "slot").agg(F.min(event_at).alias("first_t"))
    later = Window.partitionBy("key").orderBy(F.col("slot").desc()).rowsBetween(Window.unboundedPreceding, -1)
    behind = slots.select("key", "slot", F.min("first_t").over(later).alias("later_t"))
    joined = in_slot.join(behind, ["key", "slot"])
    return joined.select("key", "t", F.coalesce("in_slot", "later_t").alias("nxt")).where(F.col("nxt").isNotNull())


def _sure_openings(points: DataFrame, width: int, strict: bool) -> DataFrame:
    """The first event of a key, and any event after a pause longer than the width."""
    grain = _grain(width)
    slotted = points.withColumn("slot", F.floor(F.col("t") / grain))
    in_slot = Window.partitionBy("key", "slot").orderBy("t")
    before = Window.partitionBy("key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    last_of = slotted.groupBy("key", "slot").agg(F.max("t").alias("last_t"))
    last_before = last_of.select("key", "slot", F.max("last_t").over(before).alias("prev_last"))
    gaps = slotted.withColumn("prev", F.lag("t").over(in_slot)).join(last_before, ["key", "slot"])
    pause = F.col("t") - F.coalesce("prev", "prev_last")
    return gaps.where(pause.isNull() | ((pause > width) if strict else (pause >= width))).select("key", "t")


def window_openings(events: DataFrame, key: str, ts: str, width_seconds: float, strict: bool = True) -> DataFrame:
    """(key, opening) of every window.

    strict: a new window opens when more than the width has passed; otherwise
    when at least the width has passed.  Times are microseconds since the epoch.
    """
    width = int(width_seconds * 1_000_000)
    points = events.select(F.col(key).alias("key"), F.unix_micros(ts).alias("t")).distinct()
    sure, jumps = _sure_openings(points, width, strict), _jumps(points, width, strict)
    opened, jumps = cut_lineage(sure), cut_lineage(jumps)
    known = opened.count()
    while True:
        reached = opened.join(jumps, ["key", "t"]).select("key", F.col("nxt").alias("t"))
        opened = cut_lineage(opened.unionByName(reached).distinct())
        total = opened.count()
        if total == known:
            break
        known = total
        hop = jumps.select("key", F.col("t").alias("nxt"), F.col("nxt").alias("far"))
        jumps = cut_lineage(jumps.join(hop, ["key", "nxt"]).select("key", "t", F.col("far").alias("nxt")))
    return opened.select(F.col("key").alias(key), F.col("t").alias("opening"))


def assign_openings(events: DataFrame, openings: DataFrame, key: str, ts: str, width_seconds: float) -> DataFrame:
    """Every event with the opening of its window.

    Windows of a key are more than a width apart, so at most one opens per slot:
    an event's window opened in its own slot or in the one before.
    """
    width = int(width_seconds * 1_000_000)
    t = F.unix_micros(ts)
    slotted = events.withColumn("_slot", F.floor(t / width)).withColumn("_t", t)
    per_slot = openings.select(
        F.col(key), F.floor(F.col("opening") / width).alias("_slot"), F.col("opening"))
    here = per_slot.withColumnRenamed("opening", "_here")
    prev = per_slot.select(key, (F.col("_slot") + 1).alias("_slot"), F.col("opening").alias("_prev"))
    joined = slotted.join(here, [key, "_slot"], "left").join(prev, [key, "_slot"], "left")
    return joined.withColumn(
        "opening", F.when(F.col("_here") <= F.col("_t"), F.col("_here")).otherwise(F.col("_prev"))).drop(
        "_slot", "_t", "_here", "_prev")


def within_limit(assigned: DataFrame, key: str, order: list, limit: int, name: str) -> DataFrame:
    """Flag the first ``limit`` events of every window.

    Ranks past the limit are dropped before the shuffle, so a flooded window
    sends only ``limit`` rows per task.
    """
    ids = [c for c in order]
    window = Window.partitionBy(key, "opening").orderBy(*order)
    allowed = assigned.select(key, "opening", *ids).withColumn("_rn", F.row_number().over(window)).where(
        F.col("_rn") <= limit).select(key, *ids, F.lit(True).alias(name))
    return assigned.drop("opening").join(allowed, [key, *ids], "left").withColumn(
        name, F.coalesce(name, F.lit(False)))


def admit_per_key(
    requests: DataFrame, key: str = "user_id", ts: str = "ts", event: str = "event_id",
    per_minute: int = C.PER_KEY_PER_MINUTE, per_day: int = C.PER_KEY_PER_DAY,
) -> DataFrame:
    """Requests with ``admitted``: within the minute limit and within the day limit.

    Both counters move on every request, also on refused ones.
    """
    out = requests
    for width, limit, name in ((60, per_minute, "minute_ok"), (86_400, per_day, "day_ok")):
        openings = window_openings(requests, key, ts, width)
        out = within_limit(assign_openings(out, openings, key, ts, width), key, [ts, event], limit, name)
    return out.withColumn("admitted", F.col("minute_ok") & F.col("day_ok"))


def cache_attribution(
    requests: DataFrame, key: str, ts: str, failed: str, ttl_seconds: int = C.CACHE_TTL_SECONDS,
) -> DataFrame:
    """Requests with ``source``: cache when a success of the same key is young enough, else ai.

    A success is stored when nothing valid is stored, so the stores of a key are
    window openings over its would-be successes.
    """
    stores = window_openings(requests.where(~F.col(failed)), key, ts, ttl_seconds, strict=False)
    assigned = assign_openings(requests, stores, key, ts, ttl_seconds)
    t = F.unix_micros(ts)
    young = F.col("opening").isNotNull() & (F.col("opening") < t) & (
        t - F.col("opening") < ttl_seconds * 1_000_000)
    return assigned.withColumn("source", F.when(young, "cache").otherwise("ai")).drop("opening")


def request_rate_windows(requests: DataFrame, key: str = "user_id", ts: str = "ts", width: str = "1 minute",
                         watermark: str = "10 minutes") -> DataFrame:
    """Requests per key and clock window; the watermark bounds state on a stream."""
    return (
        requests.withWatermark(ts, watermark).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"))
        .select(key, F.col("window.start").alias("window_start"), "n"))


def quiet_spans(calls: DataFrame, ts: str, gap_seconds: int) -> DataFrame:
    """Number the stretches of a log that are parted by pauses of at least the gap.

    Slots of one gap length are reduced first; only the slot table, as long as
    the time span, is ordered as a whole.
    """
    width = gap_seconds * 1_000_000
    t = F.unix_micros(ts)
    slots = calls.groupBy(F.floor(t / width).alias("_slot")).agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    order = Window.orderBy("_slot")
    fresh = (F.col("lo") - F.lag("hi").over(order)) >= width
    spans = slots.withColumn("span", F.sum(F.when(fresh, 1).otherwise(0)).over(order)).select("_slot", "span")
    return calls.withColumn("_slot", F.floor(t / width)).join(spans, "_slot").drop("_slot")
