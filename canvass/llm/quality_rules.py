"""Quality rules with thresholds that follow the data.

Each language and source has its own limits, read from mergeable quantile
sketches: a value falls into a bucket of two parts in 64 or less of its size, and
a sketch is the count of each bucket, so sketches add up in any order.  A group
with few documents takes the sketch of its language, and a language with few that
of the corpus, all of them sums of the groups' buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.llm.common import attach, stage

MIN_WORDS = 50
LEAST_DOCS = 200  # fewer documents: the wider sketch
REACH = 4  # limit: median + REACH * max(upper quartile - median, least spread)
SCALE = 1000  # values are counted in thousandths
#: Rule, least spread in thousandths, and whether low values are bad as well.
RULES = {"symbols": (50, False), "repeats": (100, False), "copied_lines": (100, False), "word_length": (500, True)}
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three words that stand in the text twice or more."""
    import numpy as np

    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    pair = ids[:-1] * len(numbers) + ids[1:]
    _, pair = np.unique(pair, return_inverse=True)
    _, which, count = np.unique(pair[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    often = count[which] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= often
    return int(covered.sum())


def measure(texts: list[str | None]) -> list[list[int]]:
    out: list[list[int]] = [[], [], [], [], [], []]
    for t in texts:
        t = t or ""
        words = t.encode().split()
        seen, lines, copies = set(), 0, 0
        for line in t.split("\n"):
            if line.strip(SPACES):
                lines += 1
                copies += line in seen
                seen.add(line)
        chars = len(t) - sum(t.count(c) for c in SPACES)
        for column, v in zip(out, (len(words), chars, sum(t.count(c) for c in SYMBOLS), lines, copies,
                                   repeated_words(words)), strict=True):
            column.append(v)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def values() -> dict[str, Column]:
    """What the rules look at, in whole thousandths."""
    def per(a: str, b: str) -> Column:
        return F.floor(F.col(a) * SCALE / F.greatest(F.col(b), F.lit(1))).cast("long")

    return {"symbols": per("n_symbols", "n_words"), "repeats": per("n_repeat_words", "n_words"),
            "copied_lines": per("n_dup_lines", "n_lines"), "word_length": per("word_chars", "n_words")}


def bucket(value: Column) -> Column:
    """The largest number not above ``value`` with six leading binary digits; whole numbers, so exact everywhere."""
    step = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(value)) - 6, F.lit(0)))
    return value - value % step


def sketches(measured: DataFrame) -> DataFrame:
    """Buckets of each rule per language and source, of documents that pass the base rules."""
    ok = measured.where(~base_failed())
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), bucket(v).alias("bucket")) for n, v in values().items()]))
    return ok.select("lang", "source", each.alias("v")).groupBy("lang", "source", "v.rule", "v.bucket").agg(
        F.count(F.lit(1)).alias("n"))


def merge(sketch: DataFrame, *keys: str) -> DataFrame:
    """Add sketches up to coarser groups."""
    return sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """Median and quartiles of each group; the buckets of a group are bounded by their making."""
    up = Window.partitionBy(*keys, "rule").orderBy("bucket")
    whole = Window.partitionBy(*keys, "rule")
    ranked = sketch.withColumn("upto", F.sum("n").over(up)).withColumn("total", F.sum("n").over(whole))

    def at(p: int) -> Column:
        return F.min(F.when(F.col("upto") * 4 >= F.col("total") * p, F.col("bucket")))

    return ranked.groupBy(*keys, "rule").agg(F.max("total").alias("total"), at(1).alias("q1"), at(2).alias("q2"),
                                             at(3).alias("q3"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per language and source with the limits of each rule."""
    group = quartiles(sketch, "lang", "source")
    lang = quartiles(merge(sketch, "lang"), "lang").select(
        F.col("lang").alias("_lang"), F.col("rule").alias("_rule"),
        *[F.col(c).alias(f"l_{c}") for c in ("total", "q1", "q2", "q3")])
    every = quartiles(merge(sketch)).select(
        F.col("rule").alias("_rule2"), *[F.col(c).alias(f"a_{c}") for c in ("q1", "q2", "q3")])
    both = group.join(lang, group["lang"].eqNullSafe(lang["_lang"]) & (group["rule"] == lang["_rule"]), "left").join(
        every, group["rule"] == every["_rule2"], "left")

    def q(c: str) -> Column:
        return F.when(F.col("total") >= LEAST_DOCS, F.col(c)).when(
            F.col("l_total") >= LEAST_DOCS, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}"))

    limits = []
    for rule, (least, low_too) in RULES.items():
        high = q("q2") + REACH * F.greatest(q("q3") - q("q2"), F.lit(least))
        limits.append(F.max(F.when(F.col("rule") == rule, high)).alias(f"most_{rule}"))
        if low_too:
            low = q("q2") - REACH * F.greatest(q("q2") - q("q1"), F.lit(least))
            limits.append(F.max(F.when(F.col("rule") == rule, low)).alias(f"least_{rule}"))
    return both.groupBy("lang", "source").agg(*limits)


def verdict(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Join each document with the limits of its language and source and apply them."""
    named = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"),
                          *[c for c in limits.columns if c not in ("lang", "source")])
    both = measured.join(named, measured["lang"].eqNullSafe(named["_lang"])
                         & measured["source"].eqNullSafe(named["_source"]), "left")
    broken = [F.when(v > F.col(f"most_{n}"), F.lit(n)) for n, v in values().items()]
    broken += [F.when(values()[n] < F.col(f"least_{n}"), F.lit(f"low_{n}")) for n, r in RULES.items() if r[1]]
    failed = F.array_compact(F.array(*broken))
    return both.withColumn("base_failed", base_failed()).withColumn("failed_rules", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_lang", "_source")


def quality(docs: DataFrame) -> DataFrame:
    """Measures, broken rules and verdict of each document.

    A null text has no words and fails the base rules, as does an empty one.  Null
    languages and sources are groups of their own.  Repeated rows count each for
    itself; no rows give no thresholds and no results.  Only documents that pass the
    base rules shape the limits.
    """
    frame, _ = attach(docs.select("doc_id", "lang", "source", "text"), MEASURES, measure, "text")
    narrow = frame.drop("_3").withColumnsRenamed({"_0": "doc_id", "_1": "lang", "_2": "source"})
    narrow = stage(narrow, "measures")
    return verdict(narrow, stage(thresholds(sketches(narrow)), "limits"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns; texts are measured twice instead of being shuffled."""
    frame, _ = attach(docs.select("doc_id", "lang", "source", "text"), MEASURES, measure, "text")
    narrow = frame.drop("_0", "_3").withColumnsRenamed({"_1": "lang", "_2": "source"})
    limits = stage(thresholds(sketches(narrow)), "limits")
    whole, restored = attach(docs, MEASURES, measure, "text")
    at = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    judged = verdict(whole.withColumnsRenamed({at["lang"]: "lang", at["source"]: "source"}), limits)
    return restored(judged.where("kept").withColumnsRenamed({"lang": at["lang"], "source": at["source"]}))
