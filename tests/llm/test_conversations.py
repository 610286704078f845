"""Repairs against a plain search over (cost, audit), whole and in parts."""

import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest_llm import by_row
from pyspark.sql import functions as F

from canvass.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string"
WS = " \t\n\x0b\x0c\r"


def damaged_plain(rows):
    out = []
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(d, text)
        out += [(conv, turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def plain(original, rows):
    out = []
    for conv in {r[0] for r in original}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (
            r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest()))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, _, role, text in mine:
            end = text.rstrip(WS)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else
                          "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))

        best = {"": (0, ""), "s": (4, "II"), "u": (2, "I"), "a": (0, "")}
        must = {"": "u", "s": "u", "u": "a", "a": "u"}
        for (_, _, role, _), fault in reversed(list(zip(mine, faults, strict=True))):
            gone, late = fault in ("blank", "duplicate"), fault == "truncated"
            row = {}
            for s, b in best.items():
                options = [(3 + b[0], "D" + b[1])]
                if not gone:
                    c, a = best[must[s]]
                    options.append((2 + late + c, "R" + a))
                    if role[:1] == must[s] or role[:1] == "s" and s == "":
                        c, a = best[role[:1]]
                        options.append((late + c, "K" + a))
                row[s] = min(options)
            for _ in range(3):
                row = {s: min(row[s], (2 + row[must[s]][0], "I" + row[must[s]][1])) for s in row}
            best = row
        cost, audit = best[""] if mine else (0, "")
        state, at, lines = "", 0, []
        for letter in audit:
            if letter in "KR":
                state = mine[at][2][:1] if letter == "K" else must[state]
                lines.append((mine[at][2] if letter == "K" else {"u": "user", "a": "assistant"}[state]) + ":" + mine[at][3])
            if letter == "I":
                state = must[state]
                lines.append({"u": "user:", "a": "assistant:"}[state])
            at += letter != "I"
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines))
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(map(repr, out))


def made(rng, convs=120):
    texts = ["Well.", "Is it so?", "cut off", "", " \t", "Yes!", "No. ", "The end.\n", "x" * 50 + ".", "é", "…"]
    roles = ["user"] * 6 + ["assistant"] * 6 + ["system", "system", "tool", "", "User", None]
    rows = []
    for c in range(convs):
        for t in range(rng.choice([1, 2, 3, 6, 12, 40])):
            turn = rng.choice([t, t, t, t + 3, None, t - 1])
            rows.append((c, turn, rng.choice(roles), rng.choice([rng.choice(texts), f"Text {rng.random()}.", None])))
    rows += [(None, i, "user", f"t{i}.") for i in range(5)] + [rows[3]] * 3 + [(10**6, None, None, None)]
    rows += [(2 * 10**6, i, "user", "") for i in range(60)]  # all must go
    rows += [(3 * 10**6, i, "assistant" if i == 299 else "user", "same." if i % 50 else f"own {i}.") for i in range(300)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return made(random.Random(9))


@functools.cache
def _expected(rows):
    return plain(rows, damaged_plain(rows))


@pytest.mark.parametrize("part_rows, passes", [(50_000, 6), (7, 6), (3, 0), (5, 1)])
def test_repairs_match_plain_search(spark, rows, part_rows, passes):
    frame = cv.damaged(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = by_row(cv.repaired(frame, F.col("here"), part_rows, passes))
    assert got == _expected(tuple(rows))


def test_one_partition_and_many_agree(spark, rows):
    """Where partitions are cut changes nothing: conversations meet again part by part."""
    frame = cv.damaged(spark.createDataFrame(rows, SCHEMA))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "29"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            assert by_row(cv.repaired(frame, F.col("here"), 20)) == _expected(tuple(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_given_tables_match_plain_search(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    got = by_row(cv.repaired(cv.damaged(frame), F.col("here"), 4))
    assert got == plain(rows, damaged_plain(rows))


def test_empty_table_and_clashing_names(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    assert cv.repaired(cv.damaged(frame.where("false")), F.col("here")).count() == 0
    more = frame.select("*", *[F.lit(1).alias(c) for c in "here cost audit partition seq used out state done _row _sha".split()])
    assert by_row(cv.repaired(cv.damaged(more), F.col("here"))) == _expected(tuple(rows))
    # without damage, extra columns of the operator's own names do no harm either
    undamaged = more.withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})
    plain_rows = [tuple(r) for r in undamaged.select("conv_id", "turn", "role", "text").collect()]
    assert by_row(cv.repaired(more.drop("here").withColumn("x", F.lit(2)))) == plain(rows, plain_rows)


def test_chunks_converge_in_few_passes_and_are_exact():
    """Ordinary rows forget what comes after them; rows that must go do not, and take a pass a chunk."""
    rng = np.random.default_rng(3)
    end = cv.END_COSTS[None]
    symbols = rng.integers(0, 12, 5000)
    one, passes = cv.costs(symbols, np.array([0, 5000]), end)
    whole, alone = cv.costs(symbols, np.array([0, 5000]), end, lane_rows=5000)
    assert (one == whole).all() and alone == 1 and passes <= 4
    stuck = np.array([cv.USER * 3 + cv.MUST_GO] * 640 + [cv.USER * 3, cv.USER * 3])
    one, passes = cv.costs(stuck, np.array([0, len(stuck)]), end)
    assert (one == cv.costs(stuck, np.array([0, len(stuck)]), end, lane_rows=10**4)[0]).all() and passes > 4
