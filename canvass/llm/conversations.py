"""Repair of a conversation's structure by a parallel Viterbi search with rank convergence.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles.  Every row is
kept, given the other role or deleted, and empty turns may be inserted; the cheapest
edits follow from costs that are worked out from the last row to the first, four states
a row.  That chain is cut into chunks.  Each chunk starts from a speculative cost vector
for its end; where the vector that the chunk after it yields differs by more than a
constant, the chunk is run again, in fix-up passes, until all differ only by constants.
The stitched costs then tell, from the first row on, which edit to take: the least
letter that keeps to the least cost.

Chunks stand on two levels.  In a task, rows are cut into chunks of ``LANE_ROWS`` that
run side by side.  A conversation that reaches over the end of a partition, or beyond
``PART_ROWS`` or ``PART_BYTES``, is cut into parts, which run in tasks of their own, pass by
pass.  Costs that do not converge within ``PASSES`` passes (rows that must all go carry any
vector on) are met by each part's whole map from vectors to vectors, so no conversation
needs more passes than that.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.llm.common import stage

START, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing yet, or the last role written
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs
WELL, CUT_OFF, MUST_GO = range(3)  # what is the matter with a row
FAR = 1 << 40
LANE_ROWS = 64
PART_ROWS, PART_BYTES = 50_000, 8 << 20
SOLVED_ROWS, SOLVED_BYTES = 20_000, 8 << 20  # rows of whole conversations solved in one go
PASSES = 6
SPACE = " \t\n\x0b\x0c\r"

#: The state after a role is written to a state, where that is allowed.
NEXT = {USER: {START: USER, SYSTEM: USER, ASSISTANT: USER}, ASSISTANT: {USER: ASSISTANT}, SYSTEM: {START: SYSTEM}}
#: The role that must come next.
FORCED = [USER, USER, ASSISTANT, USER]
NAMES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}  # other roles are 0


def _tables():
    """Costs of a row by (initial, matter): state before and after, insertions before it included; and of the end."""
    import numpy as np

    inserted = np.full((4, 4), FAR)
    for s in range(4):
        inserted[s, s] = 0
        one = FORCED[s]
        inserted[s, one] = min(inserted[s, one], INSERT)
        inserted[s, FORCED[one]] = min(inserted[s, FORCED[one]], 2 * INSERT)
    rows = np.full((12, 4, 4), FAR)
    for initial in range(4):
        for matter in range(3):
            costs = np.full((4, 4), FAR)
            for s in range(4):
                costs[s, s] = DELETE
                if matter != MUST_GO:
                    late = TRUNCATED * (matter == CUT_OFF)
                    costs[s, FORCED[s]] = min(costs[s, FORCED[s]], REROLE + late)
                    if s in NEXT.get(initial, {}):
                        costs[s, NEXT[initial][s]] = KEEP + late
            rows[initial * 3 + matter] = (inserted[:, :, None] + costs[None]).min(axis=1)
    end = np.minimum(inserted[:, START], inserted[:, ASSISTANT])
    return np.minimum(rows, FAR), end


ROW_COSTS, END_COSTS = _tables()


def even(vectors):
    """Cost vectors less their first entry: equal if they differ only by a constant."""
    return vectors - vectors[..., :1]


def costs(symbols, starts, right, lane_rows: int = LANE_ROWS):
    """Costs to the end for every row and state of several runs of rows, by chunks side by side.

    ``starts`` are the runs' first rows and, last, the number of rows; no run is empty.
    ``right`` has the vector behind each run's last row.  Also gives the number of passes.
    """
    import numpy as np

    lengths = np.diff(starts)
    each = -(-lengths // lane_rows)
    run = np.repeat(np.arange(len(lengths)), each)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(each) - each, each)
    first = starts[run] + nth * lane_rows
    end = np.minimum(first + lane_rows, starts[run + 1])
    is_last = end == starts[run + 1]
    used = np.where(is_last[:, None], right[run], even(END_COSTS)[None])
    out = np.zeros((len(symbols), 4), np.int64)
    todo, passes = np.arange(len(run)), 0
    follower = np.where(is_last, 0, end)
    while len(todo):
        passes += 1
        vector = used[todo]
        for t in range(int((end - first)[todo].max())):
            on = np.flatnonzero((end - first)[todo] > t)
            at = end[todo[on]] - 1 - t
            vector[on] = (ROW_COSTS[symbols[at]] + vector[on][:, None, :]).min(axis=2)
            out[at] = vector[on]
        met = out[follower]
        todo = np.flatnonzero(~is_last & (even(met) != even(used)).any(axis=1))
        used[todo] = met[todo]
    shift = np.where(is_last, 0, (out[follower] - used)[:, 0])  # chunks are stitched by their constants
    later = np.cumsum(shift[::-1])[::-1]
    last_of = np.cumsum(each) - 1
    out += np.repeat(later - later[last_of][run], end - first)[:, None]
    return out, passes


def traced(symbols: list[int], b: list[list[int]], right: list[int], state: int, is_last: bool):
    """The least edits from a state on, as letters with the state after each, and the state at the end."""
    out = []
    for i, symbol in enumerate(symbols):
        after = b[i + 1] if i + 1 < len(b) else right
        initial, matter = divmod(symbol, 3)
        while True:
            cost = b[i][state]
            if DELETE + after[state] == cost:
                out.append(("D", state))
                break
            forced = FORCED[state]
            if INSERT + b[i][forced] == cost:
                state = forced
                out.append(("I", state))
                continue
            kept = NEXT.get(initial, {}).get(state)
            late = TRUNCATED * (matter == CUT_OFF)
            if kept is not None and KEEP + late + after[kept] == cost:
                state = kept
                out.append(("K", state))
            else:
                state = forced
                out.append(("R", state))
            break
    while is_last and state not in (START, ASSISTANT):
        state = FORCED[state]
        out.append(("I", state))
    return out, state


def lines(edits, roles: list[str], texts: list[str]) -> list[str]:
    out, at = [], 0
    for letter, state in edits:
        if letter == "I":
            out.append(f"{NAMES[state]}:")
            continue
        if letter != "D":
            out.append(f"{roles[at] if letter == 'K' else NAMES[state]}:{texts[at]}")
        at += 1
    return out


def matters(roles: list[str], texts: list[str], seen: set) -> tuple[list[int], list[int]]:
    """Symbols of rows in a row, and how many are blank, duplicate and truncated; ``seen`` grows."""
    out, counts = [], [0, 0, 0]
    for role, text in zip(roles, texts, strict=True):
        end = text.rstrip(SPACE)
        key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
        if not end:
            matter, fault = MUST_GO, 0
        elif key in seen:
            matter, fault = MUST_GO, 1
        elif end[-1] not in ".!?":
            matter, fault = CUT_OFF, 2
        else:
            matter, fault = WELL, None
        seen.add(key)
        if fault is not None:
            counts[fault] += 1
        out.append(INITIALS.get(role[:1], 0) * 3 + matter)
    return out, counts


LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def illegal(symbols: list[int]) -> int:
    initials = [s // 3 for s in symbols]
    return sum(p not in LEGAL for p in zip(initials, initials[1:], strict=False))


# --- rows after damage, in order
def damaged(conversations: DataFrame) -> DataFrame:
    """The query's damage, by a hash of conversation and turn; rows that go stay as marks of their conversation."""
    def plain(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    draw = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long"), plain("role").alias("role"),
                                plain("text").alias("text"), draw.alias("_draw"))
    d = F.col("_draw")
    return rows.select(
        "conv_id", "turn", F.when(d == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(d == 1, "").when(d == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(d == 0, F.array(F.lit(None).cast("boolean"))).when(
            d == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.lit(True)))).alias("here"))


def _ordered(rows: DataFrame, present: Column) -> DataFrame:
    """Rows in order over range partitions: any conversation, turn or repeated row can be split."""
    ready = rows.select(
        "conv_id", present.alias("here"), F.col("turn").cast("long").alias("turn"),
        F.when(present, F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(present, F.coalesce("text", F.lit(" "))).alias("text"),
        F.when(present, F.sha2(F.coalesce("text", F.lit(" ")), 256)).alias("_sha"), F.monotonically_increasing_id().alias("_row"))
    order = [F.asc_nulls_first(c) for c in ("conv_id", "here", "turn", "role", "_sha", "_row")]
    return ready.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "here", "turn", "role", "text")


RESULT = [("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"),
          ("cost", "long"), ("audit", "string"), ("repaired_sha256", "string")]
PART = [("partition", "int"), ("seq", "int"), ("roles", "array<string>"), ("texts", "array<string>"),
        ("turns", "array<long>")]


class _Run:
    """Rows of one conversation in a row."""

    def __init__(self, conv):
        self.conv, self.roles, self.texts, self.turns, self.bytes = conv, [], [], [None, None, 0], 0

    def add(self, turn, role, text) -> None:
        if turn is not None:
            first, last, n = self.turns
            self.turns = [turn if first is None else first, turn, n + (turn != last)]
        self.roles.append(role)
        self.texts.append(text)
        self.bytes += len(text) + 100


def gaps(first, last, n) -> int:
    return 0 if first is None else last - first + 1 - n


def solved(runs: list[_Run]) -> list[tuple]:
    """Result rows of whole conversations, all at once."""
    import numpy as np

    found = [matters(r.roles, r.texts, set()) for r in runs]
    held = [(s, k) for k, (s, _) in enumerate(found) if s]
    flat = np.array([x for s, _ in held for x in s], np.int64)
    starts = np.cumsum([0, *(len(s) for s, _ in held)])
    b = costs(flat, starts, np.tile(END_COSTS, (len(held), 1)))[0].tolist() if held else []
    rows = {k: b[starts[i]:starts[i + 1]] for i, (_, k) in enumerate(held)}
    end = END_COSTS.tolist()
    out = []
    for k, (r, (symbols, counts)) in enumerate(zip(runs, found, strict=True)):
        mine = rows.get(k, [end])
        edits, _ = traced(symbols, mine, end, START, True)
        text = "\n".join(lines(edits, r.roles, r.texts))
        out.append((r.conv, gaps(*r.turns), *counts, illegal(symbols), mine[0][START],
                    "".join(e for e, _ in edits), hashlib.sha256(text.encode()).hexdigest()))
    return out


def first_look(ordered: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Results of conversations that lie inside a partition, and the parts of all others with their rows."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = ordered.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *T._parse_datatype_string(
        ", ".join(f"{n} {t}" for n, t in [("done", "boolean"), *RESULT, *PART])).fields])
    arrow = to_arrow_schema(schema)
    blank_result, blank_part = (None,) * len(RESULT), (None,) * len(PART)

    def run(batches):
        from pyspark import TaskContext

        here = TaskContext.get().partitionId()
        current, whole, seq = None, False, 0  # whole: the run began in this partition and is in one piece
        waiting, out = [], []

        def written():
            rows, out[:] = list(out), []
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

        def part(r):
            nonlocal seq
            out.append((r.conv, False, *blank_result, here, seq, r.roles, r.texts, r.turns))
            seq += 1

        def settle():
            out.extend((row[0], True, *row[1:], *blank_part) for row in solved(waiting))
            waiting.clear()

        for batch in batches:
            for conv, is_here, turn, role, text in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if current is None or conv != current.conv:
                    if current is not None:
                        if whole:
                            waiting.append(current)
                        else:
                            part(current)
                    whole = current is not None
                    current = _Run(conv)
                elif len(current.roles) >= part_rows or current.bytes >= PART_BYTES:
                    part(current)
                    whole, current = False, _Run(conv)
                    yield written()
                if is_here:
                    current.add(turn, role, text)
            if sum(len(r.roles) for r in waiting) >= SOLVED_ROWS or sum(r.bytes for r in waiting) >= SOLVED_BYTES:
                settle()
            if out:
                yield written()
        if current is not None:
            part(current)
        settle()
        if out:
            yield written()

    return ordered.mapInArrow(run, schema)


# --- conversations in parts
def _per_row(df: DataFrame, schema: str, fn) -> DataFrame:
    """Rows worked out one by one from dicts, in Arrow batches."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(wanted)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):  # a row is a part of bounded size
                rows = [r for row in b.slice(i, 1).to_pylist() for r in fn(row)]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.mapInArrow(run, wanted)


def _digests(row):
    seen = dict.fromkeys(hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()
                         for r, t in zip(row["roles"], row["texts"], strict=True))
    return [{"partition": row["partition"], "seq": row["seq"], "digest": d} for d in seen]


def seen_before(parts: DataFrame) -> DataFrame:
    """For each part the digests of its rows that stand in an earlier part of the conversation."""
    kept = _per_row(parts.select("partition", "seq", "roles", "texts"), "partition int, seq int, digest binary", _digests)
    owner = parts.select("conv_id", "partition", "seq")
    kept = stage(kept.join(owner, ["partition", "seq"]), "row-digests")
    place = F.struct("partition", "seq")
    firsts = kept.groupBy("conv_id", "digest").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"))
    firsts = firsts.where("_n > 1").select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "_first")
    later = kept.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")))
    return later.where(place > F.col("_first")).groupBy("partition", "seq").agg(F.collect_list("digest").alias("seen"))


VECTORS = "partition int, seq int, used array<long>, out array<long>"


def _run_part(row):
    """The vector that a part yields at its first row for the one ``used`` behind its last."""
    import numpy as np

    symbols = np.frombuffer(row["symbols"], np.int8).astype(np.int64)
    used = np.array([row["used"]], np.int64)
    out = costs(symbols, np.array([0, len(symbols)]), used)[0][0] if len(symbols) else used[0]
    return [{"partition": row["partition"], "seq": row["seq"], "used": row["used"], "out": out.tolist()}]


def _maps(row):
    """A part's whole map: what it yields for each state's own vector."""
    out = []
    for s in range(4):
        used = [0 if t == s else FAR for t in range(4)]
        out += _run_part(row | {"used": used})[0]["out"]
    return [{"partition": row["partition"], "seq": row["seq"], "map": out}]


def converged(looked: DataFrame, passes: int = PASSES) -> DataFrame:
    """``VECTORS`` of all parts, right up to a constant: speculation, fix-up passes, then whole maps."""
    slim = looked.select("partition", "seq", "symbols")
    order = Window.partitionBy("conv_id").orderBy("partition", "seq")  # a row a part
    guess = F.array(*[F.lit(int(x)).cast("long") for x in even(END_COSTS)])
    vectors = stage(_per_row(slim.withColumn("used", guess), VECTORS, _run_part), "vectors")
    owner = looked.select("conv_id", "partition", "seq")
    less = F.transform("_met", lambda x: x - F.col("_met")[0])
    for _ in range(passes):
        met = vectors.join(owner, ["partition", "seq"]).withColumn("_met", F.lead("out").over(order))
        wrong = stage(met.where(F.col("_met").isNotNull() & (less != F.col("used"))).select(
            "partition", "seq", less.alias("used"), "conv_id"), "fix-ups")
        if wrong.isEmpty():
            return vectors
        again = _per_row(slim.join(wrong.drop("conv_id"), ["partition", "seq"]), VECTORS, _run_part)
        vectors = stage(vectors.join(wrong, ["partition", "seq"], "left_anti").unionByName(again), "vectors")
    met = vectors.join(owner, ["partition", "seq"]).withColumn("_met", F.lead("out").over(order))
    slow = met.where(F.col("_met").isNotNull() & (less != F.col("used"))).select(F.col("conv_id").alias("_conv")).distinct()
    slow = stage(owner.join(slow, owner["conv_id"].eqNullSafe(F.col("_conv")), "left_semi"), "slow")
    if slow.isEmpty():
        return vectors
    maps = _per_row(slim.join(slow.select("partition", "seq"), ["partition", "seq"]),
                    "partition int, seq int, map array<long>", _maps)
    maps = maps.join(slow, ["partition", "seq"])

    def stitched(frame):
        """The vector behind each part, from the last part to the first."""
        import numpy as np

        frame = frame.sort_values(["partition", "seq"], ascending=False)
        vector, behind = even(END_COSTS), []
        for m in frame["map"]:
            behind.append(vector.tolist())
            vector = even((np.array(m, np.int64).reshape(4, 4).T + vector[None]).min(axis=1))
        return frame.assign(used=behind)[["partition", "seq", "used"]]

    behind = maps.groupBy("conv_id").applyInPandas(stitched, "partition int, seq int, used array<long>")  # a row a part
    again = _per_row(slim.join(stage(behind, "behind"), ["partition", "seq"]), VECTORS, _run_part)
    return stage(vectors.join(slow, ["partition", "seq"], "left_anti").unionByName(again), "vectors")


LOOKED = "partition int, seq int, symbols binary, counts array<long>, inside long"


def _look(row):
    import numpy as np

    symbols, counts = matters(row["roles"], row["texts"], set(row["seen"] or []))
    return [{"partition": row["partition"], "seq": row["seq"], "symbols": np.array(symbols, np.int8).tobytes(),
             "counts": counts, "inside": illegal(symbols)}]


def _part_costs(row):
    import numpy as np

    symbols = np.frombuffer(row["symbols"], np.int8).astype(np.int64)
    if not len(symbols):
        return [], []
    b = costs(symbols, np.array([0, len(symbols)]), np.array([row["used"]], np.int64))[0]
    return symbols.tolist(), b.tolist()


def _ends(row):
    """For each state before a part, the state behind it."""
    symbols, b = _part_costs(row)
    ends = [traced(symbols, b, row["used"], s, False)[1] if symbols else s for s in range(4)]
    return [{"partition": row["partition"], "seq": row["seq"], "ends": ends}]


def _rewritten(row):
    symbols, b = _part_costs(row)
    edits, _ = traced(symbols, b, row["used"], row["state"], row["is_last"])
    return [{**{k: row[k] for k in ("partition", "seq", "conv_id")}, "audit": "".join(e for e, _ in edits),
             "lines": lines(edits, row["roles"], row["texts"])}]


def in_parts(parts: DataFrame, passes: int = PASSES) -> DataFrame:
    """Result rows of the conversations whose rows lie in parts; a part is read by one task at a time."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = parts.schema["conv_id"].dataType.simpleString()
    with_seen = parts.select("partition", "seq", "roles", "texts").join(seen_before(parts), ["partition", "seq"], "left")
    looked = _per_row(with_seen, LOOKED, _look).join(parts.select("conv_id", "partition", "seq", "turns"), ["partition", "seq"])
    looked = stage(looked, "symbols")
    vectors = converged(looked, passes)
    ends = _per_row(looked.select("partition", "seq", "symbols").join(vectors, ["partition", "seq"]),
                    "partition int, seq int, ends array<int>", _ends)
    edges = looked.select("conv_id", "partition", "seq", "turns", "counts", "inside",
                          F.substring("symbols", 1, 1).alias("first"), F.substring("symbols", -1, 1).alias("last"))
    rows = edges.join(ends, ["partition", "seq"]).join(vectors, ["partition", "seq"])

    def joined(frame):
        """The state before each part, and the sums of the conversation; a group has a row a part."""
        frame = frame.sort_values(["partition", "seq"]).reset_index(drop=True)
        state, states = START, []
        for e in frame["ends"]:
            states.append(state)
            state = int(e[state])
        cost, behind = 0, END_COSTS.tolist()  # behind: the vector behind the part, from the last to the first
        for used, out in zip(frame["used"][::-1], frame["out"][::-1], strict=True):
            shift = behind[0] - int(used[0])
            behind = [int(x) + shift for x in out]
        cost = behind[START]
        edge = [(f[0] // 3, g[0] // 3) for f, g in zip(frame["first"], frame["last"], strict=True) if len(f)]
        crossed = sum((a[1], b[0]) not in LEGAL for a, b in zip(edge, edge[1:], strict=False))
        turns = [t for t in frame["turns"] if t[2]]
        n = sum(int(t[2]) for t in turns) - sum(a[1] == b[0] for a, b in zip(turns, turns[1:], strict=False))
        blank, duplicate, truncated = (int(sum(c[i] for c in frame["counts"])) for i in range(3))
        sums = {"gaps": gaps(turns[0][0], turns[-1][1], n) if turns else 0, "blank": blank, "duplicate": duplicate,
                "truncated": truncated, "illegal": int(frame["inside"].sum()) + crossed, "cost": cost}
        last = [False] * (len(frame) - 1) + [True]
        return frame[["partition", "seq"]].assign(state=states, is_last=last, **sums)

    sums = [(n, t) for n, t in RESULT if t == "long"]
    states = rows.groupBy("conv_id").applyInPandas(
        joined, "partition int, seq int, state int, is_last boolean, " + ", ".join(f"{n} {t}" for n, t in sums))
    states = stage(states, "states")
    final = parts.select("conv_id", "partition", "seq", "roles", "texts").join(
        looked.select("partition", "seq", "symbols"), ["partition", "seq"]).join(
        vectors.select("partition", "seq", "used"), ["partition", "seq"]).join(states, ["partition", "seq"])
    written = _per_row(final, f"partition int, seq int, conv_id {kind}, audit string, lines array<string>", _rewritten)
    written = written.join(states.drop("state", "is_last"), ["partition", "seq"])
    schema = T._parse_datatype_string(f"conv_id {kind}, " + ", ".join(f"{n} {t}" for n, t in RESULT))
    arrow = to_arrow_schema(schema)
    names = [n for n, _ in sums]

    def digest(batches):
        """Texts stream through in order; a conversation's digest is one chain by its nature, its memory a part."""
        current = None  # [conv, sums, audit so far, digest, whether a line was written]

        def row():
            return pa.RecordBatch.from_pylist([{"conv_id": current[0], **current[1], "audit": "".join(current[2]),
                                                "repaired_sha256": current[3].hexdigest()}], schema=arrow)

        for b in batches:
            for i in range(b.num_rows):
                part = b.slice(i, 1).to_pylist()[0]
                if current is None or part["conv_id"] != current[0]:
                    if current:
                        yield row()
                    current = [part["conv_id"], {n: part[n] for n in names}, [], hashlib.sha256(), False]
                current[2].append(part["audit"])
                if part["lines"]:
                    current[3].update(("\n" * current[4] + "\n".join(part["lines"])).encode())
                    current[4] = True
        if current:
            yield row()

    place = [F.asc_nulls_first("conv_id"), "partition", "seq"]
    return written.repartition("conv_id").sortWithinPartitions(*place).select(
        "conv_id", "lines", "audit", *names).mapInArrow(digest, schema)


def repaired(conversations: DataFrame, present: Column | None = None, part_rows: int = PART_ROWS,
             passes: int = PASSES) -> DataFrame:
    """One row per conversation: what is wrong with it, and its cheapest repair.

    ``present`` (default: always true) is null for rows that only say that a conversation
    exists.  Rows go by turn, nulls first; equal turns by role, then by the SHA-256 of their
    text.  Null roles and texts are one space; a null id is a conversation of its own.  A
    conversation without rows has zeros, no audit and the digest of an empty text.
    Repeated rows are duplicates; no rows give none; other columns are left out.
    """
    there = present if present is not None else F.lit(True)
    looked = stage(first_look(_ordered(conversations, there), part_rows), "conversations")
    done = looked.where("done").select("conv_id", *[n for n, _ in RESULT])
    parts = looked.where("not done").select("conv_id", *[n for n, _ in PART])
    return done.unionByName(in_parts(parts, passes))
