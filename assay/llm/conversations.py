"""Repair of conversations: faults, the cheapest legal sequence of roles, and the edits to get there.

Rows are dealt by ranges of (conversation, turn, role, text), so a conversation of any length is cut
across tasks, and cut again into segments of a bounded number of rows. In a segment

1. a cost DP over (row, state) gives what is left to pay, backwards; states say which role was last;
2. optimal arcs (Delete, Insert, Keep, Rerole) make a graph whose nodes are ranked by the edits that
   follow them, first one, then two, four, eight: the rank of a node for twice the length is the rank of
   the pair (own rank, rank of the node that its pointer reaches), and pointers double alike;
3. each node goes on by the arc of least (letter, rank), and doubled pointers list the path.

A conversation inside one task and segment ends there. The segments of others are solved in three steps:
each gives its costs between states, costs are added up from the last segment back, segments are ranked
with what they owe at their end, and the first segment's start picks the path through all of them.
These steps stream over segments with one cost vector, one state and one running hash in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.session import write_and_read

#: rows and text bytes of one segment
SEGMENT_ROWS, SEGMENT_BYTES = 1024, 1 << 22
#: rows that one call of the solver gets
BATCH_ROWS = 8192
SPACE = " \t\n\x0b\x0c\r"

#: states: nothing written yet, after a system row, after a user row, after an assistant row
START, SYSTEM, USER, ASSISTANT = range(4)
#: the state after one more written row, unless that is a kept system row
NEXT = np.array([USER, USER, ASSISTANT, USER])
INITIALS = {"s": 1, "u": 2, "a": 3}
#: state after keeping a row, by state and initial (other, s, u, a); -1: not legal
AFTER_KEEP = np.array([[-1, SYSTEM, USER, -1], [-1, -1, USER, -1], [-1, -1, -1, ASSISTANT], [-1, -1, USER, -1]])
LEGAL_PAIRS = {(1, 2), (2, 3), (3, 2)}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAULTS = ("blank", "duplicate", "truncated")
#: letters of edits in ASCII order; letter 0 is the end
LETTERS = "\0DIKR"
INF = np.int64(1) << 40
#: what is left to pay behind the last row: one assistant row after a user row, both after a system row
END = np.array([0, 2 * INSERT, INSERT, 0], dtype=np.int64)
AT_END = ("", "II", "I", "")
NAMES = {USER: "user", ASSISTANT: "assistant"}


def damage(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, text`` after the damage that ``crc32(conv:turn) % 20`` names: 0 drops the row, 1 empties
    its text, 2 removes its sentence ends, 3 repeats it, 4 makes it a user's. Null fields count as one space."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")]
    kind = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (rows.withColumn("kind", kind).where("kind != 0")
            .withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text")))


def _faults(rows: DataFrame) -> DataFrame:
    """Adds ``fault``: 1 blank, 2 the role and text of an earlier turn, 3 truncated, 0 none. Rows alike in turn, role and
    text are neighbours in the order, where the segmenter finds the repeats among them."""
    rows = rows.withColumn("digest", F.sha2(F.encode("text", "UTF-8"), 256))
    order = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    first = (rows.groupBy("conv", "role", "digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
             .select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("t"), "first"))
    joined = rows.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("t")), "left")
    body = F.rtrim("text", F.lit(SPACE))
    fault = (F.when(body == "", 1).when(F.col("first").isNotNull() & (order > F.col("first")), 2)
             .when(~F.substring(body, -1, 1).isin(".", "!", "?"), 3).otherwise(0))
    return joined.select("conv", "turn", "role", "text", fault.alias("fault"))


def togo(first: np.ndarray, initial: np.ndarray, fault: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cost from each (row, state) to the end of its segment, with ``right`` (segment, state) to pay there.

    Segment j has the rows first[j]:first[j + 1]. All segments take one step back at a time.
    """
    cost = np.empty((len(initial), 4), dtype=np.int64)
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    for t in range(int(size[0]) if len(size) else 0):
        seg = order[:np.searchsorted(-size, -t)]
        row = first[seg + 1] - 1 - t
        ahead = right[seg] if t == 0 else cost[row + 1]
        usable = (fault[row] == 0) | (fault[row] == 3)
        extra = np.where(fault[row] == 3, TRUNCATED, 0)
        keep_to = AFTER_KEEP[:, initial[row]].T
        keep = np.where((keep_to >= 0) & usable[:, None], np.take_along_axis(ahead, np.maximum(keep_to, 0), 1) + extra[:, None], INF)
        rerole = np.where(usable[:, None], ahead[:, NEXT] + (REROLE + extra)[:, None], INF)
        here = np.minimum(np.minimum(ahead + DELETE, keep), rerole)
        once = np.minimum(here, here[:, NEXT] + INSERT)
        cost[row] = np.minimum(np.minimum(once, once[:, NEXT] + INSERT), INF)
    return cost


def least_paths(first: np.ndarray, initial: np.ndarray, fault: np.ndarray, right: np.ndarray,
                starts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Least edits among the cheapest, exit state and cost for each of ``starts`` (segment, state)."""
    n, segs = len(initial), len(first) - 1
    cost = togo(first, initial, fault, right)
    size = np.diff(first)
    seg_of = np.repeat(np.arange(segs), size)
    last = np.zeros(n, dtype=bool)
    last[first[1:][size > 0] - 1] = True
    base = np.where(last, 4 * n + 4 * seg_of, 4 * np.arange(n) + 4)  # nodes of the next row, or of the segment's end
    ahead = np.concatenate([cost.ravel(), right.ravel()])
    usable = ((fault == 0) | (fault == 3))[:, None]
    extra = np.where(fault == 3, TRUNCATED, 0)[:, None]
    keep_to = AFTER_KEEP[:, initial].T
    state = np.arange(4)[None, :]
    # the arcs of a node, by letter: D, I, K, R
    target = np.stack([base[:, None] + state, 4 * np.arange(n)[:, None] + NEXT[None, :],
                       base[:, None] + np.maximum(keep_to, 0), base[:, None] + NEXT[None, :]], axis=-1)
    price = np.stack(np.broadcast_arrays(np.full((n, 4), DELETE), np.full((n, 4), INSERT), np.where(usable & (keep_to >= 0), extra, INF),
                                         np.where(usable, REROLE + extra, INF)), axis=-1)
    optimal = (ahead[target] + price == cost[:, :, None]).reshape(-1, 4)
    target = target.reshape(-1, 4)
    ends = np.arange(4 * n, 4 * n + 4 * segs)

    def chosen(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each node's optimal arcs the one of least (letter, rank of its target)."""
        key = np.where(optimal, (np.arange(1, 5)[None, :] * (int(rank.max(initial=0)) + 1)) + rank[target], np.iinfo(np.int64).max)
        arc = key.argmin(axis=1)
        return arc + 1, np.take_along_axis(target, arc[:, None], 1)[:, 0]

    letter, to = chosen(np.zeros(4 * n + 4 * segs, dtype=np.int64))
    rank = np.concatenate([letter, np.zeros(4 * segs, dtype=np.int64)])  # by the next edit
    pointer = np.concatenate([to, ends])
    steps = (pointer != np.arange(len(pointer))).astype(np.int64)
    jumps = []
    while True:
        letter, to = chosen(rank)
        jumps.append(pointer)
        again = pointer[pointer]
        if (again == pointer).all():
            break
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[pointer], return_inverse=True)[1]
        steps = steps + steps[pointer]
        pointer = again
    # paths by doubled pointers: the node of place p is reached by the binary digits of p
    begin = np.where(size[starts[:, 0]] > 0, 4 * first[starts[:, 0]] + starts[:, 1], 4 * n + 4 * starts[:, 0] + starts[:, 1])
    length = steps[begin]
    at = np.repeat(begin, length)
    place = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
    for j, jump in enumerate(jumps):
        at = np.where(place >> j & 1, jump[at], at)
    letters = np.frombuffer(LETTERS.encode(), dtype=np.uint8)[letter[at]].tobytes().decode() if len(at) else ""
    cut = np.concatenate([[0], np.cumsum(length)]).tolist()
    return [letters[a:b] for a, b in zip(cut, cut[1:])], (pointer[begin] - 4 * n) % 4, ahead[begin]


def written(edits: str, roles: list[str], texts: list[str], state: int) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired rows."""
    i = 0
    for e in edits:
        if e == "D":
            i += 1
            continue
        if e == "K":
            state = int(AFTER_KEEP[state, INITIALS[roles[i][:1]]])
            yield roles[i], texts[i]
        else:
            state = int(NEXT[state])
            yield NAMES[state], texts[i] if e == "R" else ""
        i += e != "I"


def _pair(a: int, b: int) -> int:
    return int((a, b) not in LEGAL_PAIRS)


class _Segment:
    """Rows of one conversation, in order, with counts that add up over segments."""

    def __init__(self):
        self.turns, self.roles, self.texts, self.initial, self.fault, self.bytes = [], [], [], [], [], 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.initial.append(INITIALS.get(role[:1], 0))
        self.fault.append(fault)
        self.bytes += len(text)

    def counts(self) -> dict:
        turns = [t for t in self.turns if t is not None]
        out = {"low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(set(turns))}
        out |= {name: self.fault.count(i + 1) for i, name in enumerate(FAULTS)}
        return out | {"illegal": sum(_pair(a, b) for a, b in zip(self.initial, self.initial[1:])), "head": self.initial[0], "tail": self.initial[-1]}


COUNTS = ["low", "high", "turns", *FAULTS, "illegal", "head", "tail"]


def _added(a: dict | None, b: dict) -> dict:
    """Counts of two neighbouring stretches."""
    if a is None:
        return dict(b)
    out = {name: a[name] + b[name] for name in ("turns", *FAULTS, "illegal")}
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    out["illegal"] += _pair(a["tail"], b["head"])
    return out | {"low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"],
                  "head": a["head"], "tail": b["tail"]}


def _gaps(c: dict) -> int:
    return 0 if c["low"] is None else c["high"] - c["low"] + 1 - c["turns"]


ROWS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def _result_schema(conv: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("conv", conv), *[T.StructField(c, T.LongType()) for c in ("gaps", *FAULTS, "illegal", "cost")],
                         T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType()), T.StructField("repaired", ROWS)])


def _segment_schema(conv: T.DataType) -> T.StructType:
    done = _result_schema(conv).fields
    return T.StructType([*done, T.StructField("part", T.IntegerType()), T.StructField("k", T.LongType()), T.StructField("whole", T.BooleanType()),
                         *[T.StructField(c, T.LongType()) for c in COUNTS if c not in {f.name for f in done}],
                         T.StructField("initials", T.BinaryType()), T.StructField("faults", T.BinaryType()), T.StructField("rows", ROWS)])


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _segments(rows: DataFrame, schema: T.StructType, segment_rows: int, with_rows: bool):
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, first_conv, conv, k, part = False, True, None, 0, 0
        now, previous = _Segment(), None
        whole: list[tuple[object, _Segment]] = []

        def open_segment() -> dict:
            row = {"conv": conv, "part": part, "k": k, "whole": False, **now.counts(), "initials": bytes(now.initial), "faults": bytes(now.fault),
                   "rows": [{"role": r, "text": t} for r, t in zip(now.roles, now.texts)]}
            return {c: row.get(c) for c in arrow.names}

        def solved() -> list[dict]:
            segs = [s for _, s in whole]
            first = np.concatenate([[0], np.cumsum([len(s.initial) for s in segs])]).astype(np.int64)
            starts = np.stack([np.arange(len(segs)), np.zeros(len(segs), dtype=np.int64)], axis=1)
            edits, state, cost = least_paths(first, np.array([x for s in segs for x in s.initial]), np.array([x for s in segs for x in s.fault]),
                                             np.tile(END, (len(segs), 1)), starts)
            out = []
            for (c, s), e, end, price in zip(whole, edits, state.tolist(), cost.tolist()):
                counts, e = s.counts(), e + AT_END[end]
                pairs = list(written(e, s.roles, s.texts, START))
                row = counts | {"conv": c, "whole": True, "gaps": _gaps(counts), "cost": price, "audit": e, "repaired_sha256": hashlib.sha256(
                    "\n".join(f"{r}:{t}" for r, t in pairs).encode()).hexdigest(), "repaired": [{"role": r, "text": t} for r, t in pairs] if with_rows else None}
                out.append({x: row.get(x) for x in arrow.names})
            return out

        held = 0
        for batch in batches:
            for p, c, turn, role, text, fault in zip(*[x.to_pylist() for x in batch.columns]):
                if not begun or c != conv:
                    if begun:
                        if first_conv or k:
                            yield pa.RecordBatch.from_pylist([open_segment()], arrow)
                        else:
                            whole.append((conv, now))
                            held += len(now.initial) + now.bytes // 512
                        first_conv = False
                    begun, conv, k, part, now, previous = True, c, 0, p, _Segment(), None
                    if held >= BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(solved(), arrow)
                        whole, held = [], 0
                elif len(now.initial) >= segment_rows or now.bytes >= SEGMENT_BYTES:
                    yield pa.RecordBatch.from_pylist([open_segment()], arrow)
                    k, now = k + 1, _Segment()
                if (turn, role, text) == previous and fault != 1:
                    fault = 2
                previous = turn, role, text
                now.add(turn, role, text, fault)
        if whole:
            yield pa.RecordBatch.from_pylist(solved(), arrow)
        if begun:  # the next task may hold more of it
            yield pa.RecordBatch.from_pylist([open_segment()], arrow)

    keys = ["conv", "turn", "role"]
    dealt = rows.repartitionByRange(*keys, F.substring("text", 1, 32)).sortWithinPartitions(*keys, "text")
    return dealt.select(F.spark_partition_id().alias("part"), "conv", "turn", "role", "text", "fault").mapInArrow(run, schema)


def _numbers(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype=np.uint8).astype(np.int64)


def _open_results(segs: DataFrame, conv: T.DataType, with_rows: bool) -> DataFrame:
    """Results of conversations that lie in several segments or at the edge of a task."""
    key = [T.StructField("conv", conv), T.StructField("part", T.IntegerType()), T.StructField("k", T.LongType())]
    narrow = [T.StructField("initials", T.BinaryType()), T.StructField("faults", T.BinaryType())]
    longs = T.ArrayType(T.LongType())
    costs = T.StructType([*key, *narrow, T.StructField("costs", longs)])
    owed = T.StructType([*key, *narrow, T.StructField("right", longs)])
    ways = T.StructType([*key, T.StructField("edits", T.ArrayType(T.StringType())), T.StructField("exits", longs), T.StructField("cost", longs),
                         T.StructField("end", T.BooleanType())])

    def add_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                initial, fault = _numbers(row["initials"]), _numbers(row["faults"])
                first, unit = np.array([0, len(initial)]), np.where(np.eye(4, dtype=bool), 0, INF)
                out.append(row | {"costs": np.stack([togo(first, initial, fault, unit[i:i + 1])[0] for i in range(4)], axis=1).ravel().tolist()})
            yield pa.RecordBatch.from_pylist(out, _arrow(costs))

    def add_owed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv, right = False, None, END
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row["conv"] != conv:
                    begun, conv, right = True, row["conv"], END
                between = np.array(row.pop("costs")).reshape(4, 4)
                out.append(row | {"right": right.tolist()})
                right = (between + right[None, :]).min(axis=1)
            yield pa.RecordBatch.from_pylist(out, _arrow(owed))

    def add_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                initial = _numbers(row["initials"])
                edits, exits, cost = least_paths(np.array([0, len(initial)]), initial, _numbers(row["faults"]), np.array([row["right"]]),
                                                 np.stack([np.zeros(4, dtype=np.int64), np.arange(4)], axis=1))
                out.append({c: row[c] for c in ("conv", "part", "k")} | {"edits": edits, "exits": exits.tolist(), "cost": cost.tolist(), "end": None})
            yield pa.RecordBatch.from_pylist(out, _arrow(ways))

    schema = _result_schema(conv)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv = False, None
        edits = ""

        def finished() -> pa.RecordBatch:
            tail = list(written(AT_END[state], [], [], state))
            put(tail)
            row = counts | {"conv": conv, "gaps": _gaps(counts), "cost": price, "audit": "".join(audit) + AT_END[state],
                            "repaired_sha256": digest.hexdigest(), "repaired": kept if with_rows else None}
            return pa.RecordBatch.from_pylist([{c: row.get(c) for c in schema.names}], _arrow(schema))

        def put(pairs) -> None:
            nonlocal empty
            for r, t in pairs:
                digest.update((f"{r}:{t}" if empty else f"\n{r}:{t}").encode())
                empty = False
                if with_rows:
                    kept.append({"role": r, "text": t})

        for batch in batches:
            for row in batch.to_pylist():
                if not begun or row["conv"] != conv:
                    if begun:
                        yield finished()
                    begun, conv, state, audit, kept, counts, price, empty, digest = True, row["conv"], START, [], [], None, None, True, hashlib.sha256()
                if row["kind"] == 0:
                    edits, leave = row["edits"][state], row["exits"][state]
                    price = row["cost"][state] if price is None else price
                    audit.append(edits)
                else:
                    put(written(edits, [r["role"] for r in row["rows"]], [r["text"] for r in row["rows"]], state))
                    counts, state = _added(counts, {c: row[c] for c in COUNTS}), leave
        if begun:
            yield finished()

    at = ["conv", "part", "k"]
    open_rows = segs.where(~F.col("whole"))
    priced = open_rows.select(*at, "initials", "faults").mapInArrow(add_costs, costs)
    back = priced.repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("k")).mapInArrow(add_owed, owed)
    ranked = back.repartition(*at).mapInArrow(add_ways, ways)
    both = (ranked.select(*at, F.lit(0).alias("kind"), "edits", "exits", "cost")
            .unionByName(open_rows.select(*at, F.lit(1).alias("kind"), *COUNTS, "rows"), allowMissingColumns=True))
    return both.repartition("conv").sortWithinPartitions(*at, "kind").mapInArrow(walk, schema)


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", *,
           damaged: bool = False, segment_rows: int = SEGMENT_ROWS, with_rows: bool = False) -> DataFrame:
    """One row for each conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost`` (longs), ``audit``,
    ``repaired_sha256``, and ``repaired`` (array of role and text; null unless ``with_rows``).

    Rows go by turn (a whole number), nulls first, then role and text. Null roles and texts count as one space, null
    conversation ids are one conversation. A row's first fault counts: blank, role and text seen earlier (a repeated row is
    one), last character that isn't white space none of ``.!?``. ``audit`` has the initials of the cheapest edits (Delete,
    Insert, Keep, Rerole) that leave an optional system row and pairs of user and assistant, the ASCII-least of equally cheap
    ones. ``damaged`` applies ``damage`` first; conversations that lose all rows have zeros and empty texts. Roles go by their
    first letter; other roles are never legal. Empty tables give empty tables; other columns are not read.
    """
    kind = rows.schema[conv_id].dataType
    q = lambda c: F.col(f"`{c}`")
    plain: Column = F.lit(" ")
    base = rows.select(q(conv_id).alias("conv"), q(turn).cast("long").alias("turn"), F.coalesce(q(role).cast("string"), plain).alias("role"),
                       F.coalesce(q(text).cast("string"), plain).alias("text"))
    found = _faults(damage(base) if damaged else base)
    segs = write_and_read(_segments(found, _segment_schema(kind), segment_rows, with_rows), "conversation-segments")
    names = _result_schema(kind).names
    done = segs.where("whole").select(*names).unionByName(_open_results(segs, kind, with_rows))
    every = base.select(F.col("conv").alias("conv_id")).distinct()
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in names[1:7]}
    zeros |= {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256))}
    return every.join(done, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *[zeros[c].alias(c) for c in names[1:9]], "repaired")
