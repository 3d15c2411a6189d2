"""Conversation repair by a parallel Viterbi search with rank convergence.

The rows of a conversation are kept, given another role, deleted, or joined by inserted rows, at the least cost that gives turns
`(s?(ua)+)?`; of all cheapest repairs the one whose list of edits is least in ASCII is taken. The search runs over four states
(nothing yet, after system, after user, after assistant) in steps of one row.

Rows are sorted by range over the whole table, so a conversation of any size lies in neighbouring partitions, and cut into chunks
of at most `chunk_rows` rows; a chunk travels as one byte per row. What stands to the right of a chunk is not known, so its
backward costs start from speculative vectors: four that span, by minimum and sum, every vector that can stand there. Where the
four results differ only by constants the chunk has converged: its left vector is right whatever follows. The others take part in
fix-up rounds, in which a chunk takes over the vectors of the chunk that it waits for and then waits for the next but one, next
but three, ..., until all have converged: a round for each doubling, whatever the rows are. With its right vector each chunk's
costs are run once more, exactly but for a constant, and the least audit is traced for each state it may start in; constants never
change a choice. Which start holds is stitched forward in the same way. All chunks of a batch move in step, as numpy arrays.

Defined results: null roles and texts are one space, so such rows are blank or have no legal role; null turns come first; rows of
one turn are ordered by role, text, and place in the input; a row whose role has an initial other than s, u and a can't be kept;
repeated rows are duplicates; conversations without rows give zeros; an empty table gives no rows; a null conv_id is a
conversation like others; extra columns are never read. The digest of a repaired conversation is one SHA-256 over all its text, a
chain by nature: one task streams it, and holds a line at a time.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: States of the search.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
#: What an insert gives, and where a row of each initial (s, u, a, other) leads; -1: nowhere.
INSERTED = np.array([USER, USER, ASSISTANT, USER])
KEPT = np.array([[SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1, -1, -1, -1]])
#: Cost to end in each state: an unfinished exchange needs its rest.
END = np.array([0, 6, 3, 0], dtype=np.int64)
NEVER = 1 << 40
#: code = initial (s, u, a, other) + 4 * (0 sound, 1 cut off, 2 to be deleted)
CODES = 12


def _inserts(costs: np.ndarray) -> np.ndarray:
    """The costs (last axis: state) when rows may be inserted first."""
    for _ in range(3):
        costs = np.minimum(costs, INSERT + costs[..., INSERTED])
    return costs


def _steps() -> np.ndarray:
    """Of each code, the cost from state to state without inserts."""
    out = np.full((CODES, 4, 4), NEVER, dtype=np.int64)
    for code in range(CODES):
        initial, fault = code % 4, code // 4
        for state in range(4):
            out[code, state, state] = DELETE
            if fault < 2:
                extra = CUT_OFF * (fault == 1)
                to = INSERTED[state]  # another role: the one that is due
                out[code, state, to] = min(out[code, state, to], REROLE + extra)
                if KEPT[initial, state] >= 0:
                    to = KEPT[initial, state]
                    out[code, state, to] = min(out[code, state, to], KEEP + extra)
    return out


STEPS = _steps()
KEEPS = np.array([[KEPT[c % 4, s] if c < 8 else -1 for s in range(4)] for c in range(CODES)])


def _spanning() -> np.ndarray:
    """Four vectors that span every vector of costs that can stand at the right of a chunk.

    Such costs obey cost[x] <= limit(x, y) + cost[y]: after nothing a row can do what it can after an assistant, an insert leads on,
    deleting one system row gives back a start, two inserts close an exchange. The shortest chains of these limits are the span."""
    limit = np.full((4, 4), NEVER, dtype=np.int64)
    np.fill_diagonal(limit, 0)
    for x in range(4):
        limit[x, INSERTED[x]] = INSERT
    limit[NOTHING, ASSISTANT], limit[ASSISTANT, SYSTEM] = 0, 0
    limit[ASSISTANT, NOTHING], limit[SYSTEM, ASSISTANT] = DELETE, 2 * INSERT
    for k in range(4):
        limit = np.minimum(limit, limit[:, k : k + 1] + limit[k : k + 1, :])
    return limit.T.copy()  # row y: the vector for a cost of 0 in y


SPAN = _spanning()


def backward(codes: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Costs in front of each row, and at the right end: (rows + 1, chunks, ..., 4) from codes (chunks, rows) and vectors at the right."""
    out = np.empty((codes.shape[1] + 1, *right.shape), dtype=np.int64)
    out[-1] = right
    extra = right.ndim - 2
    for i in range(codes.shape[1] - 1, -1, -1):
        step = STEPS[codes[:, i]].reshape(len(codes), *[1] * extra, 4, 4)
        out[i] = _inserts((step + out[i + 1][..., None, :]).min(-1))
        out[i] -= out[i].min(-1, keepdims=True)  # constants change no choice
    return out


def leftmost(codes: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The costs in front of the first row only."""
    now, extra = right, right.ndim - 2
    for i in range(codes.shape[1] - 1, -1, -1):
        step = STEPS[codes[:, i]].reshape(len(codes), *[1] * extra, 4, 4)
        now = _inserts((step + now[..., None, :]).min(-1))
    return now


_D, _I, _K, _R = (ord(c) for c in "DIKR")
_INITIAL = np.frombuffer(b" sua", dtype=np.uint8)


def traced(codes: np.ndarray, costs: np.ndarray, start: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The least audit: edits and resulting roles of each row in seven slots (0: none), each row's cost, and the final states.

    Choices compare costs that have lost a constant for each row, so the constant is taken from the best way out of the state."""
    n, rows = codes.shape
    edits, roles = np.zeros((n, rows, 7), np.uint8), np.zeros((n, rows, 7), np.uint8)
    paid, state, every = np.zeros((n, rows), np.int64), start.copy(), np.arange(n)
    for i in range(rows):
        after = costs[i + 1]
        code = codes[:, i]
        own = (STEPS[code] + after[:, None, :]).min(-1)  # without inserts
        best = _inserts(own)
        fault = (code // 4 == 1) * CUT_OFF
        open_ = np.ones(n, dtype=bool)
        for slot in range(4):
            if not open_.any():
                break
            goal = best[every, state]
            deletes = open_ & (DELETE + after[every, state] == goal)
            to = INSERTED[state]
            inserts = open_ & ~deletes & (INSERT + best[every, to] == goal)
            keep = KEEPS[code, state]
            keeps = open_ & ~deletes & ~inserts & (keep >= 0)
            keeps &= np.where(keep >= 0, KEEP + fault + after[every, np.maximum(keep, 0)], NEVER) == goal
            changes = open_ & ~deletes & ~inserts & ~keeps
            edits[deletes, i, slot], edits[inserts, i, slot], edits[keeps, i, slot], edits[changes, i, slot] = _D, _I, _K, _R
            paid[:, i] += np.select([deletes, inserts, keeps, changes], [DELETE, INSERT, KEEP + fault, REROLE + fault], 0)
            state = np.where(inserts | changes, to, np.where(keeps, keep, state))
            gives = inserts | keeps | changes
            roles[gives, i, slot] = _INITIAL[state[gives]]
            open_ &= inserts
        assert not open_.any()
    if rows:  # behind the last row of a conversation: what closes an exchange
        for slot in range(4, 6):
            more = last & (END[state] > 0)
            state = np.where(more, INSERTED[state], state)
            edits[more, -1, slot], roles[more, -1, slot] = _I, _INITIAL[state[more]]
            paid[more, -1] += INSERT
    return edits, roles, paid, state


# ---- rows ----


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the damage that the checksum of `conv_id:turn` chooses: dropped, emptied, cut off, repeated, or made a user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    copies = F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        conversations.select("conv_id", "turn", "role", "text", way.alias("way"), F.monotonically_increasing_id().alias("place"))
        .where("way <> 0").select("conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), "place", F.explode(copies).alias("copy"))
    )


ORDER = ["turn", "role", "text", "place", "copy"]


def in_order(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, place, copy) with fault, code and pos: a number that grows in order, without gaps in a partition.

    A row is a duplicate unless it is the first of its conversation, role and text; that first row is an aggregate and joined back."""
    seen = "[^\\x20\\x09-\\x0D]"
    rows = stored(rows.withColumn("digest", F.sha2("text", 256)), "turns")
    place = F.struct(F.col("turn"), F.col("place"), F.col("copy"))
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(place).alias("first"))
    both = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    # possessive and from the end: the last visible character
    last = F.regexp_extract("text", "([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*+\\z", 1)
    fault = F.when(~F.col("text").rlike(seen), "blank").when(~place.eqNullSafe(F.col("first")), "duplicate").when(~last.rlike("[.!?]"), "truncated")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = kind + 4 * F.when(F.col("fault").isin("blank", "duplicate"), 2).when(F.col("fault") == "truncated", 1).otherwise(0)
    marked = both.select("conv_id", *ORDER, fault.alias("fault")).withColumn("code", code)
    ordered = marked.repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    return stored(ordered.select("conv_id", "turn", "role", "text", "fault", "code", F.monotonically_increasing_id().alias("pos")), "ordered")


def chunked(ordered: DataFrame, chunk_rows: int) -> DataFrame:
    """(conv_id, at, codes, before, after): a row per chunk of neighbouring rows; before and after: the chunks beside it, by their first pos."""
    inside = F.shiftrightunsigned("pos", 33), F.floor(F.col("pos").bitwiseAND((1 << 33) - 1) / chunk_rows)
    cut = ordered.groupBy("conv_id", inside[0].alias("part"), inside[1].alias("block")).agg(
        F.min("pos").alias("at"), F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("rows"))
    chunks = stored(cut.select("conv_id", "at", F.transform("rows", lambda r: r["code"].cast("tinyint")).alias("codes")), "chunks")
    # one row per chunk: a window over the chunks of a conversation, not over its rows
    beside = "OVER (PARTITION BY conv_id ORDER BY at)"
    return chunks.selectExpr("*", f"lag(at) {beside} AS before", f"lead(at) {beside} AS after", f"lead(codes[0]) {beside} AS next_code")


def _padded(batch: pa.RecordBatch, most: int = 1 << 22):
    """Chunks of a batch in groups of equal length: (their rows in the batch, codes as a matrix). A group has at most `most` codes."""
    column = batch.column("codes")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    for size, group in groupby(order.tolist(), key=lambda i: int(sizes[i])):
        members, each = list(group), max(1, most // (16 * max(1, size)))
        for k in range(0, len(members), each):
            some = np.array(members[k : k + each])
            yield some, flat[starts[some][:, None] + np.arange(size)]


def speculated(chunks: DataFrame) -> DataFrame:
    """(at, before, after, left): the backward costs in front of each chunk, for the four spanning vectors behind it."""

    def run(batches):
        for batch in batches:
            left = np.zeros((batch.num_rows, 16), np.int64)
            final = np.array([x is None for x in batch.column("after").to_pylist()])
            for some, codes in _padded(batch):
                right = np.where(final[some][:, None, None], END, SPAN)
                left[some] = leftmost(codes, right).reshape(len(some), 16)
            flat = pa.ListArray.from_arrays(np.arange(0, 16 * batch.num_rows + 1, 16, dtype=np.int32), pa.array(left.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("after"), flat], ["at", "after", "left"])

    return chunks.select("at", "after", "codes").mapInArrow(run, "at bigint, after bigint, `left` array<bigint>")


def _fixed_up(table: DataFrame, other: str, combined: str, done: str) -> DataFrame:
    """Chains (at, other, value) by doubling: as long as a value still depends on the chunk `other`, it takes that one's value in and
    waits for the one that this waits for. combined: SQL of the new value from `mine` and `theirs`; done: SQL that says `value` is settled."""
    settled = f"CASE WHEN {done} THEN NULL ELSE {other} END AS {other}"
    table = stored(table.selectExpr("at", settled, "value"), "chain")
    while table.where(f"{other} IS NOT NULL").limit(1).count():
        that = table.selectExpr(f"at AS {other}", f"{other} AS further", "value AS theirs")
        waits = table.where(f"{other} IS NOT NULL").withColumnRenamed("value", "mine").join(that, other)
        moved = waits.selectExpr("at", f"further AS {other}", f"{combined} AS value").selectExpr("at", settled, "value")
        table = stored(table.where(f"{other} IS NULL").select("at", other, "value").unionByName(moved), "chain")
    return table.select("at", "value")


#: value[4 y + x]: cost in x for the spanning vector y; a product by minimum and sum.
_PRODUCT = "transform(sequence(0, 15), i -> array_min(transform(sequence(0, 3), k -> theirs[(i div 4) * 4 + k] + mine[4 * k + i % 4])))"
#: All four vectors differ only by constants.
_CONVERGED = "forall(sequence(4, 15), i -> value[i] - value[i - i % 4] = value[i % 4] - value[0])"
_SAME_END = "forall(value, x -> x = value[0])"


def right_costs(chunks: DataFrame) -> DataFrame:
    """(at, right): costs behind each chunk that has a chunk after it, but for a constant."""
    several = chunks.where("before IS NOT NULL OR after IS NOT NULL")
    left = _fixed_up(speculated(several).withColumnRenamed("left", "value"), "after", _PRODUCT, _CONVERGED)
    return several.where("after IS NOT NULL").select("at", "after").join(left.select(F.col("at").alias("after"), F.slice("value", 1, 4).alias("right")), "after").select("at", "right")


def traces(chunks: DataFrame) -> DataFrame:
    """(conv_id, at, before, start, end, edits, roles, paid): the least audit of each chunk from each state it may start in."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            final = np.array([x is None for x in batch.column("after").to_pylist()], dtype=bool)
            first = np.array([x is None for x in batch.column("before").to_pylist()], dtype=bool)
            given = batch.column("right").to_pylist()
            right = np.array([END if v is None else v for v in given], dtype=np.int64).reshape(n, 4)
            where, starts, ends, edits, roles, paid = [], [], [], [], [], []
            for some, codes in _padded(batch):
                costs = backward(codes, right[some])
                for start in range(4):
                    these = np.ones(len(some), dtype=bool) if start == NOTHING else ~first[some]
                    if these.any():
                        e, r, p, at_end = traced(codes[these], costs[:, these], np.full(int(these.sum()), start), final[some][these])
                        where += some[these].tolist()
                        starts += [start] * int(these.sum())
                        ends += at_end.tolist()
                        for out, letters in ((edits, e), (roles, r)):
                            out += [[bytes(x).replace(b"\0", b"").decode() for x in row] for row in letters]
                        paid += p.tolist()
            index = pa.array(where, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id").take(index), batch.column("at").take(index), batch.column("before").take(index), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()),
                 pa.array(edits, pa.list_(pa.string())), pa.array(roles, pa.list_(pa.string())), pa.array(paid, pa.list_(pa.int64()))],
                ["conv_id", "at", "before", "start", "end", "edits", "roles", "paid"])

    conv = chunks.schema["conv_id"].dataType.simpleString()
    return chunks.select("conv_id", "at", "before", "after", "codes", "right").mapInArrow(
        run, f"conv_id {conv}, at bigint, before bigint, start int, `end` int, edits array<string>, roles array<string>, paid array<bigint>")


def edited(chunks: DataFrame) -> DataFrame:
    """(conv_id, pos, edits, roles, paid): what the cheapest repair does at each row: the letters of its edits in order (inserts in
    front, the row itself, inserts behind the last row), the initials of the roles they give, and their cost."""
    all_traces = stored(traces(chunks.join(right_costs(chunks), "at", "left")), "traces")
    # the state at each chunk's right end, for each state it may start in; a first chunk starts from nothing
    ends = all_traces.groupBy("at").agg(F.max("before").alias("before"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("m"))
    ends = ends.selectExpr("at", "before", "CASE WHEN size(m) = 1 THEN array_repeat(m[0].end, 4) ELSE transform(m, x -> x.end) END AS value")
    several = ends.where("before IS NOT NULL OR value IS NOT NULL")
    reached = _fixed_up(several, "before", "transform(theirs, x -> mine[x])", f"before IS NULL OR {_SAME_END}")
    state = reached.select(F.col("at").alias("before"), F.col("value")[0].alias("state"))
    right = all_traces.join(state, "before", "left").where("start = coalesce(state, 0)")
    rows = right.select("conv_id", "at", F.posexplode(F.arrays_zip("edits", "roles", "paid")).alias("i", "e"))
    return rows.select("conv_id", (F.col("at") + F.col("i")).alias("pos"), "e.edits", "e.roles", "e.paid")


def repaired(ordered: DataFrame, edits: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: (conv_id, pos, part, role, text); inserted rows have an empty text."""
    said = F.create_map(F.lit("u"), F.lit("user"), F.lit("a"), F.lit("assistant"))
    both = ordered.select("pos", "role", "text").join(edits.where("roles <> ''"), "pos")
    letters = F.split(F.regexp_replace("edits", "D", ""), "")
    each = both.select("conv_id", "pos", "role", "text", F.posexplode(F.arrays_zip(letters.alias("edit"), F.split("roles", "").alias("to"))).alias("part", "e"))
    kept = F.col("e.edit") == "K"
    return each.select(
        "conv_id", "pos", "part", F.when(kept, F.col("role")).otherwise(said[F.col("e.to")]).alias("role"), F.when(F.col("e.edit") == "I", "").otherwise(F.col("text")).alias("text"))


def digests(ordered: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256): streamed in order; a task holds a line and an audit at a time."""
    lines = repaired(ordered, edits).groupBy("pos").agg(F.sort_array(F.collect_list(F.struct("part", F.concat_ws(":", "role", "text").alias("line")))).alias("l"))
    lines = lines.select("pos", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("line"))
    rows = edits.select("conv_id", "pos", "edits").join(lines, "pos", "left")
    streamed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "edits", "line")
    conv = streamed.schema["conv_id"].dataType.simpleString()

    def run(batches):
        now, begun = None, False
        hasher, audit, lines_seen = hashlib.sha256(), [], 0
        done: list[tuple] = []
        kind = pa.int64()

        def out(kind):
            ids, audits, sums = zip(*done, strict=True)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(ids), kind), pa.array(list(audits)), pa.array(list(sums))], ["conv_id", "audit", "repaired_sha256"])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv_id, edit, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or conv_id != now:
                    if begun:
                        done.append((now, "".join(audit), hasher.hexdigest()))
                    now, begun, hasher, audit, lines_seen = conv_id, True, hashlib.sha256(), [], 0
                audit.append(edit)
                if line is not None:
                    hasher.update(("\n" + line if lines_seen else line).encode("utf-8", "surrogatepass"))
                    lines_seen += 1
            if len(done) >= 4096:
                yield out(kind)
        if begun:
            done.append((now, "".join(audit), hasher.hexdigest()))
            yield out(kind)

    return streamed.mapInArrow(run, f"conv_id {conv}, audit string, repaired_sha256 string")


def counts(ordered: DataFrame, chunks: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal) of the rows after damage."""
    many = lambda what: F.count(F.when(F.col("fault") == what, 1)).alias(what)
    turns = ordered.groupBy("conv_id", "turn").agg(*[many(x) for x in ("blank", "duplicate", "truncated")])
    total = turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")])
    legal = "((a % 4 = 0 AND b % 4 = 1) OR (a % 4 = 1 AND b % 4 = 2) OR (a % 4 = 2 AND b % 4 = 1))"
    inside = "CASE WHEN size(codes) > 1 THEN size(filter(zip_with(slice(codes, 1, size(codes) - 1), slice(codes, 2, size(codes)), (a, b) -> " + legal + "), x -> NOT x)) ELSE 0 END"
    border = "CASE WHEN next_code IS NOT NULL AND NOT " + legal.replace("(a %", "(element_at(codes, -1) %").replace("b %", "next_code %") + " THEN 1 ELSE 0 END"
    illegal = chunks.groupBy(F.col("conv_id").alias("c")).agg(F.sum(F.expr(f"{inside} + {border}")).cast("long").alias("illegal"))
    return total.join(illegal, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


def audited(conversations: DataFrame, chunk_rows: int = 65_536) -> DataFrame:
    """The row per conversation of the contract."""
    ordered = in_order(damaged(conversations))
    chunks = stored(chunked(ordered, chunk_rows), "chunks")
    edits = stored(edited(chunks), "edits")
    paid = edits.groupBy("conv_id").agg(F.sum("paid").alias("cost"))
    every = conversations.select("conv_id").distinct()
    out = every
    for part in (counts(ordered, chunks), paid, digests(ordered, edits)):
        out = out.join(part.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        "conv_id", *[whole(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
