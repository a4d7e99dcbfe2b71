"""Repair of conversations at least cost, by parallel Viterbi with rank convergence.

The rows of all conversations are sorted by range into chunks, so that one long conversation spans many chunks. A chunk runs
backwards from a speculative vector of costs (one cost for each state of the pattern), at first that of a conversation's
end. Fix-up passes rerun chunks whose successor begins with another vector, until the vectors differ only by a constant
from those of the run before; what a chunk makes of a vector is kept, so that a vector is never run twice and the passes end
whatever a conversation's length. The vectors at all borders then follow by jumps of doubled length, and the costs drive a
forward trace in each chunk from every state that it may be entered in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import discard, materialize

# Contract: the costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after a system row, after a user row, after an assistant row. What follows a state by inserting or
#: changing roles, and by keeping a row of a role's initial.
NEXT = (2, 2, 3, 2)
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Costs from each state to the end of a conversation that has no more rows.
END = (0, 2 * INSERT, INSERT, 0)
CHUNK_ROWS = 1 << 16
SPACES = " \t\n\x0b\x0c\r"

Vector = tuple[int, int, int, int]


@lru_cache(1 << 16)
def before(after: Vector, symbol: str) -> Vector:
    """Costs before a row of the costs after it. symbol: the role's initial, and ! if the row is truncated."""
    more = TRUNCATED * symbol.endswith("!")
    own = KEPT.get(symbol[:1], {})
    out = []
    for state in range(4):
        ways = [DELETE + after[state], REROLE + more + after[NEXT[state]]]
        if state in own:
            ways.append(more + after[own[state]])
        out.append(min(ways))
    user, assistant = min(out[2], INSERT + out[3]), min(out[3], INSERT + out[2])
    return min(out[0], INSERT + user), min(out[1], INSERT + user), user, assistant


@lru_cache(1 << 16)
def alike(costs: Vector) -> Vector:
    """One for all vectors that differ by a constant."""
    least = min(costs)
    return tuple(c - least for c in costs)


@lru_cache(1 << 16)
def least_edits(after: Vector, symbol: str) -> tuple[tuple[str, int], ...]:
    """(edits, next state) from each state over a row: of the cheapest ones the least in ASCII order."""
    now, more, out = before(after, symbol), TRUNCATED * symbol.endswith("!"), []
    for state in range(4):
        edits, own = "", KEPT.get(symbol[:1], {})
        while True:
            if now[state] == DELETE + after[state]:
                out.append((edits + "D", state))
            elif now[state] == INSERT + now[NEXT[state]]:
                edits, state = edits + "I", NEXT[state]
                continue
            elif state in own and now[state] == more + after[own[state]]:
                out.append((edits + "K", own[state]))
            else:
                out.append((edits + "R", NEXT[state]))
            break
    return tuple(out)


def last_edits(state: int) -> str:
    return "I" * (END[state] // INSERT)


def run_back(symbols: list[str], end: Vector, known: tuple[Vector, Vector] | None = None) -> Vector:
    """The vector at the start of rows that end in another one. known: an end and the start that it led to; the pass stops
    where both runs differ only by a constant."""
    now, old = alike(end), known and known[0]
    for symbol in reversed(symbols):
        if now == old:
            return known[1]
        now = alike(before(now, symbol))
        old = old and alike(before(old, symbol))
    return now


def told(v: Vector) -> str:
    return ",".join(map(str, v))


def read(v: str) -> Vector:
    return tuple(map(int, v.split(",")))


def per_chunk(rows: DataFrame, f: Callable[[list[tuple]], Iterator[tuple]], kinds: dict[str, str], *orders: str) -> DataFrame:
    """f over the rows of each chunk (their first column), in order; a chunk is held whole."""
    arrow = pa.schema([(k, {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}[t]) for k, t in kinds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks() -> Iterator[list[tuple]]:
            held: list[tuple] = []
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held and held[0][0] != row[0]:
                        yield held
                        held = []
                    held.append(row)
            if held:
                yield held

        for chunk in chunks():
            made = [*f(chunk)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else [[]] * len(kinds), arrow.types, strict=True)], schema=arrow)

    return rows.repartition(rows.columns[0]).sortWithinPartitions(rows.columns[0], *orders).mapInArrow(run, ", ".join(f"{k} {t}" for k, t in kinds.items()))


SUMMARY = {"pid": "long", "first": "long", "last": "long", "whole": "boolean", "ends": "string", "starts": "string"}


def speculated(chunk: list[tuple]) -> Iterator[tuple]:
    """A row for the chunk (pid, seq, conv_id, symbol): its first and last conversation, whether they are one, and what its
    first conversation starts with if it ends here."""
    first, last = chunk[0][2], chunk[-1][2]
    whole = first == last
    symbols = [r[3] for r in chunk if r[2] == first]
    yield chunk[0][0], first, last, whole, told(END), told(run_back(symbols, END))


def refitted(chunk: list[tuple]) -> Iterator[tuple]:
    """Rows (pid, ends, starts) for the vectors that a chunk of one conversation (pid, seq, symbol, ends, starts, wanted) has
    not yet been run from."""
    symbols, (_, _, _, ends, starts, wanted) = [r[2] for r in chunk], chunk[0]
    for end in wanted:
        yield chunk[0][0], end, told(run_back(symbols, read(end), (read(ends), read(starts))))


def resolved(rows: DataFrame, value: str, by: str, step: int) -> DataFrame:
    """rows (pid, value, by): value where it is null is by[value of pid + step]; jumps double until all are known."""
    rows = materialize(rows.withColumn("_jump", F.col("pid") + step), "jumps")
    while not rows.where(F.col(value).isNull()).isEmpty():
        ahead = rows.select(F.col("pid").alias("_jump"), F.col(value).alias("_value"), F.col(by).alias("_by"), F.col("_jump").alias("_then"))
        both = rows.join(ahead, "_jump", "left")
        open_ = F.col(value).isNull()
        mapped = F.transform_values("_by", lambda _, v: F.try_element_at(F.col(by), v))
        then = materialize(both.select("pid", F.coalesce(value, F.try_element_at(F.col(by), F.col("_value"))).alias(value), F.when(open_, mapped).otherwise(F.col(by)).alias(by), F.when(open_, F.col("_then")).otherwise(F.col("_jump")).alias("_jump")), "jumps")
        discard(rows)
        rows = then
    return rows.select("pid", value)


def border_vectors(rows: DataFrame) -> DataFrame:
    """pid, linked (the last conversation goes on in the next chunk), begun (the first one began before), single, end (the
    vector at the chunk's end) of the chunks of rows (pid, seq, conv_id, symbol)."""
    summary = materialize(per_chunk(rows.select("pid", "seq", "conv_id", "symbol"), speculated, SUMMARY, "seq"), "chunks")
    after = summary.select((F.col("pid") - 1).alias("pid"), F.col("first").alias("_first"), F.lit(True).alias("_has"))
    prior = summary.select((F.col("pid") + 1).alias("pid"), F.col("last").alias("_last"), F.lit(True).alias("_had"))
    goes = F.coalesce(F.col("_has") & F.col("_first").eqNullSafe(F.col("last")), F.lit(False))
    came = F.coalesce(F.col("_had") & F.col("_last").eqNullSafe(F.col("first")), F.lit(False))
    summary = summary.join(after, "pid", "left").join(prior, "pid", "left").select("pid", goes.alias("linked"), came.alias("begun"), "whole", "ends", "starts")
    chunks = materialize(summary.withColumn("seen", F.create_map("ends", "starts")), "chunks")
    while True:
        offers = chunks.select((F.col("pid") - 1).alias("pid"), F.map_values("seen").alias("_offers"))
        wanted = F.array_except(F.array_distinct("_offers"), F.map_keys("seen"))
        asked = chunks.where("linked and whole").join(offers, "pid").withColumn("wanted", wanted).where("size(wanted) > 0").select("pid", "ends", "starts", "wanted")
        asked = materialize(asked, "asked")
        if asked.isEmpty():
            break
        again = rows.select("pid", "seq", "symbol").join(asked, "pid")
        found = per_chunk(again, refitted, {"pid": "long", "end": "string", "start": "string"}, "seq")
        found = found.groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("end", "start"))).alias("_more"))  # a few vectors
        then = materialize(chunks.join(found, "pid", "left").withColumn("seen", F.when(F.col("_more").isNull(), F.col("seen")).otherwise(F.map_concat("seen", "_more"))).drop("_more"), "chunks")
        discard(chunks, asked)
        chunks = then
    starts = resolved(chunks.select("pid", F.when(~(F.col("linked") & F.col("whole")), F.col("starts")).alias("start"), "seen"), "start", "seen", 1)
    nexts = starts.select((F.col("pid") - 1).alias("pid"), F.col("start").alias("_next"))
    return chunks.join(nexts, "pid", "left").select("pid", "linked", "begun", "whole", F.when(F.col("linked"), F.col("_next")).otherwise(told(END)).alias("end"))


def traced(chunk: list[tuple]) -> Iterator[tuple]:
    """Rows (pid, seq, edits, more, states) of a chunk (pid, seq, conv_id, symbol, linked, begun, end): the edits of each row
    from each state that its conversation may enter the chunk in, those after a conversation's last row (more), and at the
    chunk's last row the states that it leaves in. Conversations that begin here have one state to enter in."""
    linked, begun, end = chunk[0][4:]
    vectors, now = [END] * len(chunk), read(end) if linked else END
    for k in range(len(chunk) - 1, -1, -1):
        if k + 1 < len(chunk) and chunk[k][2] != chunk[k + 1][2]:
            now = END
        vectors[k] = now = alike(now)
        now = before(now, chunk[k][3])
    states: list[int] = []
    for k, (pid, seq, conv, symbol, *_) in enumerate(chunk):
        if k == 0 or conv != chunk[k - 1][2]:
            states = [0, 1, 2, 3] if k == 0 and begun else [0]
        edits = least_edits(vectors[k], symbol)
        done = [edits[s][0] for s in states]
        states = [edits[s][1] for s in states]
        last = k + 1 == len(chunk)
        over = chunk[k + 1][2] != conv if not last else not linked
        yield pid, seq, done, [last_edits(s) for s in states] if over else None, states if last else None


def edits_of(rows: DataFrame) -> DataFrame:
    """rows (pid, seq, conv_id, symbol and others) with edits (of the row, inserted rows before it included) and more (those
    after a conversation's last row, else null)."""
    borders = materialize(border_vectors(rows), "borders")
    given = rows.select("pid", "seq", "conv_id", "symbol").join(borders.select("pid", "linked", "begun", "end"), "pid")
    kinds = {"pid": "long", "seq": "long", "edits": "array<string>", "more": "array<string>", "states": "array<int>"}
    made = materialize(per_chunk(given, traced, kinds, "seq"), "traced")
    # A chunk of one conversation that began before leaves in a state for each that it may be entered in, others in one.
    left = made.where("states is not null").select("pid", "states")
    open_ = (F.size("states") > 1)
    maps = F.map_from_arrays(F.array(*map(F.lit, range(4))), F.when(open_, F.col("states")).otherwise(F.array(*[F.col("states")[0]] * 4)))
    leaving = resolved(left.select("pid", F.when(~open_, F.col("states")[0]).alias("state"), maps.alias("to")), "state", "to", -1)
    entered = leaving.select((F.col("pid") + 1).alias("pid"), F.col("state").alias("_entered"))
    both = made.join(entered, "pid", "left")
    pick = lambda x: F.when(F.size(x) == 1, F.col(x)[0]).otherwise(F.col(x)[F.col("_entered")])
    return rows.join(both.select("seq", pick("edits").alias("edits"), pick("more").alias("more")), "seq")


def faults(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, digest of the text, copies, blank, truncated), equal ones as one, with duplicate: role
    and text stand earlier in the conversation, by turn (nulls first), role, digest."""
    text = F.rtrim("text", F.lit(SPACES))
    seen = rows.select("conv_id", "turn", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), (text == "").alias("blank"), (~F.right(text, F.lit(1)).isin(".", "!", "?")).alias("truncated"), "copies")
    one = materialize(seen.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated")), "turns")
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = one.groupBy("conv_id", "role", "digest").agg(F.min(at).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    first = first.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "_first")
    both = one.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")), "left")
    return both.withColumn("duplicate", F.coalesce(at > F.col("_first"), F.lit(False))).drop("_c", "_r", "_d", "_first")


ORDER = ("conv_id", "turn", "role", "digest")
TURNS = {"conv_id": "long", "part": "int", "turn": "long", "role": "string", "digest": "binary", "kind": "int", "copies": "long", "fault": "string", "edits": "string", "text": "string"}
OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, rows long, repaired_sha256 string"
LEGAL = ("su", "ua", "au")


class Repair:
    """One conversation, row by row: what is counted of it, its edits and the digest of its repaired text."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.hash, self.state, self.rows, self.audit = conv_id, hashlib.sha256(), 0, 0, []
        self.counts, self.cost, self.illegal, self.initial = {"blank": 0, "duplicate": 0, "truncated": 0}, 0, 0, None
        self.low = self.high = None
        self.turns, self.role = 0, None

    def line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.rows else ''}{role}:{text}".encode())
        self.rows += 1

    def turn(self, turn: int | None, role: str, copies: int, fault: str | None, edits: str) -> None:
        """A row that stands so many times; all but the first are duplicates, or blank."""
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in LEGAL
        self.illegal += copies - 1
        self.initial = initial
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if fault:
            self.counts[fault] += 1
        self.counts["blank" if fault == "blank" else "duplicate"] += copies - 1
        self.edit(edits, role, fault == "truncated")
        self.edit("D" * (copies - 1), role, False)

    def edit(self, edits: str, role: str, truncated: bool) -> None:
        """self.role becomes the role under which the row's text stays, None if it goes."""
        self.audit.append(edits)
        self.cost += edits.count("D") * DELETE + edits.count("I") * INSERT + edits.count("R") * REROLE
        for x in edits if edits.strip("D") else "":
            if x == "I":
                self.state = NEXT[self.state]
                self.line("user" if self.state == 2 else "assistant", "")
            elif x != "D":
                self.cost += TRUNCATED * truncated
                self.state = NEXT[self.state] if x == "R" else KEPT[role[:1]][self.state]
                self.role = role if x == "K" else "user" if self.state == 2 else "assistant"

    def text(self, text: str) -> None:
        if self.role is not None:
            self.line(self.role, text)
            self.role = None

    def told(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.rows, self.hash.hexdigest()


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of TURNS in order, as one row for each conversation; texts go through the digest and are not held."""
    now, out = None, []
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "rows", "repaired_sha256")
    kinds = [pa.string() if x in ("audit", "repaired_sha256") else pa.int64() for x in names]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

    for batch in batches:
        for conv_id, part, turn, role, _, kind, copies, fault, edits, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    out.append(now.told())
                now = Repair(conv_id)
            if part == 1:
                now.edit(edits, "", False)
            elif kind == 0:
                now.role = None
                now.turn(turn, role, copies, fault, edits)
            elif kind == 1:
                now.text(text)
        if len(out) >= 1000:
            yield batch_of(out)
            out = []
    if now is not None:
        out.append(now.told())
    if out:
        yield batch_of(out)


def empty(kind: str) -> Column:
    return F.lit(None).cast(kind)


def repaired(rows: DataFrame, ids: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, rows (of the repaired conversation), repaired_sha256
    of every conversation of rows (conv_id, turn, role, text, copies), and of those of ids (conv_id) that have no rows.

    A conversation's rows stand by turn (nulls first), rows of one turn by role, then digest of the text; copies is how often
    a row stands there in succession. A null role or text is one space; null conv_ids are one conversation. The edits bring
    the roles to one system row or none, then user and assistant in turn. Other columns are ignored.

    The digest of a conversation takes its texts in order: one task streams them, sorted, and holds none but the audit.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), F.col("copies").cast("long").alias("copies"))
    found = materialize(faults(rows), "faults")
    good = found.where("not blank and not duplicate")
    n = good.count()
    parts = max(1, -(-n // chunk_rows), min(spark.sparkContext.defaultParallelism, n // 2048))
    order = [F.col(c).asc_nulls_first() for c in ORDER]
    symbol = F.concat(F.substring("role", 1, 1), F.when(F.col("truncated"), "!").otherwise(""))
    chunks = good.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    chunks = chunks.select("seq", F.shiftright("seq", 33).alias("pid"), *ORDER, "copies", symbol.alias("symbol"), F.when(F.col("truncated"), "truncated").alias("fault"))
    edited = materialize(edits_of(materialize(chunks, "conversation-chunks")), "edits")

    def turns(frame: DataFrame, part: int, kind: int, **given: Column) -> DataFrame:
        has = {"part": F.lit(part), "kind": F.lit(kind), **given}
        return frame.select(*(has.get(c, F.col(c) if c in frame.columns else empty(t)).cast(t).alias(c) for c, t in TURNS.items()))

    bad = F.when(F.col("blank"), "blank").otherwise("duplicate")
    every = [
        turns(edited, 0, 0), turns(found.where("blank or duplicate"), 0, 0, fault=bad, edits=F.lit("D")),
        turns(rows.drop("copies"), 0, 1, digest=F.unhex(F.md5(F.col("text").cast("binary")))),
        turns(edited.where("more is not null").select("conv_id", F.col("more").alias("edits")), 1, 0),
    ]
    if ids is not None:
        every.append(turns(ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), -1, 2))
    whole = every[0]
    for part in every[1:]:
        whole = whole.unionByName(part)
    by = ("conv_id", "part", "turn", "role", "digest", "kind")
    return whole.repartition("conv_id").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in by)).mapInArrow(summed, OUT)
