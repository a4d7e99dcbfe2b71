"""Suffix order of distributed strings: sorted by Spark, with the classes of equal prefixes of every string at every depth.

Distinct strings are sorted by ranges. In sorted order the longest common prefix with the string before tells which prefixes
are new: a string's path lists (depth, rank) so that its prefixes of up to that depth, and over the last one's, are those of
the first string of that rank. Two strings share a prefix of n bytes exactly if their paths have the same rank at depth n.
What a range's first string shares with those before is carried from range to range in tasks: FAN ranges are folded to one
row of the same form, until one task holds all, and the shared paths go down again in the same groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import discard, materialize

Path = list[tuple[int, int]]
#: Strings of a range. Spark samples the ranges' bounds by some hundred strings for each.
PART = 1 << 15
#: Ranges that one task folds.
FAN = 1 << 10
EDGE = "part long, first binary, last binary, depths array<int>, ranks array<long>"


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y))


def upto(path: Path, depth: int) -> Path:
    """The path's part up to a depth."""
    out, last = [], 0
    for d, rank in path:
        if last >= depth:
            break
        out.append((min(d, depth), rank))
        last = d
    return out


def at_depth(depths: np.ndarray, ranks: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Ranks of a path at depths of 1 or more, -1 at depth 0."""
    if not len(depths):
        return np.full(len(depth), -1, np.int64)
    found = ranks[np.minimum(np.searchsorted(depths, depth), len(depths) - 1)]
    return np.where(depth > 0, found, -1)


def path_columns(found: list[Path]) -> list[pa.Array]:
    return [pa.array([[d for d, _ in p] for p in found], pa.list_(pa.int32())), pa.array([[r for _, r in p] for p in found], pa.list_(pa.int64()))]


def paths(rows: Iterator[tuple[int, int, bytes]], begin: dict[int, Path]) -> Iterator[tuple[int, bytes, Path]]:
    """(part, string, path) of sorted rows (part, place in the part, string); begin: what the first string of each part shares
    with those before."""
    before, path = b"", []
    for part, place, s in rows:
        path = list(begin.get(part, ())) if place == 0 else upto(path, common(before, s))
        if not path or path[-1][0] < len(s):
            path.append((len(s), part << 32 | place))
        before = s
        yield part, s, path


def sorted_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, Path]]:
    """paths() of rows (part, s, depths, ranks) sorted by part and string; a row without a string comes first in its part and
    has what the part's first string shares with those before."""
    begin: dict[int, Path] = {}

    def runs() -> Iterator[tuple[int, int, bytes]]:
        now, place = None, 0
        for batch in batches:
            for part, s, depths, ranks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s is None:
                    begin.clear()
                    begin[part] = list(zip(depths, ranks, strict=True))
                    continue
                now, place = part, place + 1 if part == now else 0
                yield part, place, s

    return paths(runs(), begin)


def carried(edges: list[tuple[int, bytes, bytes, Path]], begun: Path = ()) -> dict[int | None, Path]:
    """begin for paths(), of each part's first and last string and the last one's path as if nothing came before; begun is that
    of the first part. Under None: the last part's path."""
    begin, before, path = {}, None, []
    for part, first, last, own in sorted(edges):
        begin[part] = list(begun) if before is None else upto(path, common(before, first))
        kept = upto(begin[part], common(first, last) if first != last else len(first))
        reach = kept[-1][0] if kept else 0
        path, before = kept + [(d, rank) for d, rank in own if d > reach], last
    begin[None] = path
    return begin


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(group, its rows) of rows sorted by group, their first column."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][0] != row[0]:
                yield held[0][0], held
                held = []
            held.append(row)
    if held:
        yield held[0][0], held


def edges_of(rows: list[tuple]) -> list[tuple[int, bytes, bytes, Path]]:
    return [(part, first, last, list(zip(depths, ranks, strict=True))) for _, part, first, last, depths, ranks in rows]


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, part, first, last, depths, ranks) of the ranges of a group as one row of EDGE, with the group as part."""
    for group, rows in groups_of(batches):
        path = carried(edges_of(rows))[None]
        yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([rows[0][2]], pa.binary()), pa.array([rows[-1][3]], pa.binary()), *path_columns([path])], ["part", "first", "last", "depths", "ranks"])


def unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, depths, ranks): what each range's first string shares with those before. Of a group's rows the first, if without
    a part, has that of the group."""
    for _, rows in groups_of(batches):
        given: Path = []
        if rows[0][1] is None:
            given, rows = list(zip(*rows[0][4:], strict=True)), rows[1:]
        begin = carried(edges_of(rows), given)
        parts = [row[1] for row in rows]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), *path_columns([begin[p] for p in parts])], ["part", "depths", "ranks"])


def begun(edges: DataFrame, count: int, name: str) -> DataFrame:
    """(part, depths, ranks): what the first string of each range shares with those before, of EDGE rows."""
    groups = -(-count // FAN)
    rows = edges.select(F.expr(f"part div {FAN}").alias("in"), "part", "first", "last", "depths", "ranks")
    if groups > 1:
        upper = rows.repartition(groups, "in").sortWithinPartitions("in", "part").mapInArrow(folded, EDGE)
        tops = begun(materialize(upper, f"{name}-groups"), groups, name)
        none = F.lit(None)
        rows = rows.union(tops.select("part", none.cast("long"), none.cast("binary"), none.cast("binary"), "depths", "ranks"))
    return rows.repartition(max(1, groups), "in").sortWithinPartitions("in", F.col("part").asc_nulls_first()).mapInArrow(unfolded, "part long, depths array<int>, ranks array<long>")


def suffix_order(strings: DataFrame, name: str) -> DataFrame:
    """digest (md5), depths, ranks of every distinct string of strings (s binary); empty strings have no path."""
    plain = strings.where(F.octet_length("s") > 0).select("s").distinct()
    parts = max(1, -(-strings.count() // PART))
    placed = materialize(plain.repartitionByRange(parts, "s").sortWithinPartitions("s").select(F.spark_partition_id().cast("long").alias("part"), "s"), name)
    none = (F.lit(None).cast("array<int>").alias("depths"), F.lit(None).cast("array<long>").alias("ranks"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for part, s, path in sorted_paths(batches):
            found.setdefault(part, [s, s, path])[1:] = [s, path]
        for part, (first, last, path) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([first], pa.binary()), pa.array([last], pa.binary()), *path_columns([path])], ["part", "first", "last", "depths", "ranks"])

    dealt = lambda rows: rows.repartition(parts, "part").sortWithinPartitions("part", F.col("s").asc_nulls_first())
    edges = materialize(dealt(placed.select("part", "s", *none)).mapInArrow(ends, EDGE), f"{name}-edges")
    # Ranges are numbered by Spark's partitions, of which there may be more than asked for.
    begin = begun(edges, edges.agg(F.max("part") + 1).first()[0] or 1, name)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, Path]] = []

        def flushed() -> pa.RecordBatch:
            rows = [pa.array([s for s, _ in held], pa.binary()), *path_columns([p for _, p in held])]
            held.clear()
            return pa.RecordBatch.from_arrays(rows, ["s", "depths", "ranks"])

        for _, s, path in sorted_paths(batches):
            held.append((s, path))
            if len(held) >= 2048:
                yield flushed()
        if held:
            yield flushed()

    rows = placed.select("part", "s", *none).union(begin.select("part", F.lit(None).cast("binary"), "depths", "ranks"))
    out = dealt(rows).mapInArrow(order, "s binary, depths array<int>, ranks array<long>").select(F.unhex(F.md5("s")).alias("digest"), "depths", "ranks")
    out = materialize(out, f"{name}-order")
    discard(placed, edges)
    return out
