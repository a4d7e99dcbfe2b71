"""Document fingerprints as invertible Bloom lookup sketches, with DataFrame and SQL functions alone.

A text's units are its paragraphs, long ones cut every UNIT code points from their beginning. The distinct unit digests are
dealt by their high bits into blocks of about KEYS; a block has three tables of WIDTH cells (count, key sum, check sum by
exclusive or). Two blocks that share a longer prefix add up to the block of the shorter one, so a sketch folds to any smaller
power of two. Sketches of two versions fold to the smaller one's size and subtract cell by cell; peeling cells that hold one
digest recovers the digests that differ, on either side. What does not peel is retried larger: its blocks first at the size of
the larger sketch, then halved with another hash, up to RETRIES times; blocks that still fail are compared by their digests
themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT, KEYS, WIDTH, RETRIES, ROUNDS = 256, 32, 16, 4, 24
CELLS = 3 * WIDTH
KEY_SPACE = 1 << 62


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates value once and uses it as name in body."""
    return f"transform(array({value}), {name} -> {body})[0]"


def keys_sql(text: str, unit: int = UNIT, head: int = 0, short: int = 0) -> str:
    """Sorted distinct 62-bit digests of a text's units of at most so many code points; its first head code points, if told, are
    cut into units of a quarter of head, so that short texts have several. Texts of fewer code points than short have units of an
    eighth of short besides."""
    cut = lambda x, n: f"regexp_extract_all({x}, '[^\\\\n]{{1,{n}}}', 0)"
    units = f"concat({cut(f'substring({text}, 1, {head})', head // 4)}, {cut(f'substring({text}, {head + 1})', unit)})" if head else cut(text, unit)
    if short:
        units = f"concat({units}, if(length({text}) < {short}, {cut(text, short // 8)}, cast(array() as array<string>)))"
    return f"sort_array(array_distinct(transform({units}, u -> xxhash64(u) & {KEY_SPACE - 1}L)))"


def blocks_sql(n: str) -> str:
    """The power of two of blocks that n keys are dealt into."""
    return f"shiftleft(1L, cast(greatest(0, ceil(log2(({n}) / {KEYS}.0))) as int))"


def below_sql(keys: str, bound: str) -> str:
    """How many of the sorted keys lie under the bound, by binary search."""
    step = f"if(s.lo < s.hi, if({keys}[cast((s.lo + s.hi) div 2 as int)] < {bound}, named_struct('lo', (s.lo + s.hi) div 2 + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', (s.lo + s.hi) div 2)), s)"
    return f"aggregate(sequence(1, cast(ceil(log2(size({keys}) + 1)) as int) + 1), named_struct('lo', 0L, 'hi', cast(size({keys}) as bigint)), (s, i) -> {step}, s -> s.lo)"


def mask_sql(key: str, digest: str, seed: int = 0) -> str:
    """The bits of a key's three cells among the CELLS of its block: of the key itself, or of other bits of its digest."""
    step = int(math.log2(WIDTH))
    source, skip = (key, 0) if seed == 0 else (digest, 3 * step * (seed - 1))
    return " | ".join(f"shiftleft(1L, {WIDTH * j} + int(shiftright({source}, {skip + step * j}) & {WIDTH - 1}))" for j in range(3))


BITS = f"array({', '.join(f'{1 << c}L' for c in range(CELLS))})"


def cells_sql(part: str, seed: int = 0) -> str:
    """The cells of one block with these keys."""
    add = lambda x: f"aggregate(hit, 0L, (a, x) -> a ^ x.{x})"
    hit = let("filter(own, x -> (x.m & bit) <> 0)", "hit", f"named_struct('n', size(hit), 'k', {add('k')}, 'h', {add('h')})")
    digests = f"transform({part}, x -> named_struct('k', x, 'h', xxhash64(x)))"
    items = f"transform({digests}, x -> named_struct('k', x.k, 'h', x.h, 'm', {mask_sql('x.k', 'x.h', seed)}))"
    return let(items, "own", f"transform({BITS}, bit -> {hit})")


def block_sql(keys: str, block: str, blocks: str) -> str:
    """The keys of one of so many blocks."""
    width = f"({KEY_SPACE}L div {blocks})"
    bounds = f"array({below_sql(keys, f'({block} * {width})')}, {below_sql(keys, f'(({block} + 1) * {width})')})"
    return let(bounds, "ends", f"slice({keys}, cast(ends[0] as int) + 1, cast(ends[1] - ends[0] as int))")


def sketch_sql(keys: str, blocks: str) -> str:
    """All cells of so many blocks, one block after the other."""
    return f"flatten(transform(sequence(0L, {blocks} - 1), b -> {cells_sql(block_sql(keys, 'b', blocks))}))"


def peel_sql(cells: str, seed: int = 0) -> str:
    """(ok, p, q) of one block's difference: whether it peeled, and the digests that only the first and second have."""
    pure = f"array_distinct(transform(filter(s.d, c -> abs(c.n) = 1 and c.h = xxhash64(c.k)), c -> named_struct('k', c.k, 'h', c.h, 'n', c.n, 'm', {mask_sql('c.k', 'c.h', seed)})))"
    add = lambda x: f"aggregate(hit, c.{x}, (a, x) -> a ^ x.{x})"
    take = f"if(size(hit) = 0, c, named_struct('n', aggregate(hit, c.n, (a, x) -> a - x.n), 'k', {add('k')}, 'h', {add('h')}))"
    after = f"zip_with(s.d, {BITS}, (c, bit) -> {let('filter(pure, x -> (x.m & bit) <> 0)', 'hit', take)})"
    found = lambda n: f"transform(filter(pure, x -> x.n = {n}), x -> x.k)"
    step = let(pure, "pure", f"if(size(pure) = 0, named_struct('d', s.d, 'p', s.p, 'q', s.q, 'go', false), named_struct('d', {after}, 'p', concat(s.p, {found(1)}), 'q', concat(s.q, {found(-1)}), 'go', true))")
    done = "s -> named_struct('ok', forall(s.d, c -> c.n = 0 and c.k = 0 and c.h = 0), 'p', s.p, 'q', s.q)"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('d', {cells}, 'p', {NONE}, 'q', {NONE}, 'go', true), (s, r) -> if(s.go, {step}, s), {done})"


NONE = "cast(array() as array<bigint>)"
LESS = "(x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'h', x.h ^ y.h)"


def tally_sql(blocks: str, begin: str, peeled: str) -> str:
    """(p, q, failed) over blocks b: the digests found to differ on top of those of begin, and the blocks that did not peel."""
    step = let(peeled, "z", "if(z.ok, named_struct('p', if(size(z.p) = 0, t.p, concat(t.p, z.p)), 'q', if(size(z.q) = 0, t.q, concat(t.q, z.q)), 'failed', t.failed), named_struct('p', t.p, 'q', t.q, 'failed', concat(t.failed, array(b))))")
    return f"aggregate({blocks}, named_struct('p', {begin}.p, 'q', {begin}.q, 'failed', {NONE}), (t, b) -> {step})"


def folded_sql(cells: str, blocks: str, fewer: str) -> str:
    """A sketch at the size of fewer blocks: cells of the blocks that become one add up."""
    ratio = f"({blocks} div {fewer})"
    at = f"{cells}[cast((i * {ratio} + s) * {CELLS} + c as int)]"
    total = f"aggregate(sequence(0L, {ratio} - 1), named_struct('n', 0, 'k', 0L, 'h', 0L), (a, s) -> named_struct('n', a.n + {at}.n, 'k', a.k ^ {at}.k, 'h', a.h ^ {at}.h))"
    return f"if({blocks} = {fewer}, {cells}, flatten(transform(sequence(0L, {fewer} - 1), i -> transform(sequence(0, {CELLS - 1}), c -> {total}))))"


def difference_sql(one: str, other: str, blocks: str) -> str:
    """(p, q, failed) of two sketches of so many blocks."""
    cut = lambda x: f"slice({x}, cast(b as int) * {CELLS} + 1, {CELLS})"
    return tally_sql(f"sequence(0L, {blocks} - 1)", f"named_struct('p', {NONE}, 'q', {NONE})", peel_sql(f"zip_with({cut(one)}, {cut(other)}, {LESS})"))


def retried_sql(first: str, second: str, blocks: str, seed: int) -> str:
    """_z with its failed blocks halved, into numbers out of so many blocks, and sketched anew by another hash."""
    anew = [cells_sql(block_sql(x, "b", blocks), seed) for x in (first, second)]
    halves = "flatten(transform(_z.failed, f -> array(2 * f, 2 * f + 1)))"
    return f"if(size(_z.failed) = 0, _z, {tally_sql(halves, '_z', peel_sql(f'zip_with({anew[0]}, {anew[1]}, {LESS})', seed))})"


def once(rows: DataFrame, **values: str) -> DataFrame:
    """rows with columns of SQL values, computed once: the optimizer may not copy them to where they are read."""
    kept = [c for c in rows.columns if c not in values]
    held = F.explode(F.array(F.struct(*(F.expr(v).alias(c) for c, v in values.items())))).alias("_once")
    return rows.select("*", held).select(*kept, "_once.*")


def with_likeness(rows: DataFrame, one: str, other: str, name: str) -> DataFrame:
    """rows with the Jaccard similarity of two texts' unit sets; a text has the columns <text>_keys, _blocks and _cells.

    <name>_lost and <name>_gained have the digests that only the first and second text has, <name>_direct counts the blocks
    that were compared by their digests.
    """
    first, second = f"{one}_keys", f"{other}_keys"
    rows = rows.withColumns({"_b": F.least(f"{one}_blocks", f"{other}_blocks"), "_m": F.greatest(f"{one}_blocks", f"{other}_blocks")})
    rows = once(rows, **{c: folded_sql(f"{x}_cells", f"{x}_blocks", "_b") for x, c in ((one, "_x"), (other, "_y"))})
    rows = once(rows, _z=difference_sql("_x", "_y", "_b")).drop("_x", "_y")
    own = [f"if({x}_blocks = _m, slice({x}_cells, cast(b as int) * {CELLS} + 1, {CELLS}), {cells_sql(block_sql(f'{x}_keys', 'b', '_m'))})" for x in (one, other)]
    larger = "flatten(transform(_z.failed, f -> sequence(f * (_m div _b), (f + 1) * (_m div _b) - 1)))"
    rows = once(rows, _z=f"if(size(_z.failed) = 0 or _m = _b, _z, {tally_sql(larger, '_z', peel_sql(f'zip_with({own[0]}, {own[1]}, {LESS})'))})")
    for seed in range(1, RETRIES + 1):
        rows = once(rows, _z=retried_sql(first, second, f"(_m * {1 << seed}L)", seed))
    x, y = (block_sql(k, "b", f"(_m * {1 << RETRIES}L)") for k in (first, second))
    missed = let(f"named_struct('x', {x}, 'y', {y})", "s", "named_struct('ok', true, 'p', array_except(s.x, s.y), 'q', array_except(s.y, s.x))")
    rows = rows.withColumn(f"{name}_direct", F.expr("size(_z.failed)"))
    rows = once(rows, _z=f"if(size(_z.failed) = 0, _z, {tally_sql('_z.failed', '_z', missed)})")
    total, differ = f"(size({first}) + size({second}))", "(size(_z.p) + size(_z.q))"
    likeness = F.expr(f"if({total} = 0, 1.0D, cast({total} - {differ} as double) / ({total} + {differ}))")
    return rows.withColumns({name: likeness, f"{name}_lost": F.expr("_z.p"), f"{name}_gained": F.expr("_z.q")}).drop("_b", "_m", "_z")


def written(cells: str) -> Column:
    """A sketch as text."""
    return F.expr(f"base64(unhex(array_join(transform({cells}, c -> concat(lpad(hex(c.n), 4, '0'), lpad(hex(c.k), 16, '0'), lpad(hex(c.h), 16, '0'))), '')))")


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with next, the text of the next row in descending doc_id; after the last comes the first.

    Rows are dealt once into ranges of doc_id with a copy of the first row of the range that follows. Null ids come last,
    rows of equal ids are ordered by text. Only the ranges' bounds come to the driver.
    """
    spark = docs.sparkSession
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = docs.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 100 * ranges)).first()[0] or []
    bounds = sorted(set(bounds))
    literal = F.array(*map(F.lit, bounds)).cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    part = F.expr(below_sql("bounds", "(doc_id + 1)"))
    own = docs.withColumn("bounds", literal).withColumn("part", F.coalesce(part, F.lit(0).cast("long"))).drop("bounds")
    tops = sorted(((r["part"], r["top"]) for r in own.select("doc_id", "part").groupBy("part").agg(F.max("doc_id").alias("top")).collect()), reverse=True)
    follow = [(tops[(k + 1) % len(tops)][1], tops[k][0]) for k in range(len(tops))]
    follow = spark.createDataFrame(follow, "top long, before long")  # a row for each range
    copied = own.join(F.broadcast(follow), F.col("doc_id").eqNullSafe(F.col("top")), "left")
    copied = copied.select("doc_id", "text", F.explode(F.array(F.struct("part", F.lit(0).alias("copy")), F.struct(F.col("before").alias("part"), F.lit(1).alias("copy")))).alias("p"))
    copied = copied.select("doc_id", "text", "p.*").where("part is not null")
    order = Window.partitionBy("part").orderBy("copy", F.col("doc_id").desc_nulls_last(), "text")
    return copied.withColumn("next", F.lead("text").over(order)).where("copy = 0").drop("part", "copy")


def compared(docs: DataFrame, unit: int = UNIT, head: int = 0, short: int = 0) -> DataFrame:
    """fingerprints() with what the sketches' differences hold: near_edited_lost and near_edited_gained, the digests of units
    that only the text and only the edited text has, and near_next_lost and near_next_gained likewise; near_edited_direct and
    near_next_direct count the blocks of a row that sketches could not decide."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(rows).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, int(n_chars - n_chars div 2)), substring(next, 1, int(n_chars div 2)))"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "text", "edited", "next")
    rows = once(rows, **{f"{x}_keys": keys_sql(x, unit, head, short) for x in ("text", "edited", "next")}).drop("text", "edited", "next")
    rows = rows.select("*", *(F.expr(blocks_sql(f"size({x}_keys)")).alias(f"{x}_blocks") for x in ("text", "edited", "next")))
    rows = once(rows, **{f"{x}_cells": sketch_sql(f"{x}_keys", f"{x}_blocks") for x in ("text", "edited", "next")})
    rows = with_likeness(with_likeness(rows, "text", "edited", "near_edited"), "text", "next", "near_next")
    return rows.select("doc_id", "n_chars", "edited_sha256", written("text_cells").alias("fingerprint"), written("edited_cells").alias("edited_fingerprint"), "near_edited", "near_next", *(f"near_{x}_{y}" for x in ("edited", "next") for y in ("lost", "gained", "direct")))


def fingerprints(docs: DataFrame, unit: int = UNIT, head: int = 0, short: int = 0) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs (doc_id, text).

    edited is the text with its last floor(n_chars / 2) code points replaced by as many of the next row's (or all), in
    descending doc_id. Null texts are empty; texts without units have equal fingerprints, and likeness 1 to each other.
    Repeated units of a text count once. near_edited and near_next are the likeness to the edited and to the next text.
    """
    return compared(docs, unit, head, short).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
