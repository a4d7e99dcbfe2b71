"""MinHash near-duplicate detection with an LSH forest.

Every document's shingle set gets a signature of SLOTS min-hashes. TREES orders of the signature sort the documents; those
that share a prefix of at least MIN_DEPTH hashes in an order form a region. Regions of more than REGION rows are split by
longer prefixes, down to MAX_DEPTH, and what is still larger is dealt into blocks (adaptive depth). A pair that agrees on a
short prefix only may so be parted; all documents of split regions are therefore sorted by MORE further orders, which makes
up for the depth (a pair of similarity 0.8 misses 16 trees of depth 6 in 0.8% of cases). Inside a region the neighbours are screened by two bits of each hash, and links are confirmed on the full sets:

1. each document proposes a common hub of very similar ones, or its most similar neighbour; full sets are joined;
2. for ROUNDS further rounds, each document with neighbours in other components proposes the most similar one not yet tried;
3. then the documents that still have neighbours in other components bring their sets, as 32-bit hashes, to the region;
   every such pair is compared there, and what reaches the threshold is confirmed on the full sets. In dealt regions all
   documents take part, and those outside the largest component meet all blocks. No pair is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import U64, components, materialize, mixed, sieved
from quantloom.llm.shingles import shingle_sets

TREES, MIN_DEPTH, MAX_DEPTH, SLOTS, REGION = 16, 3, 6, 128, 512
ROUNDS = 1
#: Which slots each further tree sorts by: shuffles of all slots, cut into trees.
MORE = np.vstack([np.random.RandomState(k).permutation(SLOTS)[: SLOTS // MAX_DEPTH * MAX_DEPTH].reshape(-1, MAX_DEPTH) for k in (1, 2)])
#: Pairs of Jaccard similarity s agree in s + (1 - s) / 4 of the bit pairs; 4.5 standard deviations below the threshold pass.
SCREEN_DEVIATIONS = 4.5
BITS = ("b0", "b1", "b2", "b3")
#: A row's part in its group: all pairs count; or a block's row, in or outside its region's largest component, or a guest there.
ALONE, INSIDE, OUTSIDE, GUEST = range(4)
_WHAT = mixed(np.arange(1, SLOTS + 1, dtype=U64) * U64(0xD6E8FEB86659FD93))
MULTIPLIERS = (_WHAT >> U64(32)).astype(np.uint32) | np.uint32(1)
ADDENDS = _WHAT.astype(np.uint32)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, signature) of whole texts; set_key and signature are null for empty sets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, sizes, signs = batch.column(0), [], [], []
            for _, s in shingle_sets(batch.column(1), words):
                sizes.append(len(s))
                keys.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                x = (s ^ (s >> U64(32))).astype(np.uint32)
                signs.append(minhash(x).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], ["doc_id", "n_shingles", "set_key", "signature"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, "doc_id long, n_shingles long, set_key binary, signature binary")


def minhash(x: np.ndarray) -> np.ndarray:
    """SLOTS minima of x under multiply-add permutations of the 32-bit values."""
    out = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 512):  # tiles that stay in the cache
        np.minimum(out, (x[lo : lo + 512, None] * MULTIPLIERS + ADDENDS).min(axis=0), out=out)
    return out


def shingle_table(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, shingles) with the full sets as arrays."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, sets = 0, []
            ids = batch.column(0)
            for i, s in shingle_sets(batch.column(1), words):
                sets.append(s.view(np.int64))
                if sum(map(len, sets[-64:])) > 1 << 20 or i == len(ids) - 1:
                    at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([ids[row : i + 1], pa.ListArray.from_arrays(at, np.concatenate(sets))], ["doc_id", "shingles"])
                    row, sets = i + 1, []

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, "doc_id long, shingles array<long>")


def forest_rows(reps: DataFrame, further: bool = False) -> DataFrame:
    """A row for each tree, or further tree: the key of its first MIN_DEPTH hashes, the next ones, and a bit of every hash."""
    trees = MORE if further else np.arange(TREES * MAX_DEPTH).reshape(TREES, MAX_DEPTH)
    number = 1 + TREES * further
    more = [f"d{k}" for k in range(MIN_DEPTH, MAX_DEPTH)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, n = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, SLOTS)
            code = (sig * np.uint32(0x9E3779B1)) >> np.uint32(30)
            bits = np.hstack([np.packbits(((code >> np.uint32(k)) & np.uint32(1)).astype(bool), axis=1).view(np.int64) for k in (0, 1)])
            for t, slots in enumerate(trees, number):
                own = sig[:, slots]
                key = np.full(len(rep), t, U64)
                for k in range(MIN_DEPTH):
                    key = mixed(key * U64(0x9E3779B97F4A7C15) + own[:, k])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), *(own[:, k].copy().view(np.int32) for k in range(MIN_DEPTH, MAX_DEPTH)), np.full(len(rep), t, np.int32), rep, n, *bits.T)], ["region", *more, "tree", "rep", "n", *BITS])

    return reps.select("rep", "n", "signature").mapInArrow(scan, f"region long, {', '.join(f'{d} int' for d in more)}, tree int, rep long, n long, {', '.join(f'{b} long' for b in BITS)}")


def adaptive_regions(rows: DataFrame) -> DataFrame:
    """Regions of more than REGION rows take longer prefixes; those of full depth are dealt into blocks. Only the rows of
    such regions are counted again."""
    done, plain = [], {"parts": F.lit(1), "block": F.lit(0)}
    columns = ("region", "block", "parts", "tree", "rep", "n", *BITS)
    for k in range(MIN_DEPTH, MAX_DEPTH + 1):
        large = materialize(rows.groupBy("region").agg(F.count("*").alias("rows_in")).where(F.col("rows_in") > REGION), "large-regions")
        if large.isEmpty():
            break
        done.append(rows.join(large, "region", "left_anti").withColumns(plain).select(*columns))
        rows = materialize(rows.join(large, "region"), "large-rows")
        if k < MAX_DEPTH:
            rows = rows.withColumn("region", F.xxhash64("region", f"d{k}")).drop("rows_in")
        else:
            parts = F.ceil(F.col("rows_in") / REGION).cast("int")
            plain = {"parts": parts, "block": F.pmod(F.xxhash64("rep", "tree"), parts).cast("int")}
    out = rows.withColumns(plain).select(*columns)
    for part in done:
        out = out.union(part)
    return out


def forest_regions(classes: DataFrame) -> DataFrame:
    """Regions of all trees, and of further trees for the rows of regions that were split."""
    forest = materialize(forest_rows(classes), "forest")
    large = materialize(forest.groupBy("region").agg(F.count("*").alias("rows_in")).where(F.col("rows_in") > REGION).select("region"), "split-regions")
    regions = adaptive_regions(forest)
    if large.isEmpty():
        return regions
    split = materialize(forest.join(large, "region", "left_semi").select("rep").distinct(), "split-rows")
    further = materialize(forest_rows(classes.join(split, "rep", "left_semi"), further=True), "forest")
    return regions.unionByName(adaptive_regions(further))


def region_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of a partition sorted by (region, block), cut where a run ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        region, block = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        change = np.flatnonzero((region[1:] != region[:-1]) | (block[1:] != block[:-1]))
        if held and (held[-1].column(0)[-1].as_py() != region[0] or held[-1].column(1)[-1].as_py() != block[0]):
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            yield pa.Table.from_batches([*held, batch.slice(0, change[-1] + 1)])
            held = [batch.slice(change[-1] + 1)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def least_agreeing(similarity: float, codes: int) -> float:
    """In how many of the SLOTS codes, of so many values, a pair of the threshold's similarity agrees at least."""
    share = similarity + (1 - similarity) / codes
    return SLOTS * share - SCREEN_DEVIATIONS * (SLOTS * share * (1 - share)) ** 0.5


def passing(t: pa.Table, similarity: float, apart: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pairs (i < j) of the same run that pass the screen, and in how many codes they agree; apart: of two components.

    With a column side, pairs in which it is not null are those of a GUEST and another row, once where both are outside.
    """
    region, block, rep, n = (np.asarray(t.column(c)) for c in ("region", "block", "rep", "n"))
    bits = [np.asarray(t.column(c)).view(U64) for c in BITS]
    comp = np.asarray(t.column("comp")) if apart else None
    side = np.asarray(t.column("side")) if "side" in t.column_names else None
    least = least_agreeing(similarity, 4)
    left, off, out = np.arange(len(region)), 0, []
    while True:
        off += 1
        left = left[left + off < len(region)]
        left = left[(region[left] == region[left + off]) & (block[left] == block[left + off])]
        if not len(left):
            break
        i, j = left, left + off
        good = (rep[i] != rep[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]))
        if apart:
            good &= comp[i] != comp[j]
        if side is not None:
            x, y = side[i], side[j]
            first = np.where(x == GUEST, rep[i] < rep[j], rep[j] < rep[i])
            good &= (x == ALONE) | ((x == GUEST) != (y == GUEST)) & ((x == INSIDE) | (y == INSIDE) | first)
        i, j = i[good], j[good]
        lo, hi = ((bits[k][i] ^ bits[k][j]) | (bits[k + 2][i] ^ bits[k + 2][j]) for k in (0, 1))
        agree = SLOTS - np.bitwise_count(lo).astype(np.int32) - np.bitwise_count(hi)
        good = agree >= least
        if good.any():
            out.append((i[good], j[good], agree[good]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def dealt(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("region", "block", *columns).repartition("region", "block").sortWithinPartitions("region", "block", "rep")


ROW = "rep long, n long, " + ", ".join(f"{b} long" for b in BITS)


def propose(rows: DataFrame, similarity: float) -> DataFrame:
    """Rows with a neighbour that passes; best: the most similar one, hub: the smallest of the very similar ones.

    Of dealt regions all rows stay, best and hub are null where no neighbour of the same block passes.
    """
    hub_least = SLOTS * (similarity + 0.1 + (0.9 - similarity) / 4)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in region_runs(batches):
            i, j, agree = passing(t, similarity, apart=False)
            lone = np.setdiff1d(np.flatnonzero(np.asarray(t.column("parts")) > 1), np.concatenate([i, j]))
            if len(lone):
                part = t.take(pa.array(lone))
                for name, kind in (("best", pa.int64()), ("score", pa.int32()), ("hub", pa.int64())):
                    part = part.append_column(name, pa.nulls(len(lone), kind))
                yield from part.combine_chunks().to_batches()
            if not len(i):
                continue
            rep = np.asarray(t.column("rep"))
            i, j, agree = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([agree, agree])
            order = np.lexsort((rep[j], -agree, i))
            own, first = np.unique(i[order], return_index=True)
            best, score = rep[j][order][first], agree[order][first]
            hubs = np.full(t.num_rows, np.iinfo(np.int64).max)
            near = agree >= hub_least
            np.minimum.at(hubs, i[near], rep[j[near]])
            hub = np.where(hubs[own] == np.iinfo(np.int64).max, best, hubs[own])
            part = t.take(pa.array(own)).append_column("best", pa.array(best)).append_column("score", pa.array(score.astype(np.int32))).append_column("hub", pa.array(hub))
            yield from part.combine_chunks().to_batches()

    return dealt(rows, "parts", "tree", "rep", "n", *BITS).mapInArrow(scan, f"region long, block int, parts int, tree int, {ROW}, best long, score int, hub long")


def propose_again(rows: DataFrame, similarity: float) -> DataFrame:
    """(rep, best, score): the most similar passing neighbour in another component that rep has not tried, in each region."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in region_runs(batches):
            i, j, agree = passing(t, similarity, apart=True)
            if not len(i):
                continue
            rep = np.asarray(t.column("rep"))
            i, j, agree = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([agree, agree])
            for k in range(1 + ROUNDS):
                new = rep[j] != np.asarray(t.column(f"t{k}"))[i]
                i, j, agree = i[new], j[new], agree[new]
            order = np.lexsort((rep[j], -agree, i))
            own, first = np.unique(i[order], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rep[own], rep[j][order][first], agree[order][first].astype(np.int32))], ["rep", "best", "score"])

    return dealt(rows, "rep", "n", *BITS, "comp", *(f"t{k}" for k in range(1 + ROUNDS))).mapInArrow(scan, "rep long, best long, score int")


def needy(rows: DataFrame, similarity: float) -> DataFrame:
    """Rows with a passing neighbour in another component that no region of an earlier tree has brought together with them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in region_runs(batches):
            i, j, _ = passing(t, similarity, apart=True)
            if len(i):
                met = first_met(t, i, j)
                i, j = i[met], j[met]
            if len(i):
                yield from t.take(pa.array(np.unique(np.concatenate([i, j])))).combine_chunks().to_batches()

    return dealt(rows, "tree", "rep", "n", *BITS, "comp", "side", "homes").mapInArrow(scan, f"region long, block int, tree int, {ROW}, comp long, side int, homes array<struct<tree: int, region: long>>")


def with_guests(rows: DataFrame) -> DataFrame:
    """rows with side; in dealt regions, besides the blocks alone, groups of a block and a block of the rows outside the
    region's largest component. So each such row meets every other row, and no group exceeds two blocks."""
    alone = rows.withColumn("side", F.lit(ALONE))
    blocks = rows.where("parts > 1")
    if blocks.isEmpty():
        return alone
    largest = blocks.groupBy("region", "comp").count().groupBy("region").agg(F.max_by("comp", "count").alias("largest"), F.sum("count").alias("all"), F.max("count").alias("most"))
    sized = largest.withColumn("chunks", F.ceil((F.col("all") - F.col("most")) / REGION).cast("int")).where("chunks > 0").select("region", "largest", "chunks")
    blocks = materialize(blocks.join(sized, "region"), "dealt")
    outside = blocks.where("comp <> largest").withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(1)), "chunks").cast("int"))
    group = lambda block, chunk: (F.col(block) + F.col("parts") * (F.col(chunk) + 1)).cast("int")
    hosts = blocks.withColumn("side", F.when(F.col("comp") == F.col("largest"), INSIDE).otherwise(OUTSIDE)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("block", group("block", "chunk"))
    guests = outside.withColumn("side", F.lit(GUEST)).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("at <> block").withColumn("block", group("at", "chunk"))
    return alone.unionByName(hosts.select(*alone.columns)).unionByName(guests.select(*alone.columns))


def first_met(t: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which row pairs of the same region share no region of an earlier tree; homes has the (tree, region) of each row."""
    homes = t.column("homes").combine_chunks()
    row = np.repeat(np.arange(t.num_rows), np.asarray(pc.list_value_length(homes)))
    number, region = (np.asarray(homes.flatten().field(k)) for k in ("tree", "region"))
    own = np.zeros((t.num_rows, int(number.max()) + 1), np.int64)
    own[row, number] = region
    tree, columns = np.asarray(t.column("tree")), np.arange(own.shape[1])
    keep = np.ones(len(i), bool)
    for lo in range(0, len(i), 1 << 14):
        a, b = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
        keep[lo : lo + (1 << 14)] = ~((own[a] == own[b]) & (own[a] != 0) & (columns < tree[a, None])).any(axis=1)
    return keep


def compare_apart(rows: DataFrame, docs: DataFrame, words: int, similarity: float, percent: int) -> DataFrame:
    """(rep, other): pairs of different components whose 32-bit sets reach the threshold.

    Such sets share at least what the full sets share. A pair that shares regions of several trees is compared in the first
    of them only. Pairs far enough above the threshold that collisions cannot have made them join their components there,
    and further pairs between the two are left out.
    """
    sets = shingle_table(chosen(docs, rows.select(F.col("rep").alias("doc_id"))), words)
    sets = sets.select(F.col("doc_id").alias("rep"), F.transform("shingles", lambda x: F.shiftright(x, 32).cast("int")).alias("low"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in region_runs(batches):
            i, j, agree = passing(t, similarity, apart=True)
            if not len(i):
                continue
            met = first_met(t, i, j)
            i, j, agree = i[met], j[met], agree[met]
            rep, comp, n = (np.asarray(t.column(c)) for c in ("rep", "comp", "n"))
            own = [np.unique(np.asarray(x.values)) for c in t.column("low").chunks for x in c]
            parent: dict[int, int] = {}

            def root(c: int, parent: dict[int, int] = parent) -> int:
                while parent.get(c, c) != c:
                    c = parent[c]
                return c

            links = []
            for k in np.argsort(-agree, kind="stable").tolist():
                x, y = int(i[k]), int(j[k])
                p, q = root(int(comp[x])), root(int(comp[y]))
                if p == q:
                    continue
                need = -(-percent * int(n[x] + n[y]) // (100 + percent))
                extra = len(np.intersect1d(own[x], own[y], assume_unique=True)) - need + int(n[x] - len(own[x]) + n[y] - len(own[y]))
                if extra >= 0:
                    links.append((int(rep[x]), int(rep[y])))
                    if extra >= 8 + n[x] * n[y] // (1 << 28):
                        parent[max(p, q)] = min(p, q)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["rep", "other"])

    full = dealt(rows.join(sets, "rep"), "tree", "rep", "n", *BITS, "comp", "side", "homes", "low")
    return full.mapInArrow(scan, "rep long, other long").distinct()


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("rep", "other").alias("a"), F.least("rep", "other").alias("b")).where("a <> b").distinct()


def chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of some documents; only they are moved."""
    ids = ids.distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return sieved(rows, ids, "doc_id").join(ids, "doc_id", "left_semi")


def confirm(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): those of the pairs (rep, other) whose full sets have 100 * intersection >= percent * union."""
    pairs = materialize(ordered(pairs), "pairs")
    sets = lambda c, name: shingle_table(chosen(docs, pairs.select(F.col(c).alias("doc_id"))), words).toDF(c, name)
    both = pairs.join(sets("a", "x"), "a").join(sets("b", "y"), "b")
    same = F.size(F.array_intersect("x", "y"))
    return materialize(both.where(100 * same >= percent * (F.size("x") + F.size("y") - same)).select("a", "b"), "links")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Documents are linked where 100 * intersection >= percent * union of their sets of distinct shingles of so many words;
    component_id is the smallest doc_id reachable, kept marks the document that bears it. Texts with fewer words have one
    shingle; null, empty and blank texts have none and are linked with nothing. Rows of equal sets are one node of the
    graph, however many. A null doc_id is linked with nothing and kept, its component_id is null. Extra columns are ignored.
    """
    similarity = percent / 100
    sig = materialize(signatures(docs, words), "signatures")
    some = sig.where("set_key is not null and doc_id is not null")
    classes = some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    classes = materialize(classes, "classes")
    rows = materialize(propose(forest_regions(classes), similarity), "neighbours")
    first = rows.where("best is not null").groupBy("rep").agg(F.max_by("best", F.struct("score", -F.col("best"))).alias("best"), F.min("hub").alias("hub"))
    tried = materialize(first.select("rep", F.when(F.col("hub") < F.col("rep"), F.col("hub")).otherwise(F.col("best")).alias("other"), F.lit(0).alias("round")), "tried")
    links = confirm(tried, docs, words, percent)
    own = rows.drop("best", "score", "hub")

    def labelled(links: DataFrame, homes: DataFrame | None = None) -> DataFrame:
        found = components(links).withColumnRenamed("node", "rep").withColumnRenamed("component", "comp")
        if homes is not None:
            found = homes.join(found, "rep", "left")
        return own.join(found, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))

    for number in range(1, ROUNDS + 1):
        before = tried.groupBy("rep").agg(F.sort_array(F.collect_list("other")).alias("t"))
        marked = labelled(links).join(before, "rep", "left").select("*", *(F.coalesce(F.get("t", F.lit(k)), F.col("rep")).alias(f"t{k}") for k in range(1 + ROUNDS)))
        again = propose_again(marked, similarity).groupBy("rep").agg(F.max_by("best", F.struct("score", -F.col("best"))).alias("other")).withColumn("round", F.lit(number))
        again = materialize(again, "tried")
        if again.isEmpty():
            break
        links = links.union(confirm(again, docs, words, percent))
        tried = tried.union(again)
    homes = materialize(own.groupBy("rep").agg(F.collect_set(F.struct("tree", "region")).alias("homes")), "homes")  # one for each tree
    rest = materialize(needy(with_guests(labelled(links, homes)), similarity), "apart")
    if not rest.isEmpty():
        close = materialize(compare_apart(rest, docs, words, similarity, percent), "close")
        links = links.union(confirm(close.join(tried.select("rep", "other"), ["rep", "other"], "left_anti"), docs, words, percent))
    found = components(links)
    member = some.select("doc_id", "n_shingles", "set_key").join(classes.select("set_key", "rep"), "set_key").join(found, F.col("rep") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    lone = sig.where("set_key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return member.union(lone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near copies stays (five-word shingles, similarity 0.8); repeated rows of
    its doc_id stay with it."""
    kept = near_duplicates(docs).where("kept").select("doc_id")
    return docs.join(kept.distinct(), "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
