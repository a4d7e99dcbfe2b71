"""Mixing sources to target weights with balanced (cube-method) sampling of the fractional copies."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import SPACE, fresh_path, materialize

WEIGHTS, MOST, CHUNK, LANDING = (5, 2, 1), 3, 2048, 12


def word_count(text: str = "text"):
    """Number of words [^\\x20\\x09-\\x0D]+; 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), SPACE), "")).cast("long")


def ranked(df: DataFrame, *order) -> DataFrame:
    """df with rank, from 0, in the given order: range partitions are numbered by their own counts."""
    path = fresh_path(df.sparkSession, "ranked")
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = df.sparkSession.read.parquet(path)
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets += [F.lit(p), F.lit(total)]
        total += n
    if not offsets:
        return placed.withColumn("rank", F.lit(0).cast("long")).drop("_at")
    base = F.create_map(*offsets)[F.shiftright("_at", 33)]
    return placed.withColumn("rank", (base + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_at")


def source_targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target of (source, size) rows.

    Sources by code point, null last, have the weights 5, 2, 1, repeating. They share the total of all sizes; a target
    stops at MOST times its source's size and the excess goes to the others by weight until none is above.
    """
    per = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    order = ranked(per, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    order = order.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * MOST).alias("most"))
    share, capped = 0.0, -1
    total = order.agg(F.sum("source_size")).first()[0] or 0
    while True:  # a round for each time that further sources reach their limit; only sums come to the driver
        above = F.col("weight") * F.lit(share) > F.col("most") if capped >= 0 else F.lit(False)
        n, held, weights = order.agg(F.count_if(above), F.sum(F.when(above, F.col("most")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        if n == capped or not weights:
            break
        capped, share = n, (total - held) / weights
    return order.select("source", "source_size", F.least(F.col("most").cast("double"), F.col("weight") * F.lit(share)).alias("target"))


def flight(sizes: list[float], chances: list[float], rand: random.Random, land: bool) -> list[float]:
    """Cube method with two balancing totals, the sizes and the number of units.

    Three open units at a time move along the null space of the two totals until one is 0 or 1; what cannot move stays
    open. land: LANDING units spread over the sizes wait for the end; with what the others left open they are the landing
    problem, whose outcome is the one that misses the totals least.
    """
    p = list(chances)
    held: list[int] = []

    def step(ids: list[int], u: list[float]) -> list[int]:
        up = min(((1 - p[i]) / d if d > 0 else -p[i] / d) for i, d in zip(ids, u, strict=True) if d)
        down = min((p[i] / d if d > 0 else -(1 - p[i]) / d) for i, d in zip(ids, u, strict=True) if d)
        move = up if rand.random() * (up + down) < down else -down
        left = []
        for i, d in zip(ids, u, strict=True):
            p[i] += move * d
            if p[i] < 1e-9:
                p[i] = 0.0
            elif p[i] > 1 - 1e-9:
                p[i] = 1.0
            else:
                left.append(i)
        return left

    open_ = sorted((i for i in range(len(p)) if 0 < p[i] < 1), key=lambda i: -sizes[i])
    wait = open_[:: max(1, len(open_) // LANDING)][-LANDING:] if land else []
    for i in sorted(set(open_) - set(wait)):
        held.append(i)
        if len(held) == 3:
            a, b, c = (sizes[k] for k in held)
            u = [b - c, c - a, a - b]
            held = step(held, u if any(u) else [1.0, -1.0, 0.0])
    if land:
        held += wait
        size, chance = np.array([sizes[i] for i in held]), np.array([p[i] for i in held])
        ends = np.arange(1 << len(held))[:, None] >> np.arange(len(held)) & 1
        missed = np.abs((ends - chance) @ size) + 0.01 * size.mean() * np.abs((ends - chance).sum(axis=1)) if held else []
        for i, v in zip(held, ends[np.argmin(missed)] if held else [], strict=True):
            p[i] = float(v)
    return p


def settler(seed: str, land: bool):
    """The flight over one chunk of units, for applyInPandas."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id"], ascending=False, kind="stable")
        rand = random.Random(f"{seed}|{key[0]}|{key[1]}")
        return rows.assign(p=flight((rows["size"] * rows["rows"]).astype(float).tolist(), rows["p"].tolist(), rand, land)).drop(columns="chunk")

    return run


def mixture(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs (doc_id, text, source).

    size counts words (null text: 0). Every document is taken floor(target / source size) times and once more with the
    fractional rest as its chance; those chances are settled by the cube method in chunks of CHUNK units, and what a chunk
    leaves open (two units at most) goes to the next round until one chunk a source lands. Rows equal in doc_id, source
    and size are one unit and get equal copies. Sources without words have target 0 and copies 0; null is a source.
    The draw depends on the seed and the rows alone.
    """
    sized = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count().alias("size"))
    sized = materialize(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "sized")
    share = materialize(source_targets(sized.select("source", (F.col("size") * F.col("rows")).alias("size"))), "targets")
    share = share.withColumnRenamed("source", "of")
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    units = sized.join(share, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("whole", F.floor(ratio + F.lit(1e-12)).cast("long"))
    units = units.withColumn("p", F.greatest(F.lit(0.0), ratio - F.col("whole")))
    units = materialize(units.withColumn("p", F.when(F.col("p") < 1e-9, 0.0).otherwise(F.col("p"))), "units")
    schema = ", ".join(f"{n} {t}" for n, t in units.dtypes)
    done, open_, number = [units.where("p = 0")], units.where("p > 0"), 0
    while True:
        chunks = open_.groupBy("source").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")).withColumnRenamed("source", "of")
        chunks = materialize(chunks, "chunks")
        most = chunks.agg(F.max("chunks")).first()[0] or 0
        if not most:
            break
        land = most == 1

        dealt = open_.join(chunks, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "source", "size", F.lit(number)), F.col("chunks"))).drop("chunks")
        moved = materialize(dealt.groupBy("source", "chunk").applyInPandas(settler(f"{seed}|{number}", land), schema), "moved")
        done.append(moved.where("p in (0, 1)"))
        open_, number = moved.where("p not in (0, 1)"), number + 1
        if land:
            break
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    out = out.withColumn("copies", F.col("whole") + F.col("p").cast("long")).withColumn("taken", F.col("size") * F.col("copies"))
    out = out.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it."""
    plan = mixture(docs).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "copies").distinct()
    plan = materialize(plan.where("copies > 0"), "copies")
    own = F.struct(*docs.columns).alias("_row")  # no column of docs can clash with the plan's
    sized = docs.select(own, F.col("doc_id").cast("long").alias("_d"), F.col("source").cast("string").alias("_s"), word_count().alias("_n"))
    on = F.col("_d").eqNullSafe(F.col("_id")) & F.col("_s").eqNullSafe(F.col("_source")) & (F.col("_n") == F.col("_size"))
    both = sized.join(plan, on).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return both.select(*(F.col("_row")[c].alias(c) for c in docs.columns))
