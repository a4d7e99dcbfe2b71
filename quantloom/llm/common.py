"""Helpers shared by the training-data operators: shared-folder tables, byte-level text arrays, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
BLOCK_BYTES = 1 << 19
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark from any store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session (all in one
    JVM) gets one of its own; on a cluster it raises, as executors would write where nobody reads."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: What this driver has written to the shared folder, in order.
_WRITTEN: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    _WRITTEN.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}")
    return _WRITTEN[-1]


def tidied(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """materialize() of what make returns; all that making it wrote to the shared folder is deleted then."""
    start = len(_WRITTEN)
    out = materialize(make(), name)
    for path in _WRITTEN[start:-1]:
        remove(spark, path)
    del _WRITTEN[start:]
    return out


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete tables made by materialize() that nothing reads any more."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, path)


FILTER_BITS = 1 << 23


def sieved(rows: DataFrame, keys: DataFrame, column: str, inside: bool = True, bits: int = FILTER_BITS) -> DataFrame:
    """Those rows that may have a key of keys (column), or with inside=False those that surely have none.

    keys become a bit map of so many bits, whatever their number, so that a join with few keys need not move all rows.
    Null keys are never inside.
    """
    bit = F.pmod(F.xxhash64(column), F.lit(bits))
    maps = keys.where(F.col(column).isNotNull()).select(bit.alias("_b")).groupBy(F.bitmap_bucket_number("_b").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_b")).alias("_map"))
    maps = F.broadcast(materialize(maps.coalesce(1), "bit-map"))  # at most bits / 8 bytes
    found = rows.withColumn("_b", bit).join(maps, F.bitmap_bucket_number("_b") == F.col("_bucket"), "left")
    at = F.bitmap_bit_position("_b")
    byte = F.conv(F.hex(F.expr("substring(_map, cast(bitmap_bit_position(_b) div 8 + 1 as int), 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)) & F.col(column).isNotNull()
    return found.where(hit if inside else ~hit).select(*rows.columns)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Arrays are worked on in tiles that stay in the cache.
PRIME, TILE = (1 << 31) - 1, 1 << 13


def residues(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, of 64-bit values under 2**63."""
    for _ in range(2):
        y = x >> U64(31)
        x = x & U64(PRIME)
        x += y
    np.subtract(x, U64(PRIME), out=x, where=x >= U64(PRIME))
    return x


class Powers:
    """Powers of a base and of its inverse modulo PRIME, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, PRIME)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            size = len(self.up)
            self.up, self.down = (np.concatenate([x, residues(x * U64(pow(b, size, PRIME)))]) for x, b in ((self.up, self.base), (self.down, self.inverse)))
        return self.up[:n], self.down[:n]


class RollingHash:
    """Prefix sums that give a 62-bit hash of any byte range in O(1): two polynomials modulo a prime at independent points.

    A prime modulus, because modulo 2**64 words such as Thue's and its complement share their hash at every odd point.
    """

    def __init__(self, seed: int):
        at = np.arange(1, 515, dtype=U64)
        drawn = mixed(at * U64(0x9E3779B97F4A7C15) + U64(seed)) % U64(PRIME - 3) + U64(2)
        self.values, self.powers = drawn[:512].reshape(2, 256), [Powers(int(x)) for x in drawn[512:]]

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Sums of the terms before each place, not reduced."""
        out = np.zeros((2, len(data) + 1), U64)
        for row, values, powers in zip(out, self.values, self.powers, strict=True):
            up, _ = powers.upto(len(data) + 1)
            for lo in range(0, len(data), TILE):
                hi = min(lo + TILE, len(data))
                x = values[data[lo:hi]]
                x *= up[lo:hi]
                y = x >> U64(31)
                x &= U64(PRIME)
                x += y
                x[0] += row[lo]
                np.cumsum(x, out=row[lo + 1 : hi + 1])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._hashed(prefix, len(start), lambda row, lo, hi: row[end[lo:hi]] - row[start[lo:hi]], lambda down, lo, hi: down[start[lo:hi]])

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """Hash of every range of so many bytes."""
        return self._hashed(prefix, max(0, prefix.shape[1] - width), lambda row, lo, hi: row[lo + width : hi + width] - row[lo:hi], lambda down, lo, hi: down[lo:hi])

    def _hashed(self, prefix, n, terms, scale) -> np.ndarray:
        out = np.empty(n, U64)
        tables = [powers.upto(prefix.shape[1])[1] for powers in self.powers]
        for lo in range(0, n, TILE):
            hi = min(lo + TILE, n)
            high, low = (residues(residues(terms(row, lo, hi)) * scale(down, lo, hi)) for row, down in zip(prefix, tables, strict=True))
            high <<= U64(31)
            high |= low
            out[lo:hi] = mixed(high)
        return out


HASH_A = RollingHash(0x5851F42D4C957F2D)
HASH_B = RollingHash(0x14057B7EF767814F)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and where each row begins (nulls are empty)."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def byte_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) for runs of rows of about limit bytes; a longer row stands alone."""
    raw, at = text_bytes(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def binary_column(matrix: np.ndarray) -> pa.Array:
    """Rows of a 2-d array as a binary column."""
    width = matrix.shape[1] * matrix.itemsize
    data = np.ascontiguousarray(matrix)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(data), [None, pa.py_buffer(data)]).cast(pa.binary())


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) as stars (node, its smallest node), inside each partition: same components, fewer edges, no shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.get(top, top)) != top:
                top = up
            while x != top:  # the path now ends at its top
                parent[x], x = top, parent.get(x, x)
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = [x for x in parent if root(x) != x]
        for lo in range(0, len(nodes), 1 << 16):
            part = nodes[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(list(map(root, part)), pa.int64())], ["a", "b"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(scan, "a long, b long")


#: A task contracts about so many edges by itself.
LOCAL_EDGES = 1 << 20


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of an edge table (a, b): the smallest node reachable.

    Partitions of about LOCAL_EDGES edges first become stars by themselves; what one partition held is then done. The rest
    alternates large and small stars: each round joins no more than one row per edge and writes its table to the shared
    folder; a hub's edges are spread by the skew join. Empty edges give an empty table. Self-loops and repeated edges are
    harmless.
    """
    given = materialize(edges.where("a <> b"), name)
    parts = max(1, -(-given.count() // LOCAL_EDGES))
    now = materialize(forest(given.coalesce(parts)), name)
    discard(given)
    while parts > 1:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        top = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(top, F.col("a") == F.col("k")).select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        then = materialize(small.select(F.greatest("e.a", "e.b").alias("a"), F.least("e.a", "e.b").alias("b")).where("a <> b").distinct(), name)
        # Done when the edges are stars: no node is both a leaf and a centre, and each leaf has one centre.
        ends = then.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("leaf")), F.struct(F.col("b").alias("v"), F.lit(0).alias("leaf")))).alias("e"))
        roles = ends.groupBy("e.v").agg(F.sum("e.leaf").alias("leaves"), F.min("e.leaf").alias("centre"))
        unsettled = roles.where("leaves > 1 or (leaves = 1 and centre = 0)").limit(1).count()
        discard(now)
        now = then
        if not unsettled:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
