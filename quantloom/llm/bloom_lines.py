"""Line deduplication by two Bloom filters, of keys seen once and of keys seen twice.

Tasks hash the keys of their lines and mark cells of the filters; a cell that is marked again goes from the first filter to
the second. A key in two documents has all its cells in the second filter, so only keys found there leave their tasks: as
SHA-256 digests, which are grouped to confirm the repeat exactly and to find the first document that holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import U64, discard, fresh_path, materialize, mixed
from quantloom.llm.spans import text_key

#: Least code points of a key.
LEAST_CHARS = 10
#: Cells of a filter for each key, in segments of 2**16; a key has its PROBES cells in one segment. One in 6,000 keys that
#: are seen once then has all its cells in the second filter.
CELLS, SEGMENT_BITS, PROBES = 8, 16, 3
#: A filter has at most 2**30 cells (128 MB), since every worker reads it. Of more than 134 million keys a growing share is
#: suspected without need, and shuffled as digests; what comes out is the same.
MAX_SEGMENTS = 1 << 14
#: Keys that a task hashes before it hands its marks on.
BATCH_KEYS = 1 << 20

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACES = b" \t\n\v\f\r"


def line_keys(text: bytes, least: int) -> list[bytes | None]:
    """The key of every line of a UTF-8 text: white space stripped at both ends, A-Z lower-cased; None under least code points."""
    keys = [x.strip(_SPACES) for x in text.translate(_LOWER).split(b"\n")]
    return [k if len(k) >= 4 * least or (len(k) >= least and len(k.decode("utf-8", "replace")) >= least) else None for k in keys]


def hashed(keys: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(k) for k in keys], U64)


def cells(hashes: np.ndarray, segments: int) -> np.ndarray:
    """A row of PROBES cells for each hash."""
    segment = ((hashes >> U64(32)) * U64(segments)) >> U64(32)
    places = np.stack([hashes, hashes >> U64(16), mixed(hashes)], 1) & U64((1 << SEGMENT_BITS) - 1)
    return (segment << U64(SEGMENT_BITS))[:, None] | places


def key_hashes(docs: DataFrame, least: int) -> DataFrame:
    """hashes: the 64-bit hashes of each document's different keys, many documents in a row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                out += [xxhash.xxh3_64_intdigest(k) for k in {*line_keys(text, least)} - {None}] if text else []
                if len(out) >= 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array([np.array(out, U64).tobytes()], pa.binary())], ["hashes"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([np.array(out, U64).tobytes()], pa.binary())], ["hashes"])

    return docs.select(F.col("text").cast("string")).mapInArrow(scan, "hashes binary")


def marks(hashes: DataFrame, segments: int) -> DataFrame:
    """segment, places: the cells that a task's keys mark, in order; those marked again stand there twice."""

    def told(parts: list[np.ndarray]) -> pa.RecordBatch:
        marked = np.sort(cells(np.concatenate(parts), segments).ravel())
        third = np.zeros(len(marked), bool)
        third[2:] = marked[2:] == marked[:-2]
        marked = marked[~third]
        segment = (marked >> U64(SEGMENT_BITS)).astype(np.int32)
        starts = np.flatnonzero(np.diff(segment, prepend=-1))
        at = np.append(starts, len(marked)).astype(np.int32) * 2
        places = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(marked.astype(np.uint16))])
        return pa.RecordBatch.from_arrays([pa.array(segment[starts], pa.int32()), places], ["segment", "places"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            for blob in batch.column(0):
                parts.append(np.frombuffer(blob.as_buffer(), U64))
                n += len(parts[-1])
                if n >= BATCH_KEYS:
                    yield told(parts)
                    parts, n = [], 0
        if n:
            yield told(parts)

    return hashes.mapInArrow(scan, "segment int, places binary")


def second_filter(marked: DataFrame) -> DataFrame:
    """segment, twice: the cells of each segment that two keys have marked, as bits. A task merges one segment after another."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["segment", "twice"])

        for batch in batches:
            for segment, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if segment != now:
                    if now is not None:
                        yield told()
                    now, once, twice = segment, np.zeros(1 << SEGMENT_BITS, bool), np.zeros(1 << SEGMENT_BITS, bool)
                places = np.frombuffer(blob.as_buffer(), np.uint16)
                twice[places[once[places]]] = True
                twice[places[1:][places[1:] == places[:-1]]] = True
                once[places] = True
        if now is not None:
            yield told()

    return marked.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, twice binary")


#: The filter that this worker read last, by its path.
_READ: dict[str, np.ndarray] = {}


def read_filter(path: str, segments: int) -> np.ndarray:
    """Bytes of the second filter from the shared folder, once in each worker."""
    if path not in _READ:
        _READ.clear()
        store, root = fs.FileSystem.from_uri(path)
        out = np.zeros((segments, 1 << (SEGMENT_BITS - 3)), np.uint8)
        for batch in pq.ParquetDataset(root, filesystem=store).read().to_batches():
            for segment, bits in zip(batch.column("segment").to_pylist(), batch.column("twice"), strict=True):
                out[segment] = np.frombuffer(bits.as_buffer(), np.uint8)
        _READ[path] = out.ravel()
    return _READ[path]


def suspected(docs: DataFrame, least: int, path: str, segments: int) -> DataFrame:
    """doc_id, key (of the text), digest of every key that the second filter holds."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = read_filter(path, segments)
        for batch in batches:
            ids, names, digests = [], [], []
            for doc_id, name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                keys = [*({*line_keys(text, least)} - {None})] if text else []
                if keys:
                    at = cells(hashed(keys), segments)
                    hit = (twice[at >> U64(3)] >> (U64(7) - (at & U64(7))).astype(np.uint8) & 1).all(1)
                    found = [hashlib.sha256(keys[k]).digest() for k in np.flatnonzero(hit)]
                    digests += found
                    ids += [doc_id] * len(found)
                    names += [name] * len(found)
            if digests:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.binary()), pa.array(digests, pa.binary())], ["doc_id", "key", "digest"])

    return docs.select("doc_id", "key", "text").mapInArrow(scan, "doc_id long, key binary, digest binary")


def line_dedup_bloom(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """doc_id, n_lines, dropped (numbers of the lines that go, from 0), text (what is left) of every row.

    Lines end at \\n. A key of at least so many code points that two documents hold loses its lines in all of them but the one
    of smallest doc_id; there all of them stay. Null ids come after all others and count as one document; rows of one doc_id
    are one document, too, and each gives a row. A null or empty text is one empty line (a null one stays null). Other
    columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashes = materialize(key_hashes(docs, least), "line-hashes")
    n = hashes.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    segments = max(1, min(MAX_SEGMENTS, -(-n // 8 * CELLS >> SEGMENT_BITS)))
    path = fresh_path(docs.sparkSession, "line-filter")
    second_filter(marks(hashes, segments)).write.parquet(path)
    discard(hashes)
    named = docs.withColumn("key", text_key())
    rows = materialize(suspected(named, least, path, segments), "suspected-lines")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("d"))
    repeats = rows.groupBy("digest").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).where("first < last").select("digest", "first")
    gone = rows.join(repeats, "digest").where(rank > F.col("first")).groupBy("doc_id", "key").agg(F.collect_set("digest").alias("gone"))  # lines of one text
    gone = gone.withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    both = named.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left").select("doc_id", "text", "gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, dropped, texts = [], [], []
            for text, digests in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines, numbers = (text or b"").split(b"\n"), []
                if digests:
                    gone = {*digests}
                    numbers = [k for k, key in enumerate(line_keys(text, least)) if key is not None and hashlib.sha256(key).digest() in gone]
                    drop = {*numbers}
                    text = b"\n".join(x for k, x in enumerate(lines) if k not in drop)
                counts.append(len(lines))
                dropped.append(numbers)
                texts.append(text)
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip((counts, dropped, texts), kinds, strict=True))], ["doc_id", "n_lines", "dropped", "text"])

    out = both.mapInArrow(cut, "doc_id long, n_lines long, dropped array<int>, text binary")
    return out.withColumn("text", F.col("text").cast("string"))
