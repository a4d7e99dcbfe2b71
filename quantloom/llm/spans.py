"""Cutting byte or character spans out of documents, keyed by the text's own digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.shingles import word_bounds


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans; touching spans are one run."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.append(True, starts[1:] > reach[:-1]))
    return starts[new], reach[np.append(new[1:], len(reach)) - 1]


def without(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    at, out = 0, []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def text_key(text: str = "text"):
    """128-bit digest of a text (null: empty)."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


#: Rows whose texts and spans a task holds as Python objects at once.
ROWS = 128


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(k, ROWS) for k in range(0, batch.num_rows, ROWS))


def runs_of(spans: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """merged() spans of each row of an array<struct<a, b>> column (null: none); rows of spans never become Python objects."""
    at, values = spans.offsets.to_numpy(), spans.values
    a, b = (values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("a", "b"))
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield merged(a[lo:hi], b[lo:hi])


def passage_bytes(raw: bytes, a: np.ndarray, b: np.ndarray, words: int) -> int:
    """Bytes from the first to the last word of each run of word numbers, in texts of at least so many words."""
    data = np.frombuffer(raw, np.uint8)
    start, end, _ = word_bounds(data, np.array([0, len(data)]))
    return int((end[np.minimum(b, len(end)) - 1] - start[a]).sum()) if len(start) >= words else 0


def removal_report(keyed: DataFrame, with_text: bool = False, words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of rows (doc_id, text, spans array<struct<a, b>>), spans in bytes.

    with_text adds text, what is left of it (null: null); characters that a span covers only in part go whole there. words
    adds n_passage_bytes, of a column passages like spans, in word numbers.
    """
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["text"] * with_text, *["n_passage_bytes"] * bool(words)]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.string()] * with_text, *[pa.int64()] * bool(words))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            passages = runs_of(batch.column(3)) if words else repeat(None, batch.num_rows)
            for text, (a, b), shared in zip(batch.column(1).to_pylist(), runs_of(batch.column(2)), passages, strict=True):
                raw = (text or "").encode()
                kept = without(raw, a, b)
                left = (kept.decode("utf-8", "ignore") if text is not None else None,) * with_text
                rows.append((len(raw), int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), *left, *((passage_bytes(raw, *shared, words) if len(shared[0]) else 0,) if words else ())))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    made = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text + ", n_passage_bytes long" * bool(words)
    return keyed.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "spans", *["passages"] * bool(words)).mapInArrow(scan, made)


def cut_texts(keyed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with their spans cut out of text. Characters that a span covers only in part go whole."""
    kept = keyed.select(*columns, "spans")
    at = columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = []
            for text, (a, b) in zip(batch.column(at).to_pylist(), runs_of(batch.column(len(columns))), strict=True):
                if text is not None and len(a):
                    text = without(text.encode(), a, b).decode("utf-8", "ignore")
                out.append(text)
            arrays = [pa.array(out, pa.string()) if k == at else batch.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return kept.mapInArrow(scan, keyed.select(*columns).schema)
