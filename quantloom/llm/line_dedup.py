"""Line and paragraph deduplication: normalised units are grouped by digest over the corpus, the earliest keeps, the rest is cut."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import materialize
from quantloom.llm.spans import text_key

#: line_removals leaves units of fewer normalised characters alone unless told otherwise; line_dedup takes all non-empty ones.
LEAST_CHARS = 20

_LOWER = {c: c + 32 for c in range(65, 91)}
_SPACES = re.compile(r"[\x09-\x0D\x20]+")
#: What stands between two units.
BREAKS = {"line": re.compile("\n"), "paragraph": re.compile("\n(?:[\t\x0b-\r ]*\n)+")}


def normalised(unit: str) -> str:
    """A-Z lower-cased, runs of ASCII white space one space, trimmed."""
    return _SPACES.sub(" ", unit.translate(_LOWER)).strip(" ")


def split(text: str, kind: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, end with the break) of every unit of a text."""
    at = 0
    for found in BREAKS[kind].finditer(text):
        yield at, found.start(), found.end()
        at = found.end()
    yield at, len(text), len(text)


def units(docs: DataFrame, least: int, kind: str = "line") -> DataFrame:
    """doc_id, key (of the text), unit_no, start, n_chars, digest of every unit of at least so many normalised characters;
    empty ones never."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, key, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for k, (start, end, _) in enumerate(split(text or "", kind)):
                    plain = normalised(text[start:end]) if text else ""
                    if len(plain) >= max(1, least):
                        rows.append((doc_id, key, k, start, end - start, md5(plain.encode()).digest()))
            if rows:
                kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "key", "unit_no", "start", "n_chars", "digest"])

    rows = docs.select(F.col("doc_id").cast("long"), text_key().alias("key"), F.col("text").cast("string"))
    return rows.mapInArrow(scan, "doc_id long, key binary, unit_no int, start long, n_chars long, digest binary")


def line_removals(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """doc_id, unit_no, start, n_chars, kept_doc_id, kept_unit_no of every line that repeats an earlier one.

    Lines are normalised; order is doc_id (nulls last), then unit number. Lines of fewer than
    least normalised characters stay, so do null and empty texts. start and n_chars are code points of the original text.
    Repeated rows of one doc_id rank alike: the first occurrence in such rows stays in each of them.
    """
    return repeated_units(docs, least).drop("key")


def repeated_units(docs: DataFrame, least: int, kind: str = "line") -> DataFrame:
    """line_removals() of either kind of units, with the key of each text."""
    rows = materialize(units(docs, least, kind), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("d"), "unit_no")
    first = rows.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = rows.join(materialize(first, "first-units"), "digest").where(rank > F.col("first"))
    return again.select("doc_id", "key", "unit_no", "start", "n_chars", F.col("first.d").alias("kept_doc_id"), F.col("first.unit_no").alias("kept_unit_no"))


def with_removals(docs: DataFrame, least: int, kind: str) -> DataFrame:
    """docs with _gone, the units that go from each text, sorted."""
    found = repeated_units(docs, least, kind)
    gone = F.struct("unit_no", "start", "n_chars", "kept_doc_id", "kept_unit_no")
    gone = found.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.sort_array(F.collect_set(gone)).alias("_gone"))  # no more than a text has
    keyed = docs.withColumn("_own", text_key())
    return keyed.join(gone, (F.col("_own") == F.col("_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left").select(*docs.columns, "_gone")


def cut(rows: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """rows without the units in _gone, each with the break after it (that before it, if it is the text's last)."""
    at = columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True):
                if text is not None and gone:
                    drop = {x["unit_no"] for x in gone}
                    kept = [x for k, x in enumerate(split(text, kind)) if k not in drop]
                    text = "".join(text[a:c] for a, _, c in kept[:-1]) + "".join(text[a:b] for a, b, _ in kept[-1:])
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns)], batch.schema.names)

    return rows.select(*columns, "_gone").mapInArrow(scan, rows.select(*columns, "_gone").schema)


def without_repeated_lines(docs: DataFrame, least: int = 0, kind: str = "line") -> DataFrame:
    """docs (doc_id, text, further columns) without the units that repeat earlier ones, each with its break; no row goes.

    By default every non-empty line takes part; kind may be "paragraph" (lines up to a blank one). Null texts stay null.
    """
    return cut(with_removals(docs, least, kind), docs.columns, kind).drop("_gone")


def line_dedup(docs: DataFrame, least: int = 0, kind: str = "line") -> DataFrame:
    """doc_id, n_removed, chars_removed, removed, text for every row of docs (doc_id, text).

    text is what without_repeated_lines leaves; removed lists the units that went, in order: (unit_no, start, n_chars,
    kept_doc_id, kept_unit_no), places in code points of the original text. Null texts stay null and lose nothing. Ranks and
    repeated rows are as in line_removals. Extra columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = cut(with_removals(rows, least, kind), ["doc_id", "text"], kind).withColumn("_gone", F.coalesce("_gone", F.array().cast("array<struct<unit_no:int,start:bigint,n_chars:bigint,kept_doc_id:bigint,kept_unit_no:int>>")))
    return out.select("doc_id", F.size("_gone").cast("long").alias("n_removed"), F.expr("aggregate(_gone, 0L, (a, x) -> a + x.n_chars)").alias("chars_removed"), F.col("_gone").alias("removed"), "text")
