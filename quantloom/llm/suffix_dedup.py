"""Exact removal of byte strings that occur twice, by prefix-free parsing of the corpus.

Rolling-hash triggers cut every text into phrases: a window of MIN bytes belongs to the trigger that is the leftmost minimum
of the hashes of its GRAM-byte grams, so equal windows have equal triggers at equal places, whatever surrounds them. The
dictionary is the set of distinct phrases (all windows of one trigger, with their bytes), the parse is where they occur.
Phrases overlap by MIN - 1 bytes, so no window spans two of them: the parse adds occurrences and counts to the dictionary's
order, and corpus order to a depth of MIN bytes is

1. of phrases whose trigger occurs once: nothing repeats there, their order is not needed;
2. of phrases that occur twice: each of their windows repeats;
3. of the others, distinct phrases that share a trigger: the suffix array of the dictionary. It is sorted at the triggers,
   once by what follows and once by what precedes, read backwards. A window that starts j bytes before its trigger stands at
   the pair of its classes at depth j before and MIN - j after; windows that are equal have equal pairs.

Pairs are first compared for runs of RUN windows (what all windows of the run share must be equal for any to be), then for
the single windows of runs that still differ. Every comparison is a join; no group is gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import HASH_A, HASH_B, U64, binary_column, byte_blocks, discard, materialize, mixed, sieved
from quantloom.llm.passages import shared_passages, sliding_least
from quantloom.llm.shingles import word_bounds
from quantloom.llm.spans import cut_texts, removal_report, text_key
from quantloom.llm.suffix_order import at_depth, suffix_order

MIN, GRAM, RUN, BLOCK = 400, 128, 16, 1 << 18
STAGE_MIN, STAGE_GRAM, STAGE_WORDS = 256, 96, 51
_A, _B = U64(0x9FB21C651E98DF25), U64(0xD6E8FEB86659FD93)


def phrases(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """key, i0, i1 (first and last window), at (their trigger), g (its hash), f (hash of the phrase) of docs (key, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, raw, at in byte_blocks(batch.column(1), BLOCK):
                sizes = np.diff(at)
                counts = np.maximum(0, sizes - least + 1)
                total = int(counts.sum())
                if not total:
                    continue
                prefix = HASH_A.prefix(raw)
                grams = HASH_A.windows(prefix, gram)
                place = np.arange(len(grams), dtype=U64)
                trigger = sliding_least((grams >> U64(32) << U64(32)) | place, least - gram + 1) & U64(0xFFFFFFFF)
                window = np.repeat(at[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(total)
                doc = np.repeat(np.arange(len(sizes)), counts)
                own = trigger[window].astype(np.int64)
                first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])))
                last = np.append(first[1:] - 1, total - 1)
                i0, i1, mark, d = window[first], window[last], own[first], doc[first]
                f = mixed(HASH_A.ranges(prefix, i0, i1 + least) + (i1 - i0).astype(U64) * _A + (mark - i0).astype(U64) * _B)
                base = at[d]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + d)), *(pa.array(x.astype(np.int32)) for x in (i0 - base, i1 - base, mark - base)), pa.array(grams[mark].view(np.int64)), pa.array(f.view(np.int64))], ["key", "i0", "i1", "at", "g", "f"])

    return docs.select("key", "text").mapInArrow(scan, "key binary, i0 int, i1 int, at int, g long, f long")


def strings(texts: DataFrame, least: int) -> DataFrame:
    """(key, i0, i1, at, w, before, after) of the phrases in texts (key, text, parts): the bytes before the trigger read
    backwards, and those from it on."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                key, raw = batch.column(0)[row].as_py(), memoryview(batch.column(1)[row].as_buffer())
                parts = batch.column(2)[row].values
                i0, i1, at = (np.asarray(parts.field(k)).tolist() for k in ("i0", "i1", "at"))
                before = [bytes(raw[a:t])[::-1] for a, t in zip(i0, at, strict=True)]
                after = [bytes(raw[t : b + least]) for b, t in zip(i1, at, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(i0), pa.binary()), *(parts.field(k) for k in ("i0", "i1", "at", "w")), pa.array(before, pa.binary()), pa.array(after, pa.binary())], ["key", "i0", "i1", "at", "w", "before", "after"])

    return texts.select("key", F.col("text").cast("binary"), "parts").mapInArrow(scan, "key binary, i0 int, i1 int, at int, w int, before binary, after binary")


PLACES = ("key", "i0", "i1", "at", "w", "before_depths", "before_ranks", "after_depths", "after_ranks")


def placed(phrase: DataFrame) -> DataFrame:
    """The phrases with pid and their paths in both suffix orders in place of their bytes."""
    orders = {side: suffix_order(phrase.select(F.col(side).alias("s")), f"suffixes-{side}") for side in ("before", "after")}
    rows = phrase.select("key", "i0", "i1", "at", "w", *(F.unhex(F.md5(side)).alias(side) for side in orders))
    for side, order in orders.items():
        named = order.toDF(f"{side}_digest", f"{side}_depths", f"{side}_ranks")
        rows = rows.join(named, F.col(side) == F.col(f"{side}_digest"), "left")
    empty = {f"{side}_{x}": F.coalesce(f"{side}_{x}", F.array().cast(f"array<{kind}>")) for side in orders for x, kind in (("depths", "int"), ("ranks", "long"))}
    out = materialize(rows.withColumns(empty).select(F.monotonically_increasing_id().alias("pid"), *PLACES), "dictionary-order")
    discard(*orders.values())
    return out


def classes(batch: pa.RecordBatch, row: int):
    """Functions of a depth array: the classes of a phrase before and after its trigger."""
    read = lambda name: np.asarray(batch.column(name)[row].values)
    paths = [(read(f"{side}_depths"), read(f"{side}_ranks")) for side in ("before", "after")]
    return [lambda depth, p=p: at_depth(*p, depth) for p in paths]


def runs(phrase: DataFrame, least: int) -> DataFrame:
    """Rows (key, pid, lo, hi, w, e, f) for the runs of RUN window starts, counted from the trigger, of placed phrases.

    e: the classes of what all windows of the run share; f: of all its bytes, null where the phrase holds a part of the run
    only. w: 2 for a phrase that occurs twice or more, else 1.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = []
            for row in range(batch.num_rows):
                i0, i1, at = (batch.column(k)[row].as_py() for k in ("i0", "i1", "at"))
                before, after = classes(batch, row)
                m = np.arange((i0 - at) // RUN, (i1 - at) // RUN + 1)
                start = at + RUN * m
                whole = (start >= i0) & (start + RUN - 1 <= i1)
                e = np.column_stack([m, before(np.maximum(at - start - RUN + 1, 0)), after(start + least - at)])
                first, last = np.where(whole, start, i0), np.where(whole, start + RUN - 1, i0)
                f = np.column_stack([before(at - first), after(last + least - at)])
                out.append([np.full(len(m), row), np.maximum(start, i0), np.minimum(start + RUN - 1, i1), whole, e, f])
            if out:
                row, lo, hi, whole, e, f = (np.concatenate(x) for x in zip(*out, strict=True))
                own = batch.take(pa.array(row))
                f = pc.if_else(pa.array(whole), binary_column(f), pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([own.column("key"), own.column("pid"), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), own.column("w"), binary_column(e), f], ["key", "pid", "lo", "hi", "w", "e", "f"])

    return phrase.mapInArrow(scan, "key binary, pid long, lo int, hi int, w int, e binary, f binary")


def windows(parts: DataFrame, least: int) -> DataFrame:
    """Rows (key, lo, w, e, h) for the single windows of runs (lo, hi, of_w, e) joined with their placed phrases."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = []
            for row in range(batch.num_rows):
                lo, hi, at = (batch.column(k)[row].as_py() for k in ("lo", "hi", "at"))
                before, after = classes(batch, row)
                i = np.arange(lo, hi + 1)
                out.append([np.full(len(i), row), i, np.column_stack([at - i, before(at - i), after(i + least - at)])])
            if out:
                row, i, h = (np.concatenate(x) for x in zip(*out, strict=True))
                own = batch.select(["key", "of_w", "e"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(i.astype(np.int32)), own.column(1), own.column(2), binary_column(h)], ["key", "lo", "w", "e", "h"])

    return parts.mapInArrow(scan, "key binary, lo int, w int, e binary, h binary")


def repeated_spans(docs: DataFrame, least: int = MIN, gram: int = GRAM, few: bool = False) -> DataFrame:
    """(key, spans array<struct<a, b>>) for the texts of docs (key, text) with strings of least bytes that start elsewhere too.

    Spans are byte ranges, not yet merged. A key stands for one text; rows of equal texts are occurrences of it.
    few: only texts that may have phrases to be sorted are moved to them.
    """
    parse = materialize(phrases(docs, least, gram), "parse")
    # Written first, so that the join with them can split a frequent trigger.
    twice = materialize(parse.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "repeated-triggers")
    parse2 = materialize(parse.join(twice, "g", "left_semi"), "parse-repeated")
    discard(parse, twice)
    where = F.struct("key", "i0", "i1", "at")
    words = materialize(parse2.groupBy("g", "f").agg(F.count("*").alias("n"), F.min(where).alias("one")), "dictionary")
    mixed_g = words.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1").select("g")
    whole = parse2.join(words.where("n > 1").select("g", "f"), ["g", "f"], "left_semi").select("key", F.col("i0").alias("a"), (F.col("i1") + least).alias("b"))
    unsure = words.join(mixed_g, "g", "left_semi").select("one.*", F.least("n", F.lit(2)).cast("int").alias("w"))
    parts = materialize(unsure.groupBy("key").agg(F.collect_list(F.struct("i0", "i1", "at", "w")).alias("parts")), "unsure")
    texts = (sieved(docs, parts, "key") if few else docs).join(parts.select("key"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    phrase = materialize(strings(texts.join(parts, "key"), least), "unsure-phrases")
    order = placed(phrase)
    discard(phrase, parts)
    row = materialize(runs(order, least), "runs")
    kinds = row.groupBy("e", "f").agg(F.sum("w").alias("w"), F.min(F.struct("key", "pid", "lo", "hi")).alias("one"))
    kinds = materialize(kinds.join(row.groupBy("e").agg(F.sum("w").alias("all")).where("all > 1"), "e"), "run-kinds")
    sure = (F.col("f").isNotNull()) & (F.col("w") > 1)
    runs_whole = row.join(kinds.where(sure).select("e", "f"), ["e", "f"], "left_semi").select("key", F.col("lo").alias("a"), (F.col("hi") + least).alias("b"))
    # A run goes on if another kind shares its e; kinds that are settled send one witness. Partial runs stay rows of their own.
    split = kinds.withColumn("other", F.col("all") - F.col("w")).where((F.col("other") > 0) | F.col("f").isNull())
    witness = split.where(F.col("f").isNotNull()).select("one.pid", "one.lo", "one.hi", F.least("w", F.lit(2)).cast("int").alias("of_w"), "e")
    partial = row.where("f is null").join(split.where("f is null").select("e"), "e", "left_semi").select("pid", "lo", "hi", F.col("w").alias("of_w"), "e")
    single = materialize(windows(witness.union(partial).join(order, "pid"), least), "windows")
    again = single.groupBy("e", "h").agg(F.sum("w").alias("w")).where("w > 1").select("e", "h")
    singles = single.join(again, ["e", "h"], "left_semi").select("key", F.col("lo").alias("a"), (F.col("lo") + least).alias("b"))
    return whole.union(runs_whole).union(singles).groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def short_passages(docs: DataFrame, words: int, under: int) -> DataFrame:
    """(key, spans array<struct<a, b>>) for the runs of so many words, of fewer bytes than under, that occur elsewhere too in
    docs (key, text): what repeated_spans misses of repeats that are long in words but short in bytes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, raw, at in byte_blocks(batch.column(1), BLOCK):
                start, end, first = word_bounds(raw, at)
                row = np.repeat(np.arange(len(at) - 1), np.diff(first))
                i = np.arange(max(0, len(start) - words + 1))
                i = i[(row[i] == row[i + words - 1]) & (end[i + words - 1] - start[i] < under)]
                if not len(i):
                    continue
                a, b, base = start[i], end[i + words - 1], at[row[i]]
                hashes = [h.ranges(h.prefix(raw), a, b).view(np.int64) for h in (HASH_A, HASH_B)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + row[i])), *(pa.array((x - base).astype(np.int32)) for x in (a, b)), *map(pa.array, hashes)], ["key", "a", "b", "h", "k"])

    rows = materialize(docs.select("key", "text").mapInArrow(scan, "key binary, a int, b int, h long, k long"), "short-passages")
    again = materialize(rows.groupBy("h", "k").agg(F.count("*").alias("n")).where("n > 1").select("h", "k"), "repeated-passages")
    return rows.join(again, ["h", "k"], "left_semi").groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def with_spans(docs: DataFrame, least: int, gram: int, words: int | None = None) -> DataFrame:
    """docs with the spans of strings of least bytes, and of passages of so many words, that occur twice."""
    keyed = docs.withColumn("_key", text_key())
    rows = docs.select(text_key().alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = repeated_spans(rows, least, gram)
    if words:
        found = found.union(short_passages(rows, words, least)).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return keyed.join(materialize(found.withColumnRenamed("key", "_key"), "spans"), "_key", "left")


def suffix_dedup(docs: DataFrame, least: int = MIN, gram: int = GRAM, with_text: bool = False, words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the text left, for every row of docs (doc_id, text).

    Removed is each byte that a string of least bytes covers which also starts anywhere else, in the same text included;
    overlapping starts count. Null texts are empty; texts under least bytes lose nothing; rows of equal texts of at least
    that many bytes lose all. Extra columns are ignored.

    words adds n_passage_bytes: the bytes of the text as given in passages of so many words that another row holds too,
    however few bytes they have. Nothing is removed for it.
    """
    docs = docs.select("doc_id", "text")
    if not words:
        return removal_report(with_spans(docs, least, gram), with_text)
    rows = docs.select(text_key().alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    passages = shared_passages(rows, words)  # first, so that its tables are gone when the others are written
    spans = repeated_spans(rows, least, gram, few=True)
    both = spans.withColumn("passages", F.lit(None)).unionByName(passages.withColumn("spans", F.lit(None)))
    both = both.groupBy(F.col("key").alias("_key")).agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("spans", "passages")))
    keyed = docs.withColumn("_key", text_key()).join(materialize(both, "spans"), "_key", "left")
    return removal_report(keyed, with_text, words)


def suffix_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: passages of STAGE_MIN bytes or of STAGE_WORDS words or more that occur twice are cut from every text; no
    row goes."""
    now = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    # No column of docs can clash with those added here, and the text is carried once.
    packed = docs.select(F.struct(*([c for c in docs.columns if c not in now] or [F.lit(None).alias("none")])).alias("_row"), "text")
    out = cut_texts(with_spans(packed, STAGE_MIN, STAGE_GRAM, STAGE_WORDS), ["_row", "text"])
    return out.select(*(now.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))
