"""Passages of many words that another document holds too, by prefix-free parsing at word borders.

Windows of so many words belong to the trigger that is the leftmost minimum of the hashes of their grams' first bytes, so equal windows have
equal triggers at equal places. Windows of one trigger in a row are a phrase. Triggers seen once repeat nothing; phrases that
two texts hold repeat whole; only phrases that share a trigger with others, and half of a window's words with another text's,
are compared window by window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import HASH_A, HASH_B, U64, byte_blocks, discard, materialize, mixed, sieved
from quantloom.llm.shingles import word_bounds

#: A gram has 2 * GRAM - 1 bytes at least, so HEAD of them lie in it.
GRAM, HEAD, BLOCK, TRIGGER_BITS = 14, 24, 1 << 18, 1 << 26
_A, _B = U64(0x9FB21C651E98DF25), U64(0xD6E8FEB86659FD93)


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of so many keys: of prefix minima and suffix minima of blocks."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(U64).max, U64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def half(words: int, gram: int) -> int:
    """Half of the places a gram can have in a window."""
    return (words - gram + 1) // 2


def heads(raw: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hash of the HEAD bytes from each start."""
    padded = np.concatenate([raw, np.zeros(HEAD, np.uint8)])
    at = np.ndarray(len(raw) + HEAD - 7, U64, padded, strides=(1,))
    return mixed(mixed(at[start] * _A + at[start + 8]) * _B + at[start + 16])


def word_phrases(docs: DataFrame, words: int, gram: int) -> DataFrame:
    """key, i0, i1 (first word of the first and last window), at (that of their trigger), g (hash of it), f (hash of the phrase),
    left, right of docs (key, text).

    The trigger is the gram of least hash of its first HEAD bytes. Windows that start at least half(words, gram) words before it
    share the words hashed to left (null if the phrase has none), those that start later share what is hashed to right.
    """
    near = half(words, gram)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, raw, at in byte_blocks(batch.column(1), BLOCK):
                start, end, first = word_bounds(raw, at)
                counts = np.maximum(0, np.diff(first) - words + 1)
                total = int(counts.sum())
                if not total:
                    continue
                keys = heads(raw, start[: len(start) - gram + 1])
                place = np.arange(len(keys), dtype=U64)
                trigger = sliding_least((keys >> U64(32) << U64(32)) | place, words - gram + 1) & U64(0xFFFFFFFF)
                window = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(total)
                doc = np.repeat(np.arange(len(counts)), counts)
                own = trigger[window].astype(np.int64)
                new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])))
                last = np.append(new[1:] - 1, total - 1)
                i0, i1, mark, d = window[new], window[last], own[new], doc[new]
                prefix = HASH_A.prefix(raw)
                a, b = start[i0], end[i1 + words - 1]
                g = HASH_A.ranges(prefix, start[mark], end[mark + gram - 1])
                f = mixed(HASH_A.ranges(prefix, a, b) + (b - a).astype(U64) * _A + (start[mark] - a).astype(U64) * _B)
                has = [i0 <= mark - near, i1 > mark - near]
                sides = [HASH_A.ranges(prefix, start[np.where(has[0], mark - near, mark)], end[mark + gram - 1]), HASH_A.ranges(prefix, start[mark], end[np.where(has[1], mark + words - near, mark)])]
                sides = [pa.array((x >> U64(33)).astype(np.int32), mask=~ok) for x, ok in zip(sides, has, strict=True)]
                base = first[d]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + d)), *(pa.array((x - base).astype(np.int32)) for x in (i0, i1, mark)), *(pa.array(x.view(np.int64)) for x in (g, f)), *sides], ["key", "i0", "i1", "at", "g", "f", "left", "right"])

    return docs.select("key", "text").mapInArrow(scan, "key binary, i0 int, i1 int, at int, g long, f long, left int, right int")


def word_windows(texts: DataFrame, words: int) -> DataFrame:
    """key, i, of_one, of_other, sure, h, k (two hashes) of the windows i0 to i1 of parts in texts (key, text, parts)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw = np.frombuffer(batch.column(1)[row].as_buffer(), np.uint8)
                start, end, _ = word_bounds(raw, np.array([0, len(raw)]))
                parts = batch.column(2)[row].values
                i0, i1 = (parts.field(c).to_numpy().astype(np.int64) for c in ("i0", "i1"))
                n = i1 - i0 + 1
                part = np.repeat(np.arange(len(n)), n)
                i = np.repeat(i0 - (np.cumsum(n) - n), n) + np.arange(n.sum())
                hashes = [x.ranges(x.prefix(raw), start[i], end[i + words - 1]).view(np.int64) for x in (HASH_A, HASH_B)]
                of = [parts.field(c).take(pa.array(part)) for c in ("of_one", "of_other", "sure")]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[row].as_py()] * len(i), pa.binary()), pa.array(i.astype(np.int32)), *of, *map(pa.array, hashes)], ["key", "i", "of_one", "of_other", "sure", "h", "k"])

    return texts.select("key", F.col("text").cast("binary"), "parts").mapInArrow(scan, "key binary, i int, of_one long, of_other long, sure boolean, h long, k long")


def shared_passages(docs: DataFrame, words: int, gram: int = GRAM) -> DataFrame:
    """(key, passages array<struct<a, b>>) for the texts of docs (key, text) with runs of so many words, and the white space
    between them, that another row of docs holds too.

    Passages are ranges of word numbers, not yet merged; the whole text of repeated rows is one that ends beyond its last word.
    """
    if not HEAD < 2 * gram <= 2 * words:
        raise ValueError("passages need at least as many words as a gram, and a gram more than HEAD bytes")
    parse = materialize(word_phrases(docs, words, gram), "word-parse")
    twice = materialize(parse.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "word-triggers")
    again = materialize(sieved(parse, twice, "g", bits=TRIGGER_BITS).join(twice, "g", "left_semi"), "word-parse-repeated")
    discard(parse, twice)
    t = F.xxhash64("key")
    kinds = materialize(again.groupBy("g", "f").agg(F.min(t).alias("of_one"), F.max(t).alias("of_other")), "word-kinds")
    several = kinds.groupBy("g").agg(F.count("*").alias("n"), F.min("of_one").alias("x"), F.max("of_other").alias("y")).where("n > 1 and x <> y").select("g", F.lit(True).alias("several"))
    kinds2 = materialize(kinds.join(several, "g", "left").withColumn("sure", F.expr("of_one <> of_other")).where("sure or several"), "word-kinds-shared")
    of = ("g", "f", "at", "left", "right", "of_one", "of_other")
    marked = materialize(again.join(kinds2, ["g", "f"]).select("key", "i0", "i1", "sure", "several", *(F.when(F.col("several"), F.col(c)).alias(c) for c in of)), "word-phrases-shared")
    whole = marked.where("sure").select("key", F.col("i0").alias("a"), (F.col("i1") + words).alias("b"))
    # Settled kinds send one witness. A half goes on if another text has it.
    unsure = marked.where("several and sure").dropDuplicates(["g", "f"]).union(marked.where("several and not sure"))
    near = F.col("at") - half(words, gram)
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("e"), "i0", F.least("i1", near).alias("i1")), F.struct(F.lit(1).alias("side"), F.col("right").alias("e"), F.greatest("i0", near + 1).alias("i0"), "i1"))
    halves = materialize(unsure.select("key", "g", "of_one", "of_other", "sure", F.explode(sides).alias("s")).select("key", "g", "of_one", "of_other", "sure", "s.*").where("e is not null"), "word-halves")
    shared = halves.groupBy("g", "side", "e").agg(F.min("of_one").alias("x"), F.max("of_other").alias("y")).where("x <> y").select("g", "side", "e")
    halves2 = halves.join(materialize(shared, "word-halves-shared"), ["g", "side", "e"], "left_semi")
    parts = materialize(halves2.groupBy("key").agg(F.collect_set(F.struct("i0", "i1", "of_one", "of_other", "sure")).alias("parts")), "word-parts")
    texts = sieved(docs, parts, "key").join(parts.select("key"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    single = materialize(word_windows(texts.join(parts, "key"), words), "word-windows")
    shared = materialize(single.groupBy("h", "k").agg(F.min("of_one").alias("x"), F.max("of_other").alias("y")).where("x <> y").select("h", "k"), "word-windows-shared")
    singles = single.where("not sure").join(shared, ["h", "k"], "left_semi").select("key", F.col("i").alias("a"), (F.col("i") + words).alias("b"))
    copies = again.where("i0 = 0").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(0).alias("a"), F.lit(2**31 - 1).alias("b"))
    found = materialize(whole.union(singles).union(copies).groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("passages")), "passages")
    discard(again, kinds, kinds2, marked, halves, parts, single, shared)
    return found
