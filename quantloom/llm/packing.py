"""Best-fit packing of token pieces into sequences by hierarchical residual packing."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import materialize

LENGTH, END_ID, GROUP, SLACK = 1024, 2, 32768, 8
SPECIAL = {"<|endoftext|>": 50256}
RANKS, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
LONG_SPACE = 4_000
_SPACES = re.compile(rf"\s{{{LONG_SPACE}}}")


class Encoder:
    """The ids of byte_bpe_50k.json. Its rank file gives the same ids at three times the speed (tests compare them), but that
    library's matcher fails on hundreds of thousands of white-space characters in a row: texts with LONG_SPACE of them in a
    row go through the file itself."""

    def __init__(self, ranks: str | None = None, whole: str | None = None):
        import public_tokenizers
        import tiktoken

        lines = Path(ranks or public_tokenizers.path(RANKS)).read_text().splitlines()
        table = {base64.b64decode(a): int(b) for a, b in map(str.split, lines)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=SPECIAL)
        self.whole, self.slow = whole or public_tokenizers.path(TOKENIZER), None

    def ids(self, text: str) -> list[int]:
        if len(text) >= LONG_SPACE and _SPACES.search(text):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.whole)
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special="all") if "<|endoftext|>" in text else self.fast.encode_ordinary(text)


def token_pieces(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """uid, doc_id, piece, start, length, ids_crc32 and, if asked for, ids of docs (doc_id, text).

    A document is the ids of its whole text (null: empty) and end_id. One of more than length ids is cut into pieces of
    length; its first piece has the rest and may be shorter. uid is unique for each row.
    """
    ids_type = ", ids array<int>" if with_ids else ""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(ranks)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*enc.ids(text or ""), end_id], "<u4")
                start, piece, n = 0, 0, len(ids)
                while start < n:
                    end = start + ((n - start) % length or length)
                    for k, v in enumerate((doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes()), ids[start:end].astype(np.int32) if with_ids else None)):
                        out[k].append(v)
                    start, piece = end, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out[: len(names)], kinds, strict=False)], names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.mapInArrow(scan, f"doc_id long, piece int, start long, length long, ids_crc32 long{ids_type}")
    return materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "pieces")


def best_fit(lengths: list[int], length: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: bin and offset of every item, and each bin's fill. Free spaces are kept by size in a bit mask."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins, offsets, fills = [0] * len(lengths), [0] * len(lengths), []
    free: list[list[int]] = [[] for _ in range(length + 1)]
    mask = 0
    for i in order:
        n = lengths[i]
        fit = mask >> n
        if fit:
            space = n + (fit & -fit).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                mask &= ~(1 << space)
        else:
            b, space = len(fills), length
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        if space > n:
            free[space - n].append(b)
            mask |= 1 << (space - n)
    return bins, offsets, fills


def packer(number: int, length: int):
    """Best-fit over one group of a round, for applyInPandas."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "uid"])
        bins, offsets, fills = best_fit(rows["length"].tolist(), length)
        own = (number << 58) | (int(key[0]) << 20)
        return pd.DataFrame({"uid": rows["uid"], "bin": [own | b for b in bins], "at": offsets, "fill": [fills[b] for b in bins]})

    return run


def pack(items: DataFrame, length: int = LENGTH) -> DataFrame:
    """sequence_id and offset of items (uid, length), each of at most length.

    Full items are sequences of their own. The others are dealt into groups of GROUP and packed best-fit there; bins with
    at most SLACK free are emitted, the underfull ones become items of the next round, dealt into fewer groups, until one
    group packed them all or a round merged none. Empty input gives an empty table.
    """
    assigned = items.where(F.col("length") == length).select("uid", (-1 - F.col("uid")).alias("bin"), F.lit(0).cast("long").alias("at"))
    now, steps, number = items.where(F.col("length") < length).select("uid", "length"), [], 0
    while True:
        n = now.count()
        if not n:
            break
        groups = -(-n // GROUP)

        dealt = now.withColumn("g", F.pmod(F.xxhash64("uid", F.lit(number)), F.lit(groups)))
        step = materialize(dealt.groupBy("g").applyInPandas(packer(number, length), "uid long, bin long, at long, fill long"), "bins")
        steps.append(step)
        now = step.where(F.col("fill") < length - SLACK).select(F.col("bin").alias("uid"), F.col("fill").alias("length")).distinct()
        number += 1
        if groups == 1 or number == 31 or step.select("bin").distinct().count() == n:
            break
    packed = None
    for step in steps:
        step = step.drop("fill")
        if packed is None:
            packed = step
            continue
        step = step.select(F.col("uid").alias("bin"), F.col("bin").alias("_bin"), F.col("at").alias("_at"))
        packed = packed.join(step, "bin", "left").select("uid", F.coalesce("_bin", "bin").alias("bin"), (F.col("at") + F.coalesce("_at", F.lit(0))).alias("at"))
    if packed is not None:
        assigned = assigned.union(packed)
    return assigned.select("uid", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))


def packed_documents(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs (doc_id, text)."""
    pieces = token_pieces(docs, length)
    return pieces.join(pack(pieces, length), "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents, packed."""
    return packed_documents(docs)
