"""Periodic runs of words by multi-scale minimizers.

Periods below LAGS are found by comparing all words at each lag. For periods from q to 2q, windows of about 2q/3 words pick
the least hash of their word grams; grams that are periodic themselves, which are known from the smaller scales, are no
candidates. So windows pick O(1/q) of all words, and as a window's pick depends on its words alone, picks repeat at the
period's distance inside a run. Equal picks at such a distance seed an extension, word by word, which makes every run exact:
hashes decide only where to look.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import U64, mixed

#: Lags 1 to LAGS - 1 are scanned directly; the first scale of minimizers is for periods from LAGS to 2 * LAGS - 1. A run has
#: at least TIMES periods and LEAST words.
LAGS, LEAST, TIMES = 16, 24, 3
#: Words of a gram at the first scale; 3 * GRAM <= 2 * LAGS + 1 makes sure that every run has a pick in its first period.
GRAM = 10
#: Documents of about so many words together are worked on at once; a longer one stands alone.
BLOCK_WORDS = 1 << 18
NONE = ~U64(0)


def stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of True of at least so many places."""
    edges = np.flatnonzero(np.diff(same, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return starts[long], (ends - starts)[long]


def lag_runs(ids: np.ndarray) -> list[np.ndarray]:
    """(start, length, lag) of every maximal stretch of TIMES * lag words at least with equal words at a lag below LAGS."""
    out = []
    for lag in range(1, min(LAGS, len(ids))):
        starts, n = stretches(ids[lag:] == ids[:-lag], (TIMES - 1) * lag)
        if len(starts):
            out.append(np.stack([starts, n + lag, np.full(len(starts), lag)], 1))
    return out


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every window of so many values."""
    span = 1
    while 2 * span <= width:
        x, span = np.minimum(x[span:], x[:-span]), 2 * span
    return np.minimum(x[width - span :], x[: len(x) - (width - span)]) if width > span else x


def covered(runs: np.ndarray, gram: int, n: int) -> np.ndarray:
    """The places where a gram lies inside a run of a period of a third of it at most."""
    near = runs[(runs[:, 2] * 3 <= gram) & (runs[:, 1] >= gram)]
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, near[:, 0], 1)
    np.add.at(change, near[:, 0] + near[:, 1] - gram + 1, -1)
    return np.cumsum(change[:n]) > 0


def picks(hashes: np.ndarray, periodic: np.ndarray, gram: int) -> np.ndarray:
    """Places i whose window of grams i to i + gram has its least candidate at one of its ends."""
    marked = np.where(periodic, NONE, hashes)
    least = sliding_least(marked, gram + 1)
    ends = (least == marked[: len(least)]) | (least == marked[gram : gram + len(least)])
    return np.flatnonzero(ends & (least != NONE))


def seeds(at: np.ndarray, names: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """(lag, place) of all pairs of picks with equal names at a distance from low to 2 * low - 1."""
    order = np.lexsort((at, names))
    at, names, lags, places = at[order], names[order], [], []
    for k in range(1, len(at)):
        apart = at[k:] - at[:-k]
        near = (names[k:] == names[:-k]) & (apart < 2 * low)
        if not near.any():  # picks further on in the order are further apart
            break
        good = near & (apart >= low)
        lags.append(apart[good])
        places.append(at[:-k][good])
    return (np.concatenate(lags), np.concatenate(places)) if lags else (np.zeros(0, int), np.zeros(0, int))


def agreeing(a: np.ndarray, b: np.ndarray, step: int) -> int:
    """How many values agree from the start, looked at in growing pieces."""
    at, n = 0, min(len(a), len(b))
    while at < n:
        differ = np.flatnonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return n


def extended(ids: np.ndarray, lags: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """The maximal stretches through the seeds that hold TIMES periods."""
    out, end, last = [], -1, 0
    order = np.lexsort((places, lags))
    for lag, place in zip(lags[order].tolist(), places[order].tolist(), strict=True):
        if lag == last and place < end:
            continue  # in the stretch just found
        after = agreeing(ids[place : len(ids) - lag], ids[place + lag :], 2 * lag)
        before = agreeing(ids[:place][::-1], ids[lag : place + lag][::-1], 2 * lag)
        last, end = lag, place + after + 1
        if before + after >= (TIMES - 1) * lag:
            out.append(np.array([[place - before, before + after + lag, lag]]))
    return out


def smallest_periods(runs: list[np.ndarray]) -> np.ndarray:
    """The runs by start and period; of several periods of one stretch the smallest."""
    if not runs:
        return np.zeros((0, 3), np.int64)
    every = np.unique(np.concatenate(runs).astype(np.int64), axis=0)  # by start, length, period
    new = np.ones(len(every), bool)
    new[1:] = (every[1:, :2] != every[:-1, :2]).any(1)
    every = every[new]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def block_runs(ids: np.ndarray, longest: int) -> np.ndarray:
    """All runs (start, length, smallest period) of at least TIMES periods of a block of documents, whose words are numbers
    and which a number of its own ends; longest is the most words that one of them has."""
    runs = smallest_periods(lag_runs(ids))
    low, gram = LAGS, GRAM
    hashes = None
    while TIMES * low <= longest:
        if hashes is None:
            hashes, size = mixed(ids.astype(U64) + U64(0x9E3779B97F4A7C15)), 1
            while size < gram:  # any order of steps will do, as long as it depends on the words alone
                step = min(size, gram - size)
                hashes, size = mixed(hashes[:-step] * U64(0xD6E8FEB86659FD93) + hashes[step:] + U64(size)), size + step
        twice = mixed(hashes[:-gram] * U64(0xD6E8FEB86659FD93) + hashes[gram:])
        at = picks(hashes, covered(runs, gram, len(hashes)), gram)
        at = at[at < len(twice)]
        found = extended(ids, *seeds(at, twice[at], low))
        if found:
            runs = smallest_periods([runs, *found])
        hashes, gram, low = twice, 2 * gram, 2 * low
    return runs


def numbered(words: list[list[bytes]]) -> np.ndarray:
    """The words of some documents end to end as numbers, equal where they are equal; each document ends in a number of its own."""
    known: dict[bytes, int] = {}
    parts = []
    for k, each in enumerate(words):
        parts.append(np.array([known.setdefault(w, len(known)) for w in each], np.int64))
        parts.append(np.array([-1 - k]))
    return np.concatenate(parts)


def blocks(sizes: list[int]) -> Iterator[list[int]]:
    """Documents of like length in groups of about BLOCK_WORDS words, so that large scales run over long documents alone."""
    group, total = [], 0
    for k in sorted(range(len(sizes)), key=sizes.__getitem__):
        other = group and max(sizes[group[0]] // (TIMES * LAGS), 1).bit_length() != max(sizes[k] // (TIMES * LAGS), 1).bit_length()
        if group and (other or total + sizes[k] > BLOCK_WORDS):
            yield group
            group, total = [], 0
        group.append(k)
        total += sizes[k] + 1
    if group:
        yield group


def document_runs(words: list[list[bytes]]) -> list[np.ndarray]:
    """For each document its runs (start, length, smallest period) of at least TIMES periods and LEAST words, by start and period."""
    out: list[np.ndarray] = [np.zeros((0, 3), np.int64)] * len(words)
    for group in blocks([len(w) for w in words]):
        if len(words[group[-1]]) < LEAST:
            continue
        runs = block_runs(numbered([words[k] for k in group]), len(words[group[-1]]))
        runs = runs[runs[:, 1] >= LEAST]
        first = np.cumsum([0, *(len(words[k]) + 1 for k in group)])
        cut = np.searchsorted(runs[:, 0], first)
        for k, a, b, start in zip(group, cut[:-1], cut[1:], first[:-1], strict=True):
            if b > a:
                out[k] = runs[a:b] - np.array([start, 0, 0])
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay: all but those inside a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def top_run(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of most periods, exactly; ties go to the smallest start, then period."""
    return max(map(tuple, runs.tolist()), key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


RUN = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, runs (start, length, period by start, then period), top (the run of most periods), collapsed (the words that
    stay, joined by one space) of every row.

    edit, if given, changes the words of a document (in UTF-8) beforehand. A null or empty text has no words: no runs, no top,
    an empty text. Null ids and repeated rows each give a row; other columns are ignored. A document is worked on whole in one task,
    with a few dozen bytes for each word.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [(text or b"").split() for text in batch.column(1).cast(pa.binary()).to_pylist()]  # at ASCII white space
            if edit:
                words = [edit(doc_id, each) for doc_id, each in zip(batch.column(0).to_pylist(), words, strict=True)]
            told, tops, texts = [], [], []
            for each, runs in zip(words, document_runs(words), strict=True):
                told.append([{"start": a, "length": n, "period": q} for a, n, q in runs.tolist()])
                top = top_run(runs)
                tops.append(top and dict(zip(("start", "length", "period"), top, strict=True)))
                stay = kept_words(len(each), runs) if len(runs) else None
                texts.append(b" ".join(each if stay is None else [each[k] for k in np.flatnonzero(stay)]))
            one = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.list_(one)), pa.array(tops, one), pa.array(texts, pa.binary())], ["doc_id", "runs", "top", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(scan, f"doc_id long, runs {RUN}, top struct<start:long,length:long,period:long>, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def runs_digest(runs: str = "runs"):
    """SHA-256 of a line start,length,period for every run."""
    lines = F.transform(runs, lambda r: F.concat_ws(",", r.start, r.length, r.period))
    return F.sha2(F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(""), 256)
