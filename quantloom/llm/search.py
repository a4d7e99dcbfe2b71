"""Exact BM25 top-k over an inverted index in shards, many queries at a time.

One scan of the texts writes the index: shards of at most SHARD documents, each a row with its terms, their postings and
counts. In a shard the documents stand by their most frequent term and length, so that alike ones share blocks. The queries
are written in chunks, inverted in the same way, and stand by their most frequent term in a chunk. A search has two rounds
over the shards. The first searches each chunk in its home shards, as many as the root of their number; a query's k-th best
score there is a threshold that holds everywhere. The second searches the other shards with it.

A shard scores a chunk as the product of two sparse matrices: a chunk's terms are looked up once, its queries go in batches,
and every document of the shard gets its score. Where a term is in so many of a batch's queries and of a tile's documents
that most of their cells hold it, the terms' weights stand in a dense table and are multiplied as matrices; the postings of
all other terms are added up singly. Only scores that reach the threshold leave the batch.

Few queries go singly in document order, as in WAND, with blocks of BLOCK documents in place of single ones. A query's short
lists are added up first. A block's bound is its best sum so far and the block maxima of the query's long lists. The cursor
moves to the next block whose bound reaches the threshold (the pivot), scores the run of such blocks from there by the long
lists' postings, raises the threshold to the k-th best score so far, and goes on; postings of other blocks are not read.
Weights are integers under 2**53 in sum, so bounds and products are exact, shards merge exactly and ties are ties.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import U64, byte_blocks, fresh_path, materialize
from quantloom.llm.shingles import word_hashes

K1, B, SCALE, TOP, BLOCK = 1.2, 0.75, 1_000_000, 10, 64
#: A shard ends with so many documents or postings; a document is in one shard.
SHARD, POSTINGS = 8192, 2_000_000
#: Lists of fewer documents of a shard are short. A run takes in up to GAP blocks under the threshold, and ends after RUN blocks.
LONG, GAP, RUN = 32, 2, 48
#: Queries of a chunk, about, and of a batch; documents of a tile; queries that are summed up together. Under FEW go singly.
CHUNK, BATCH, TILE, TOGETHER, FEW = 512, 128, 1024, 8, 4
#: Postings are read so many at a time.
PACK = 4
#: A term's cells in a tile are multiplied if so large a part of them is filled. Bytes of a shard's dense table.
FILLED, DENSE = 0.006, 1 << 26


def row_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words) of whole texts."""
    for lo, hi, raw, at in byte_blocks(column):
        words, first = word_hashes(raw, at)
        for i in range(hi - lo):
            yield lo + i, words[first[i] : first[i + 1]]


def query_terms(queries: DataFrame) -> DataFrame:
    """doc_id, distinct terms (word hashes) of every query that has any."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, words in row_words(batch.column(1)):
                if len(words):
                    own = np.unique(words).view(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 1], pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)], ["doc_id", "terms"])

    return queries.select("doc_id", "text").mapInArrow(scan, "doc_id long, terms array<long>")


def packed(values: np.ndarray, kind: str) -> bytes:
    """An array as compressed bytes: its size in 8 bytes, then zstd."""
    raw = np.ascontiguousarray(values, kind).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(data: pa.Buffer | bytes, kind: str) -> np.ndarray:
    raw = pa.py_buffer(data)
    return np.frombuffer(pa.decompress(raw.slice(8), int.from_bytes(raw.slice(0, 8).to_pybytes(), "little"), "zstd"), kind)


def shard_row(ids: list[int], sizes: list[int], terms: list[np.ndarray], counts: list[np.ndarray]) -> tuple:
    """The inverted index of some documents: their ids and lengths in words, terms, documents of each term, postings."""
    n = np.array([len(x) for x in terms])
    known, term = np.unique(np.concatenate(terms), return_inverse=True)
    df, doc = np.bincount(term, minlength=len(known)), np.repeat(np.arange(len(ids)), n)
    leads = np.zeros(len(ids), np.int64)
    np.maximum.at(leads, doc, df[term] * len(known) + term)  # a document's most frequent term in the shard
    order = np.lexsort((np.array(sizes), leads))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    doc = place[doc]
    by_term = np.argsort(term * len(ids) + doc, kind="stable")
    return (len(ids), sum(sizes), packed(np.array(ids)[order], "<i8"), packed(np.array(sizes)[order], "<i8"), packed(known, "<u8"), packed(df, "<i4"), packed(doc[by_term], "<u2"), packed(np.concatenate(counts)[by_term], "<i4"))


INDEX = {"documents": pa.int64(), "words": pa.int64(), "ids": pa.binary(), "sizes": pa.binary(), "terms": pa.binary(), "df": pa.binary(), "docs": pa.binary(), "counts": pa.binary()}


def index_shards(docs: DataFrame, name: str = "bm25-index") -> DataFrame:
    """The inverted index of docs (doc_id, text), a row for each shard, written to the shared folder."""
    shard_docs, most = SHARD, POSTINGS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        postings = 0

        def flushed() -> pa.RecordBatch:
            row = shard_row(*held)
            for part in held:
                part.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, INDEX.values(), strict=True)], list(INDEX))

        for batch in batches:
            ids = np.asarray(batch.column(0))
            for i, words in row_words(batch.column(1)):
                own, n = np.unique(words, return_counts=True)
                for part, v in zip(held, (int(ids[i]), len(words), own, n.astype(np.int32)), strict=True):
                    part.append(v)
                postings += len(own)
                if len(held[0]) >= shard_docs or postings >= most:
                    yield flushed()
                    postings = 0
        if held[0]:
            yield flushed()

    kinds = ", ".join(f"{k} {'long' if v == pa.int64() else 'binary'}" for k, v in INDEX.items())
    return materialize(docs.select("doc_id", "text").mapInArrow(scan, kinds).withColumn("shard", F.monotonically_increasing_id()), name)


#: Bits of the map of the queries' terms, whatever their number.
MAP_BITS = 1 << 26


def term_map(terms: DataFrame) -> str:
    """Where a bit map of terms lies, by their last bits."""
    place = F.pmod("term", F.lit(MAP_BITS)) + 1  # Spark counts from 1
    maps = terms.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map"))
    return written(maps.coalesce(1), "term-map")  # at most MAP_BITS / 8 bytes


def document_counts(index: DataFrame, terms: DataFrame, shards: int) -> DataFrame:
    """(term, df) over all shards of at least those terms that are asked for. What a shard counts goes out as arrays, one for
    each range of terms; there are the more ranges, the more shards."""
    path, bits, ranges = term_map(terms), MAP_BITS, 16 * (isqrt(shards) + 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.zeros(bits // 8, np.uint8)
        for row in rows_in(path):
            part = np.frombuffer(row.column("map")[0].as_buffer(), np.uint8)
            asked[(row.column("part")[0].as_py() - 1) * len(part) :][: len(part)] = part
        for batch in batches:
            for k in range(batch.num_rows):
                terms, df = (unpacked(batch.column(c)[k].as_buffer(), t) for c, t in ((0, "<u8"), (1, "<i4")))
                bit = terms & U64(bits - 1)
                found = np.flatnonzero(asked[bit >> U64(3)] >> (bit & U64(7)).astype(np.uint8) & 1)
                terms, df = terms[found], df[found]
                cuts = np.searchsorted((terms >> U64(33)) * U64(ranges) >> U64(31), np.arange(ranges + 1)).tolist()
                full = [r for r in range(ranges) if cuts[r] < cuts[r + 1]]
                parts = ([x[cuts[r] : cuts[r + 1]].tobytes() for r in full] for x in (terms, df))
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(x, pa.binary()) for x in parts)], ["range", "terms", "df"])

    def summed(rows: pa.Table) -> pa.Table:
        terms, df = (np.frombuffer(b"".join(rows.column(c).to_pylist()), kind) for c, kind in (("terms", "<u8"), ("df", "<i4")))
        known, place = np.unique(terms, return_inverse=True)
        return pa.table([pa.array(known.view(np.int64)), pa.array(np.bincount(place, df).astype(np.int64))], ["term", "df"])

    return index.select("terms", "df").mapInArrow(scan, "range int, terms binary, df binary").groupBy("range").applyInArrow(summed, "term long, df long")


def weight(idf: np.ndarray, part: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * (idf * part) + 0.5)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of runs of so many from each start."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class Chunk:
    """Some queries as they were written: ids, numbers of terms, the distinct terms of all with their idf, and the places of
    each query's terms among these."""

    def __init__(self, row: dict[str, pa.Buffer | bytes], least: dict[int, float] | None = None):
        self.ids, self.sizes, self.terms, self.idf, self.own = (unpacked(row[c], kind) for c, kind in CHUNK_KINDS.items())
        self.thresholds = np.array([(least or {}).get(i, 0.0) for i in self.ids.tolist()])


class Shard:
    """The inverted index of some documents; weights are computed for the terms that queries have, once each."""

    def __init__(self, row: dict[str, pa.Buffer | bytes], mean: float):
        read = lambda name, kind: unpacked(row[name], kind)
        self.ids, self.terms, self.n = read("ids", "<i8"), read("terms", "<u8"), read("df", "<i4").astype(np.int64)
        self.doc, tf, sizes = read("docs", "<u2"), read("counts", "<i4").astype(float), read("sizes", "<i8")
        scale = K1 * (1 - B + B * (sizes / mean))
        self.weight = tf * (K1 + 1) / (tf + scale[self.doc])  # of a term that no query had yet: without its idf
        del tf
        self.at = np.cumsum(self.n) - self.n
        self.blocks = -(-len(self.ids) // BLOCK)
        self.ready = np.zeros(len(self.terms), bool)
        self.by_block = self.by_tile = False

    def held(self, lists: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Of some lists: how many documents each has in ranges of so many documents, and where each range's postings begin."""
        parts = -(-len(self.ids) // width)
        cell = np.repeat(np.arange(len(lists)) * parts, self.n[lists])
        cell += self.doc[spread(self.at[lists], self.n[lists])] // width
        held = np.bincount(cell, minlength=len(lists) * parts).reshape(-1, parts)
        offset = np.zeros((len(lists), parts + 1), np.int32)
        np.cumsum(held, axis=1, out=offset[:, 1:])
        offset += self.at[lists][:, None].astype(np.int32)
        return held, offset

    def lay_blocks(self) -> None:
        """Tables by block for search()."""
        self.by_block = True
        self.long = np.full(len(self.terms), -1, np.int32)  # a long list's row in the two tables
        lists = np.flatnonzero(self.n >= LONG)
        self.long[lists] = np.arange(len(lists), dtype=np.int32)
        held, self.offset = self.held(lists, BLOCK)
        self.block_most = np.zeros((len(lists), self.blocks))  # largest weight
        filled = held.ravel() > 0
        if filled.any():
            self.block_most.ravel()[filled] = np.maximum.reduceat(self.weight[spread(self.at[lists], self.n[lists])], (np.cumsum(held) - held.ravel())[filled])

    def lay_tiles(self) -> None:
        """Tables by tile for search_all(): the longest lists as rows of a dense table, while it stays under DENSE bytes."""
        self.by_tile = True
        self.row = np.full(len(self.terms), -1, np.int32)
        most = max(1, DENSE // (4 * len(self.ids)))
        lists = np.flatnonzero(self.n >= max(2, FILLED * len(self.ids)))
        if len(lists) > most:
            lists = np.sort(lists[np.argsort(-self.n[lists], kind="stable")[:most]])
        self.row[lists] = np.arange(len(lists), dtype=np.int32)
        self.tile_held, _ = self.held(lists, TILE)
        # Postings in runs, a list's or a dense row's in a tile; each begins anew with a pack, what is left of it weighs nothing.
        runs = np.where(self.row >= 0, self.tile_held.shape[1], 1)
        self.run = np.cumsum(runs) - runs  # a list's first
        held = np.empty(runs.sum(), np.int64)
        held[self.run[self.row < 0]] = self.n[self.row < 0]
        held[self.run[lists][:, None] + np.arange(self.tile_held.shape[1])] = self.tile_held
        self.packs = -(-held // PACK)
        self.pack_at = np.cumsum(self.packs) - self.packs
        self.list_packs = np.add.reduceat(self.packs, self.run)
        self.packed = np.repeat((PACK * self.pack_at - (np.cumsum(held) - held)).astype(np.int32), held)  # where a posting now stands
        self.packed += np.arange(len(self.doc), dtype=np.int32)
        self.pack_doc, self.pack_weight = np.zeros((self.packs.sum(), PACK), np.int64), np.zeros((self.packs.sum(), PACK))
        self.pack_doc.ravel()[self.packed] = self.doc
        self.dense = np.zeros((len(lists), len(self.ids)), np.float32)
        self.lay_lists(np.flatnonzero(self.ready))

    def lay_lists(self, lists: np.ndarray) -> None:
        """Weights of lists in the tables by tile; lists with weights that single precision has not exactly leave the dense one."""
        where = spread(self.at[lists], self.n[lists])
        self.pack_weight.ravel()[self.packed[where]] = self.weight[where]
        lists = lists[self.row[lists] >= 0]
        if len(lists):
            most = np.maximum.reduceat(self.weight[spread(self.at[lists], self.n[lists])], np.cumsum(self.n[lists]) - self.n[lists])
            self.row[lists[most >= 1 << 24]] = -1
            lists = lists[most < 1 << 24]
        where = spread(self.at[lists], self.n[lists])
        cell = np.repeat(self.row[lists].astype(np.int64) * len(self.ids), self.n[lists])
        cell += self.doc[where]
        self.dense.ravel()[cell] = self.weight[where]

    def find(self, terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """Places of terms in the shard, -1 of those that it has not; what it has is weighed."""
        t = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[t] == terms
        fresh = known.copy()
        fresh[known] = ~self.ready[t[known]]
        new, by = t[fresh], idf[fresh]
        where = spread(self.at[new], self.n[new])
        self.weight[where] = weight(np.repeat(by, self.n[new]), self.weight[where])
        if self.by_block:
            rows = self.long[new]
            self.block_most[rows[rows >= 0]] = weight(by[rows >= 0, None], self.block_most[rows[rows >= 0]])
        if self.by_tile:
            self.lay_lists(new)
        self.ready[t[known]] = True
        return np.where(known, t, -1)

    def search_all(self, chunk: Chunk, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query ids, document ids, scores) of a chunk's queries, of each what search() finds."""
        size, count = len(self.ids), len(chunk.ids)
        if not size or not len(self.terms) or not count:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if count < FEW:
            end = np.cumsum(chunk.sizes)
            found = [self.search(chunk.ids[k], chunk.terms[own], chunk.idf[own], chunk.thresholds[k], top) for k, own in enumerate(np.split(chunk.own, end[:-1]))]
            return np.repeat(chunk.ids, [len(x) for x, _ in found]), np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        if not self.by_tile:
            self.lay_tiles()
        term = self.find(chunk.terms, chunk.idf)[chunk.own]
        query = np.repeat(np.arange(count), chunk.sizes)[term >= 0]
        term = term[term >= 0]
        first = np.searchsorted(query, np.arange(0, count + BATCH, BATCH))
        mine = np.flatnonzero(np.isin(self.ids, chunk.ids))
        asked = np.argsort(chunk.ids, kind="stable")
        whose = asked[np.searchsorted(chunk.ids, self.ids[mine], sorter=asked)]
        out = []
        for k, lo in enumerate(range(0, count, BATCH)):
            thresholds = np.maximum(chunk.thresholds[lo : lo + BATCH], 1.0)
            single, has, rows = self.scores(term[first[k] : first[k + 1]], query[first[k] : first[k + 1]] - lo, len(thresholds))
            about = single.copy()
            for tile, own in enumerate(rows):
                if len(own):
                    about[:, tile * TILE : (tile + 1) * TILE] += has[own].T @ self.dense[own, tile * TILE : (tile + 1) * TILE]
            here = (whose >= lo) & (whose < lo + BATCH)
            about[whose[here] - lo, mine[here]] = -1
            # A sum of n terms in single precision is off by less than n * 2**-23 of itself, two of them by twice that.
            sure = 1 - 2 * max(map(len, rows)) * 2.0**-23
            least = thresholds * sure
            over = about >= least[:, None]
            many = np.flatnonzero(np.count_nonzero(over, axis=1) > top)
            if len(many):
                least[many] = np.maximum(least[many], np.partition(about[many], size - top, axis=1)[:, size - top] * sure)
                over[many] = about[many] >= least[many, None]
            q, d = np.divmod(np.flatnonzero(over), size)
            points, tiles = single[q, d], d // TILE
            for tile, own in enumerate(rows):
                x = np.flatnonzero(tiles == tile)
                if len(own) and len(x):
                    asks, ask = np.unique(q[x], return_inverse=True)
                    docs, doc = np.unique(d[x], return_inverse=True)
                    points[x] += (has[np.ix_(own, asks)].T.astype(float) @ self.dense[np.ix_(own, docs)].astype(float))[ask, doc]
            good = points >= thresholds[q]
            q, points, ids = q[good], points[good], self.ids[d[good]]
            best = np.lexsort((ids, -points, q))
            q, points, ids = q[best], points[best], ids[best]
            best = np.arange(len(q)) - np.searchsorted(q, q) < top
            out.append((chunk.ids[lo + q[best]], ids[best], points[best]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def scores(self, term: np.ndarray, query: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """What is added up singly in the scores of all documents for each of so many queries, given as (place of a term, number
        of the query), by query; which queries have a row of the dense table; the rows to be multiplied for each tile."""
        size = len(self.ids)
        row = self.row[term]
        frequent = np.flatnonzero(row >= 0)
        asked = np.bincount(row[frequent], minlength=len(self.dense))
        width = np.minimum(TILE, size - np.arange(0, size, TILE))
        paying = asked[:, None] * self.tile_held >= np.maximum(1, FILLED * count * width)
        part, tile = np.nonzero((~paying & (self.tile_held > 0))[row[frequent]])
        rest, part = np.flatnonzero(row < 0), frequent[part]
        run = np.concatenate([self.run[term[rest]], self.run[term[part]] + tile])
        packs = np.concatenate([self.list_packs[term[rest]], self.packs[run[len(rest) :]]])
        of = np.concatenate([query[rest], query[part]])
        by = np.argsort(of, kind="stable")
        start, packs, of = self.pack_at[run[by]], packs[by], of[by]
        score = np.empty((count, size))
        cut = np.searchsorted(of, np.arange(0, count + TOGETHER, TOGETHER))
        for k, lo in enumerate(range(0, count, TOGETHER)):
            a, b, hi = cut[k], cut[k + 1], min(lo + TOGETHER, count)
            where = spread(start[a:b], packs[a:b])
            cell = self.pack_doc.take(where, axis=0)
            cell += np.repeat((of[a:b] - lo) * size, packs[a:b])[:, None]
            score[lo:hi] = np.bincount(cell.ravel(), self.pack_weight.take(where, axis=0).ravel(), (hi - lo) * size).reshape(-1, size)
        has = np.zeros((len(self.dense), count), np.float32)
        has[row[frequent], query[frequent]] = 1
        return score, has, [np.flatnonzero(x) for x in paying.T]

    def search(self, query_id: int, terms: np.ndarray, idf: np.ndarray, threshold: float, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that score the threshold or more, the best at most top, and their scores; scores of 0 and the query itself
        are left out. Best first, ties by id."""
        size, none = len(self.ids), (np.zeros(0, np.int64), np.zeros(0))
        if not size or not len(self.terms):
            return none
        if not self.by_block:
            self.lay_blocks()
        t = self.find(terms, idf)
        t = t[t >= 0]
        rows = self.long[t]
        short, rows = t[rows < 0], rows[rows >= 0]
        where = spread(self.at[short], self.n[short])
        score = np.bincount(self.doc[where], self.weight[where], self.blocks * BLOCK)
        own = self.ids == query_id
        bound = score.reshape(-1, BLOCK).max(axis=1) + self.block_most[rows].sum(axis=0)
        threshold = max(threshold, 1.0)
        ids, points = none
        at = 0
        while at < self.blocks:
            ahead = np.flatnonzero(bound[at : at + RUN + GAP] >= threshold)
            if not len(ahead):
                at += RUN + GAP
                continue
            pivot = at + int(ahead[0])
            gaps = np.flatnonzero(np.diff(ahead) > GAP + 1)
            end = min(at + int(ahead[gaps[0]] if len(gaps) else ahead[-1]) + 1, pivot + RUN)
            a, b = self.offset[rows, pivot].tolist(), self.offset[rows, end].tolist()
            lo, hi = pivot * BLOCK, min(end * BLOCK, size)
            total = score[lo:hi]
            if a:
                doc = np.concatenate([self.doc[x:y] for x, y in zip(a, b, strict=True)])
                doc -= np.uint16(lo)
                total = total + np.bincount(doc, np.concatenate([self.weight[x:y] for x, y in zip(a, b, strict=True)]), hi - lo)
            good = np.flatnonzero((total >= threshold) & ~own[lo:hi])
            if len(good):
                ids, points = np.append(ids, self.ids[lo:hi][good]), np.append(points, total[good])
                if len(points) > top:
                    best = np.lexsort((ids, -points))[:top]
                    ids, points = ids[best], points[best]
                if len(points) == top:
                    threshold = max(threshold, points.min())
            at = end
        best = np.lexsort((ids, -points))
        return ids[best], points[best]


#: The arrays of a chunk of queries.
CHUNK_KINDS = {"ids": "<i8", "sizes": "<i4", "terms": "<u8", "idf": "<f8", "own": "<i4"}


def chunk_row(ids: np.ndarray, terms: np.ndarray, idf: np.ndarray) -> tuple:
    """A chunk of queries from (id, term, idf of the term), each pair once: alike queries side by side."""
    order = np.lexsort((terms, ids))
    ids, terms = ids[order], terms[order]
    ids, first, sizes = np.unique(ids, return_index=True, return_counts=True)
    known, at, own = np.unique(terms, return_index=True, return_inverse=True)
    idf = idf[order][at]
    leads = np.empty(len(known), np.int64)
    leads[np.lexsort((known, -idf))] = np.arange(len(known))  # the larger, the more frequent
    by = np.lexsort((sizes, np.maximum.reduceat(leads[own], first)))
    return tuple(packed(x, kind) for x, kind in zip((ids[by], sizes[by], known, idf, own[spread(first[by], sizes[by])]), CHUNK_KINDS.values(), strict=True))


def chunks_of(spec: DataFrame, chunks: int) -> DataFrame:
    """The queries (doc_id, term, idf) in so many chunks, by hash of doc_id."""

    def made(rows: pa.Table) -> pa.Table:
        ids, terms, idf = (np.asarray(rows.column(c).combine_chunks()) for c in ("doc_id", "term", "idf"))
        row = chunk_row(ids, terms.view(U64), idf)
        return pa.table([rows.column("chunk")[:1].combine_chunks(), *(pa.array([x], pa.binary()) for x in row)], ["chunk", *CHUNK_KINDS])

    rows = spec.select(chunk_number("doc_id", chunks).alias("chunk"), "doc_id", "term", "idf")
    return rows.groupBy("chunk").applyInArrow(made, "chunk long, " + ", ".join(f"{c} binary" for c in CHUNK_KINDS))


def chunk_number(column: str, chunks: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(chunks))


#: Shards are numbered in so many groups by hash of their names.
GROUPS = 1 << 10


def shard_numbers(index: DataFrame) -> DataFrame:
    """(shard, number): numbers from 0 without gaps. Names are counted inside a group; only the groups' totals are counted in
    one task."""
    named = index.select("shard", F.pmod(F.xxhash64("shard"), F.lit(GROUPS)).alias("group"))
    earlier = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # at most GROUPS rows
    offsets = named.groupBy("group").count().select(F.col("group").alias("of"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    placed = named.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy("shard")) - 1)
    return materialize(placed.join(F.broadcast(offsets), F.col("group") == F.col("of")).select("shard", (F.col("before") + F.col("place")).cast("int").alias("number")), "shard-numbers")


def rows_in(path: str) -> Iterator[pa.RecordBatch]:
    """A table's rows, one at a time."""
    store, root = fs.FileSystem.from_uri(path)
    for info in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda x: x.path):
        if info.path.endswith(".parquet") and info.size:
            with store.open_input_file(info.path) as file:
                yield from pq.ParquetFile(file).iter_batches(1)


def search_shards(index: DataFrame, queries: str, mean: float, top: int, shards: int, home: bool) -> DataFrame:
    """(query_id, doc_id, points) of the index's shards for the chunks of queries at a path: of each chunk's home shards, or of
    the others. The root of the shards' number of them, those that follow a chunk's own number, are its home.

    Each shard reads the chunks one by one, so that they are neither copied by a shuffle nor held whole.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                number = batch.column("number")[k].as_py()
                shard = None
                for row in rows_in(queries):
                    if ((number - row.column("home")[0].as_py()) % shards < isqrt(shards)) != home:
                        continue
                    shard = shard or Shard({c: batch.column(c)[k].as_buffer() for c in ("ids", "sizes", "terms", "df", "docs", "counts")}, mean)
                    least = {x["query_id"]: float(x["least"]) for x in row.column("least")[0].as_py() or ()}
                    found = shard.search_all(Chunk({c: row.column(c)[0].as_buffer() for c in CHUNK_KINDS}, least), top)
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), pa.array(found[2].astype(np.int64))], ["query_id", "doc_id", "points"])

    return index.drop("documents", "words", "shard").mapInArrow(scan, "query_id long, doc_id long, points long")


def written(queries: DataFrame, name: str) -> str:
    """Where the queries' table now lies, in small row groups."""
    path = fresh_path(queries.sparkSession, name)
    queries.write.option("parquet.block.size", 8 << 20).parquet(path)
    return path


def top_documents(docs: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """query_id, rank, doc_id, score: the best other documents of docs (doc_id, text) for each of queries (doc_id, text).

    A query is the set of distinct words of its whole text (words [^\\x20\\x09-\\x0D]+, A-Z lower-cased); a word adds
    floor(1e6 * ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) + 0.5) points,
    score is points / 1e6. Ties go to the smaller doc_id. A query's own id and documents without a common word are left
    out. Null texts are empty and match nothing; rows with a null doc_id count in no statistic and are never found. Rows
    of one doc_id are found separately; as queries they are one, of all their words. Extra columns are ignored.
    """
    spark = docs.sparkSession
    plain = lambda rows: rows.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    index = index_shards(plain(docs))
    total, words, shards = index.select(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0)), F.count("*")).first()
    mean = words / total if words else 1.0
    spec = materialize(query_terms(plain(queries)).select("doc_id", F.explode("terms").alias("term")).distinct(), "query-terms")
    terms = spec.select("term").distinct()
    df = document_counts(index, terms, shards).join(terms, "term", "left_semi")
    idf = F.log(1 + (F.lit(float(total)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    spec = materialize(spec.join(df, "term").select("doc_id", "term", idf.alias("idf")), "query-weights")
    chunks = -(-spec.select("doc_id").distinct().count() // CHUNK) or 1
    asked = chunks_of(spec, chunks).withColumn("home", F.pmod(F.xxhash64("chunk"), F.lit(1 << 30)))
    first = written(asked.withColumn("least", F.lit(None).cast("array<struct<query_id: bigint, least: bigint>>")), "queries")
    index = index.join(shard_numbers(index), "shard")  # Spark broadcasts the numbers while their size allows it
    seen = materialize(search_shards(index, first, mean, top, max(1, shards), True), "home-results")
    order = Window.partitionBy("query_id").orderBy(F.col("points").desc(), "doc_id")
    least = seen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == top).select("query_id", F.col("points").alias("least"))
    least = least.groupBy(chunk_number("query_id", chunks).alias("of")).agg(F.collect_list(F.struct("query_id", "least")).alias("least"))
    asked = spark.read.parquet(first).drop("least")
    second = written(asked.join(least, F.col("chunk") == F.col("of"), "left").select(*asked.columns, "least"), "queries")
    found = seen.union(search_shards(index, second, mean, top, max(1, shards), False))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select("query_id", "rank", "doc_id", (F.col("points") / F.lit(float(SCALE))).alias("score"))
