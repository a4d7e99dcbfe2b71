"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels alone."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import materialize

#: The classifier is fitted on at most so many labelled rows, those of smallest hash, of at most so many bytes together.
TRAIN_ROWS, TRAIN_BYTES = 8_000, 20_000_000
LEAST_DOCS, LEAST_Z, WORDS_MOST = 3, 4.0, 4000
STEPS, RATE, SPARSITY, THRESHOLD = 250, 0.1, 2e-4, 0.3
#: A-Z lower-cased, sentence ends as line feeds, other ASCII but letters and digits as spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".!?\n" else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def sentences(text: str | None) -> list[set[bytes]]:
    """The distinct words of each sentence that has any."""
    return [s for s in (set(x.split()) for x in (text or "").encode().translate(_FOLD).split(b"\n")) if s]


class Model:
    """Word weights and a bias: a sentence scores sigmoid(bias + its words' weights), a document 1 - product(1 - score).

    All sentences without known words count as one, so that a document's length alone never makes it toxic.
    """

    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias = weights, bias

    def logit(self, words: set[bytes]) -> float:
        return self.bias + sum(map(self.weights.get, self.weights.keys() & words))

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score and, for each sentence with known words, its place in characters and its score."""
        folded = (text or "").encode().translate(_FOLD)
        known = self.weights.keys() & set(folded.split())
        parts = folded.split(b"\n")
        base = float(np.log1p(np.exp(self.bias)))  # -log(1 - score) of a sentence without known words
        total, found, at = 0.0, [], 0
        if not known:
            return float(-np.expm1(-base)), []
        raw, seen, chars, plain = (text or "").encode(), 0, 0, False
        for part in parts:
            words = set(part.split())
            if words:
                hit = known & words
                plain |= not hit
                if hit:
                    z = self.bias + sum(map(self.weights.get, hit))
                    total += float(np.logaddexp(0.0, z))
                    chars += len(raw[seen:at].decode())
                    end = at + len(part)
                    length = len(raw[at:end].decode())
                    found.append((chars, chars + length, float(1 / (1 + np.exp(-z)))))
                    seen, chars = end, chars + length
            at += len(part) + 1
        return float(-np.expm1(-total - base * plain)), found


def fit(texts: list[str | None], labels: list[int]) -> Model:
    """Minimise the cross-entropy of the noisy-or over documents; words are chosen by their document counts in these rows.

    Without both labels the model has no words and scores the rate of the labels.
    """
    y = np.array(labels, float)
    rate = min(max(float(y.mean()) if len(y) else 0.0, 1e-3), 1 - 1e-3)
    if len(set(labels)) < 2:
        return Model({}, float(np.log(rate / (1 - rate))))
    every, toxic = Counter(), Counter()
    for text, label in zip(texts, labels, strict=True):
        words = set().union(*sentences(text))
        every.update(words)
        toxic.update(words if label else ())
    n, k = len(y), y.sum()

    def z(word: bytes) -> float:
        share = every[word] / n
        return (toxic[word] / k - (every[word] - toxic[word]) / (n - k)) / max(1e-9, (share * (1 - share) * (1 / k + 1 / (n - k))) ** 0.5)

    scored = sorted(((z(w), w) for w, c in every.items() if c >= LEAST_DOCS), reverse=True)
    vocabulary = {w: i for i, w in enumerate(w for s, w in scored[:WORDS_MOST] if s >= LEAST_Z)}
    del every, toxic, scored
    sentence, word, of = array("q"), array("q"), array("q")  # texts are split again, so that only these are held
    for d, text in enumerate(texts):
        known = [vocabulary.keys() & words for words in sentences(text)]
        for words in [*filter(None, known), *([set()] if not all(known) or not known else [])]:
            for i in sorted(vocabulary[w] for w in words):
                sentence.append(len(of))
                word.append(i)
            of.append(d)
    sentence, word, of = (np.frombuffer(x, np.int64) if len(x) else np.zeros(0, np.int64) for x in (sentence, word, of))
    w, bias = np.zeros(len(vocabulary)), -6.0
    moments = np.zeros((2, len(w) + 1))
    for step in range(1, STEPS + 1):
        zs = bias + np.bincount(sentence, w[word], len(of))
        p = 1 / (1 + np.exp(-zs))
        miss = np.bincount(of, np.logaddexp(0, zs), n)  # -log of the chance that no sentence is toxic
        pull = np.where(y == 1, -np.exp(-miss) / np.maximum(-np.expm1(-miss), 1e-9), 1.0)
        g = p * pull[of] / n
        grad = np.append(np.bincount(word, g[sentence], len(w)), g.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.99 * moments[1] + 0.01 * grad**2
        move = RATE * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * SPARSITY * 10, 0)
    return Model({x: float(w[i]) for x, i in vocabulary.items() if w[i]}, float(bias))


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    texts = docs.select("doc_id", F.col("text").cast("string"))
    got = materialize(texts.join(F.broadcast(rows), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")), "labelled")
    sizes = got.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    left, ids = TRAIN_BYTES, []
    for r in sizes:  # a row that does not fit goes, not those after it
        if r["size"] <= left:
            left -= r["size"]
            ids.append((r.doc_id,))
    ids = docs.sparkSession.createDataFrame(ids, "id long")  # at most TRAIN_ROWS rows
    got = got.join(F.broadcast(ids), F.col("doc_id") == F.col("id"), "left_semi").orderBy("doc_id").toPandas()
    return fit(got["text"].tolist(), got["toxic"].astype(int).tolist())


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, offending (start, end, score of sentences with known words) for every row of docs (doc_id, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans = zip(*map(model.score, batch.column(1).to_pylist()), strict=True) if batch.num_rows else ((), ())
            spans = [[{"start": a, "end": b, "score": s} for a, b, s in x] for x in spans]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "offending"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, "doc_id long, score double, offending array<struct<start long, end long, score double>>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_offending, worst_start, worst_end for every row of docs (doc_id, text).

    Null, empty and blank texts score as one sentence without known words. Sentences end at . ! ? and line ends; places are
    in characters. Documents with several labels count as toxic if any is. A null doc_id is scored and not held out.
    """
    worst = F.expr("aggregate(offending, cast(null as struct<start: bigint, end: bigint, score: double>), (a, x) -> if(a is null or x.score > a.score, x, a))")
    out = score_documents(docs, train(docs, labels)).withColumn("worst", worst)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.expr("size(filter(offending, x -> x.score >= 0.5))").alias("n_offending"), F.col("worst.start").alias("worst_start"), F.col("worst.end").alias("worst_end"))


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted toxic go; each row is judged by its own text, so nothing is joined."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text")).to_pylist()
            yield batch.filter(pa.array([model.score(t)[0] < THRESHOLD for t in texts], pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
