"""Chunks of queries over a shard of the search index."""

import numpy as np
import pytest
import quantloom.llm.search as module


def corpus(rng, count, top_idf):
    """A shard of random documents, some alike and some ids twice, and the scores of each against each."""
    terms = [np.unique(rng.zipf(1.3, rng.randint(0, 40)).clip(1, 60)).astype(np.uint64) for _ in range(count)]
    counts = [rng.randint(1, 5, len(x)) for x in terms]
    for k in range(0, count, 9):  # ties
        terms[k], counts[k] = terms[0], counts[0]
    sizes, ids = [int(c.sum()) for c in counts], rng.permutation(1000)[:count].tolist()
    ids[5] = ids[6]
    idf = rng.rand(61) * top_idf
    shard = module.Shard(dict(zip(module.INDEX, module.shard_row(ids, sizes, terms, counts), strict=True)), 20.0)
    weights = np.zeros((count, 61))
    for row, own, n, size in zip(weights, terms, counts, sizes, strict=True):
        row[own.astype(int)] = module.weight(idf[own.astype(int)], n * 2.2 / (n + 1.2 * (0.25 + 0.75 * (size / 20.0))))
    return ids, terms, idf, shard, weights


def chunk_of(ids, terms, idf, least):
    row = module.chunk_row(np.repeat(ids, [len(x) for x in terms]), np.concatenate(terms), idf[np.concatenate(terms).astype(int)])
    return module.Chunk(dict(zip(module.CHUNK_KINDS, row, strict=True)), least)


@pytest.mark.parametrize("tile,batch,filled,dense,top_idf", [(8, 16, 0.01, 1 << 26, 3), (16, 7, 0.2, 4 * 150 * 5, 3), (1024, 128, 0.006, 1 << 26, 3), (8, 16, 0.01, 1 << 26, 15), (8, 16, 2.0, 4, 3)])
def test_a_chunk_of_queries_finds_what_each_query_scores_best(monkeypatch, tile, batch, filled, dense, top_idf):
    for name, value in (("TILE", tile), ("BATCH", batch), ("FILLED", filled), ("DENSE", dense), ("TOGETHER", 3)):
        monkeypatch.setattr(module, name, value)
    rng = np.random.RandomState(4)
    ids, terms, idf, shard, weights = corpus(rng, 150, top_idf)
    asks = {int(i): terms[k] for k, i in enumerate(ids) if k % 2 and len(terms[k])} | {5000: np.arange(1, 60).astype(np.uint64), 5001: np.array([77], np.uint64)}
    asked = list(asks)
    scores = {i: sorted((-int(weights[k][asks[i][asks[i] < 61].astype(int)].sum()), ids[k]) for k in range(150) if ids[k] != i) for i in asked}
    scores = {i: [x for x in found if x[0] < 0] for i, found in scores.items()}
    least = {i: float(-found[9][0]) if len(found) > 9 else 0.0 for i, found in scores.items()}
    known = np.append(idf, np.zeros(30))
    for wanted in ({}, least, {i: float(-scores[i][0][0]) for i in asked if scores[i]}, dict.fromkeys(asked, 1e12)):
        for part in (asked, asked[:3], asked[:30]):  # three go one by one
            got = shard.search_all(chunk_of(part, [asks[i] for i in part], known, wanted), 10)
            for i in part:
                own = got[0] == i
                assert list(zip((-got[2][own]).tolist(), got[1][own].tolist(), strict=True)) == [x for x in scores[i] if -x[0] >= wanted.get(i, 0.0)][:10]


def test_a_shard_looks_up_and_sums_many_queries_together(monkeypatch):
    """One lookup for a chunk and one sum for some queries, not one for each query."""
    rng = np.random.RandomState(4)
    ids, terms, idf, shard, _ = corpus(rng, 150, 3)
    done = {"find": 0, "search": 0, "bincount": 0}
    for name in ("find", "search"):
        monkeypatch.setattr(module.Shard, name, lambda *a, f=getattr(module.Shard, name), name=name: (done.update({name: done[name] + 1}), f(*a))[1])
    asked = [k for k in range(150) if len(terms[k]) and k != 5]
    counted = np.bincount
    chunk = chunk_of([ids[k] for k in asked], [terms[k] for k in asked], idf, {})
    shard.search_all(chunk, 10)
    monkeypatch.setattr(np, "bincount", lambda *a, **b: (done.update(bincount=done["bincount"] + 1), counted(*a, **b))[1])
    shard.search_all(chunk, 10)
    assert done["find"] == 2 and done["search"] == 0 and done["bincount"] < len(asked) / 4


def test_counts_of_the_asked_terms_are_whole_with_a_narrow_map(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k % 50 + 1))) for k in range(200)], "doc_id long, text string").repartition(3)
    rows = lambda: [tuple(r) for r in module.top_documents(docs, docs.where("doc_id % 9 = 0"), 5).orderBy("query_id", "rank").collect()]
    whole = rows()
    for name, value in (("MAP_BITS", 1 << 15), ("CHUNK", 2), ("SHARD", 30)):
        monkeypatch.setattr(module, name, value)
    assert rows() == whole and len(whole) == 115
