"""Near-duplicates, lines and repeated strings against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from quantloom.llm.line_dedup import line_removals
from quantloom.llm.near_dedup import near_dedup_stage, near_duplicates
from quantloom.llm.suffix_dedup import suffix_dedup, suffix_dedup_stage

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()) + str(rng.randrange(40)) for _ in range(n)]


def corpus(seed=3):
    rng = random.Random(seed)
    texts = [None, "", "  \n ", "One", "one", "Two words", "two\twords", "é É", "a a a a a a"]
    base = words(rng, 220)
    for k in range(40):  # a chain of ever further copies
        own = list(base)
        for _ in range(k):
            own[rng.randrange(len(own))] = words(rng, 1)[0]
        texts.append(" ".join(own))
    texts += [" ".join(base).upper()] * 3
    for _ in range(25):
        texts.append(" ".join(words(rng, rng.randrange(1, 120))))
    passage = " ".join(words(rng, 90))
    for _ in range(6):
        texts.append(" ".join(words(rng, 30)) + "\n" + passage + "\n" + " ".join(words(rng, 30)))
    texts.append("ab" * 600)
    texts.append(passage + " x " + passage)
    texts.append(" ".join(words(rng, 20_000)))
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[12]]  # a repeated row


def shingles(text, n):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def brute_components(rows, n, percent):
    sets = {i: shingles(t, n) for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("n", [2, 5])
def test_components_equal_brute_force(spark, n):
    rows = corpus()
    want = brute_components(rows, n, 80)
    got = near_duplicates(spark.createDataFrame(rows, DOCS), n, 80).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_hot_group_beyond_a_region(spark, monkeypatch):
    import quantloom.llm.near_dedup as module

    monkeypatch.setattr(module, "REGION", 8)
    rows = corpus(11)
    want = brute_components(rows, 2, 80)
    got = near_duplicates(spark.createDataFrame(rows, DOCS), 2, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_duplicates_edges(spark):
    empty = near_duplicates(spark.createDataFrame([], DOCS))
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "kept"] and empty.count() == 0
    clash = spark.createDataFrame([(1, "a b c d e f", 5, "x"), (2, "a b c d e f", 6, "y"), (None, "a b c d e f", 7, None)], "doc_id long, text string, rep long, region string")
    got = {r.doc_id: (r.component_id, r.kept) for r in near_duplicates(clash).collect()}
    assert got == {1: (1, True), 2: (1, False), None: (None, True)}
    assert sorted(r.rep for r in near_dedup_stage(spark, clash, "").collect()) == [5, 7]


def brute_removed(rows, least):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for (i, *_), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - least + 1):
            if seen[t[k : k + least]] > 1:
                gone[k : k + least] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("least", "gram"), [(400, 128), (64, 24), (20, 20)])
def test_repeated_strings_equal_brute_force(spark, least, gram):
    rows = [r for r in corpus(5) if len(r[1] or "") < 50_000]
    got = suffix_dedup(spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "key"), least, gram).collect()
    assert sorted(map(tuple, got)) == brute_removed(rows, least)


def test_repeated_strings_edges(spark):
    assert suffix_dedup(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, None, "", "", 0), (2, "é" * 500, "", "", 500), (3, "x" + "é" * 300, "", "", 301)]
    assert sorted(map(tuple, suffix_dedup(spark.createDataFrame(rows, DOCS)).collect())) == brute_removed(rows, 400)
    out = {r.doc_id: r for r in suffix_dedup_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert out[1].text is None and out[2].text == "" and out[3].text == "x" and out[3].n_chars == 1


def test_line_dedup_equals_brute_force(spark):
    rows = corpus(7)
    seen, want = {}, Counter()
    for i, t, *_ in sorted(rows):
        at = 0
        for k, line in enumerate((t or "").split("\n")):
            plain = re.sub(r"[\x09-\x0D ]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), line)).strip(" ")
            if len(plain) >= 20:
                first = seen.setdefault(plain, (i, k))
                if first != (i, k):
                    want[(i, k, at, len(line), *first)] += 1
            at += len(line) + 1
    got = line_removals(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter(map(tuple, got)) == want and want
    assert line_removals(spark.createDataFrame([], DOCS)).count() == 0


def test_texts_are_cut_in_small_pieces_and_carried_once(spark, monkeypatch):
    """A task holds few rows of a large batch as Python objects, and the stage's shuffle has each text once."""
    import pyarrow as pa

    from quantloom.llm import spans, suffix_dedup as module

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], ["n"])
    assert max(p.num_rows for p in spans.pieces(iter([batch]))) <= 128 and sum(p.num_rows for p in spans.pieces(iter([batch]))) == 1000
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    column = pa.array([[{"a": 9, "b": 12}], [{"a": 5, "b": 9}, {"a": 0, "b": 2}, {"a": 1, "b": 3}], None, []], kind)
    assert [(a.tolist(), b.tolist()) for a, b in spans.runs_of(column.slice(1))] == [([0, 5], [3, 9]), ([], []), ([], [])]
    seen = []
    plain = module.cut_texts
    monkeypatch.setattr(module, "cut_texts", lambda rows, columns: seen.append(rows) or plain(rows, columns))
    docs = spark.createDataFrame([(k, "word " * 90 + str(k), "en", "s", 1) for k in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    out = module.suffix_dedup_stage(spark, docs, "")
    assert seen[0].schema["_row"].dataType.names == ["doc_id", "lang", "source"]
    assert out.columns == docs.columns and {(r.doc_id, r.lang, r.source, r.n_chars == len(r.text)) for r in out.collect()} == {(k, "en", "s", True) for k in range(3)}
