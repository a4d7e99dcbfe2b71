"""Columns of any name beside those that an operator reads, and folds of the suffix order over many ranges."""

import random

from pyspark.sql import functions as F

CLASH = "doc_id long, text string, source string, spans string, _key string, copies int, _id int, _size int, _source int, _row string, _n int, key int, n_chars long, size int, lang string, unit_no int, digest string, region int, block int, component_id int"


def clashing(spark):
    rnd = random.Random(2)
    shared = " ".join(f"word{rnd.randrange(99)}" for _ in range(120))
    texts = [f"own {k} {rnd.random()} {shared if k % 3 == 0 else ''} tail {rnd.random()}" for k in range(40)] + [None, ""]
    return spark.createDataFrame([(k, t, f"s{k % 3}", "a", "b", 1, 2, 3, 4, "r", 5, 6, len(t or ""), 7, "en", 8, "d", 9, 10, 11) for k, t in enumerate(texts)], CLASH)


def test_suffix_dedup_and_its_stage(spark):
    from quantloom.llm.suffix_dedup import suffix_dedup, suffix_dedup_stage

    docs = clashing(spark)
    plain = docs.select("doc_id", "text")
    assert sorted(map(tuple, suffix_dedup(docs).collect())) == sorted(map(tuple, suffix_dedup(plain).collect()))
    out = suffix_dedup_stage(spark, docs, "")
    assert out.columns == docs.columns and out.count() == docs.count()
    small = {r.doc_id: r.text for r in suffix_dedup_stage(spark, plain, "").collect()}
    got = out.collect()
    assert {r.doc_id: r.text for r in got} == small and all(r.n_chars == len(r.text) for r in got if r.text is not None)
    assert {(r.spans, r._key, r._row, r.size) for r in got} == {("a", "b", "r", 7)}


def test_mix_stage(spark):
    from quantloom.llm.mixing import mix_stage

    docs = clashing(spark)
    out = mix_stage(spark, docs, "")
    assert out.columns == docs.columns
    want = mix_stage(spark, docs.select("doc_id", "text", "source"), "")
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in want.collect())


def test_other_stages_and_operators(spark):
    from quantloom.llm.fingerprints import fingerprints
    from quantloom.llm.line_dedup import line_dedup
    from quantloom.llm.near_dedup import near_dedup_stage, near_duplicates
    from quantloom.llm.packing import packed_documents

    docs = clashing(spark)
    plain = docs.select("doc_id", "text")
    for f in (near_duplicates, packed_documents, line_dedup, fingerprints):
        assert f(docs).drop("sequence_id", "offset", "removed").exceptAll(f(plain).drop("sequence_id", "offset", "removed")).count() == 0, f
    assert near_dedup_stage(spark, docs, "").columns == docs.columns


def test_suffix_order_folds_ranges(spark, monkeypatch):
    """Ranges of a few strings, folded three at a time over several levels, share the classes that all strings have."""
    from quantloom.llm import suffix_order as order

    monkeypatch.setattr(order, "PART", 4)
    monkeypatch.setattr(order, "FAN", 3)
    rnd = random.Random(4)
    strings = {bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 14))) for _ in range(150)}
    rows = spark.createDataFrame([(s,) for s in strings], "s binary").repartition(3)
    got = order.suffix_order(rows, "folds").collect()
    digests = {bytes(r[1]): bytes(r[0]) for r in rows.select("s", F.unhex(F.md5("s")).alias("d")).select("d", "s").collect()}
    found = {bytes(r.digest): list(zip(r.depths, r.ranks, strict=True)) for r in got}
    classes = {}
    for s in strings:
        path = found[digests[s]]
        for n in range(1, len(s) + 1):
            rank = next(x for d, x in path if d >= n)
            classes.setdefault((n, s[:n]), set()).add((n, rank))
    assert all(len(x) == 1 for x in classes.values()) and len({next(iter(x)) for x in classes.values()}) == len(classes)


def test_fingerprints_of_short_texts_keep_likeness(spark):
    """The first code points are cut finely: a text of one short paragraph shares units with its half-edited self."""
    import re

    from quantloom.llm.fingerprints import fingerprints

    rnd = random.Random(6)
    texts = ["".join(rnd.choice("abcdefgh éß") for _ in range(n)) for n in (10, 70, 100, 127, 128, 129, 200, 255, 700)] + ["short\nlines\n" * 30, "", None]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), unit=128, head=128).collect()}
    units = lambda t: set(re.findall("[^\n]{1,32}", t[:128])) | set(re.findall("[^\n]{1,128}", t[128:]))
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert abs(got[i].near_edited - like(units(t), units(edited))) < 1e-12 and abs(got[i].near_next - like(units(t), units(after))) < 1e-12
        assert got[i].near_edited > 0 or len(t) < 64
