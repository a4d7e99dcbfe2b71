"""Cases where an operator did less than its whole job."""

import re

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_fingerprints_of_one_paragraph_share_units_with_the_edit(spark, tmp_path):
    from quantloom.llm.queries import QUERIES

    texts = {i: "".join(chr(97 + (k * k + i * k) % 26) for k in range(n)) for i, n in ((1, 300), (2, 400), (3, 510))}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    units = lambda t: set(re.findall(r"[^\n]{1,128}", t))
    for r in QUERIES["op2_iblt_fingerprints"](spark, str(tmp_path)).collect():
        t, after = texts[r.doc_id], texts[r.doc_id - 1 or 3]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert r.near_edited == pytest.approx(len(units(t) & units(edited)) / len(units(t) | units(edited))) and r.near_edited > 0


def test_fingerprints_retry_failed_blocks_with_another_hash(spark):
    from quantloom.llm.fingerprints import KEY_SPACE, WIDTH, compared

    keys = spark.range(20_000).selectExpr("concat('line ', id) as u").selectExpr("u", f"xxhash64(u) & {KEY_SPACE - 1}L as k")
    alike = keys.groupBy(keys.k.bitwiseAND(WIDTH**3 - 1).alias("low"), (keys.k / 2**57).cast("int").alias("high")).agg({"u": "collect_list"}).where("size(`collect_list(u)`) > 1").first()[2]
    rows = [(2, "\n".join(alike[:2])), (1, "")]  # the two digests share all cells, and the block when it is halved
    got = {r.doc_id: r for r in compared(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2].near_next == 0.0 and got[2].near_next_direct == 0
    many = "\n".join(f"row {k}" for k in range(3000))
    r = compared(spark.createDataFrame([(2, many), (1, many.replace("row 1", "now 1"))], "doc_id long, text string")).where("doc_id = 2").first()
    changed = sum(str(k).startswith("1") for k in range(3000))
    assert r.near_next == pytest.approx((3000 - changed) / (3000 + changed)) and r.near_next_direct == 0


def test_stage_cuts_passages_of_short_words(spark):
    from quantloom.llm.suffix_dedup import suffix_dedup_stage

    passage = " ".join(f"{'abcdefghij'[k % 10]}{k}" for k in range(51))  # 51 words, under 256 bytes
    shorter = " ".join(f"{'klmnopqrst'[k % 10]}{k}" for k in range(50))
    texts = {1: f"One begins\n{passage} and ends.", 2: f"É {passage}", 3: f"x {shorter} y", 4: f"{shorter} z", 5: "Z" + passage, 6: None, 7: ""}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    got = {r.doc_id: r.text for r in suffix_dedup_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert len(passage) < 256 and got == texts | {1: "One begins\n and ends.", 2: "É "}


def test_length_alone_is_not_toxic():
    from quantloom.llm.toxicity import THRESHOLD, fit

    texts = [f"plain words {k}. more of them." + (" vile thing." if k % 5 == 0 else "") for k in range(300)]
    model = fit(texts, [int(k % 5 == 0) for k in range(300)])
    assert model.score("A clean sentence. " * 40_000)[0] < THRESHOLD
    assert model.score("A clean sentence. " * 40_000 + "A vile one.")[0] >= THRESHOLD


def test_long_rows_enter_the_fit(spark, monkeypatch):
    import quantloom.llm.toxicity as module

    seen = []
    monkeypatch.setattr(module, "fit", lambda texts, labels: seen.append(sorted(map(len, texts))))
    docs = spark.createDataFrame([(i, "x" * n) for i, n in ((0, 10), (1, 60_000), (3, 20), (4, 70_000), (5, 30))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, toxic int")
    train = {i for i, in docs.where(~module.held_out()).select("doc_id").collect()}
    want = sorted(n for i, n in ((0, 10), (1, 60_000), (3, 20), (4, 70_000), (5, 30)) if i in train)
    module.train(docs, labels)
    monkeypatch.setattr(module, "TRAIN_BYTES", 60_100)
    module.train(docs, labels)
    assert seen[0] == want and want[-1] >= 60_000 and sum(seen[1]) <= 60_100 and len(seen[1]) >= len(want) - 2


def test_lines_are_cut_from_texts(spark):
    from quantloom.llm.line_dedup import without_repeated_lines

    rows = [(1, "Go\n\nstay here a while longer\nb"), (2, "go \nnew\nSTAY here a while  longer\n\nb"), (3, None), (None, "new\nold"), (None, "other\nnew"), (4, "new")]
    got = sorted((str(r.doc_id), str(r.text)) for r in without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("1", "Go\n\nstay here a while longer\nb"), ("2", "new\n"), ("3", "None"), ("None", "old"), ("None", "other"), ("4", "")])
    got = {r.doc_id: r.text for r in without_repeated_lines(spark.createDataFrame(rows[:2], "doc_id long, text string"), 20).collect()}
    assert got[2] == "go \nnew\n\nb"


def test_guests_meet_each_row_once_in_groups_of_two_blocks(spark, monkeypatch):
    from collections import Counter
    from itertools import combinations

    import quantloom.llm.near_dedup as module

    monkeypatch.setattr(module, "REGION", 8)
    rows = [(5, k % 6, 6, k, 10, 0, 0, 0, 0, 100 if k % 3 == 0 else k) for k in range(48)]  # 16 rows in the largest component
    made = module.with_guests(spark.createDataFrame(rows, "region long, block int, parts int, rep long, n long, b0 long, b1 long, b2 long, b3 long, comp long"))
    met, groups = Counter(), made.toPandas().sort_values(["region", "block", "rep"])
    for _, group in groups.groupby(["region", "block"]):
        import pyarrow as pa

        assert len(group) <= 3 * module.REGION
        t = pa.Table.from_pandas(group, preserve_index=False)
        i, j, _ = module.passing(t, 0.8, apart=True)
        rep = t.column("rep").to_pylist()
        met.update(tuple(sorted((rep[x], rep[y]))) for x, y in zip(i, j, strict=True))
    comp = {r[3]: r[9] for r in rows}
    assert met == Counter(p for p in combinations(range(48), 2) if comp[p[0]] != comp[p[1]])


def test_sparse_links_in_a_dealt_region(spark, monkeypatch):
    import quantloom.llm.near_dedup as module

    # All share a long beginning, so that every tree has one region; copies are few and lie in other blocks.
    monkeypatch.setattr(module, "REGION", 4)
    monkeypatch.setattr(module, "minhash", lambda x: __import__("numpy").full(module.SLOTS, 7, "uint32"))
    texts = {k: " ".join(f"w{k}x{i}" for i in range(40)) for k in range(40)}
    texts |= {100 + k: texts[k] + " end" for k in range(0, 40, 5)}
    got = module.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 2, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: k % 100 for k in texts}


def test_split_regions_get_further_trees(spark, monkeypatch):
    import numpy as np
    import quantloom.llm.near_dedup as module

    monkeypatch.setattr(module, "REGION", 2)
    shared = np.arange(module.SLOTS, dtype=np.uint32)
    signs = [shared.copy() for _ in range(6)]
    for k, s in enumerate(signs):  # each differs in the last hash of every tree of the first 16, in few slots in all
        s[np.arange(module.TREES) * module.MAX_DEPTH + 3] += 1000 * (k + 1)
    rows = [(k, 50, s.tobytes()) for k, s in enumerate(signs)]
    made = module.forest_regions(spark.createDataFrame(rows, "rep long, n long, signature binary"))
    met = made.groupBy("region").count().where("count > 1").count()
    assert met > 0


def test_long_white_space_is_packed(spark):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from quantloom.llm.packing import packed_documents

    texts = [" " * 1_000_000, "\n" * 1_000_000, "a" + " " * 3_999 + "b", "a" + " \n" * 2_000 + "b", ("word" + " " * 5_000) * 3, "\x85" * 5_000]
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {(r.doc_id, r.start): r for r in packed_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        ids, at = np.array([*coder.encode(text, add_special_tokens=False).ids, 2], "<u4"), 0
        while at < len(ids):
            r = got.pop((i, at))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
    assert not got


def test_lines_and_paragraphs_are_removed_with_their_places(spark):
    from quantloom.llm.line_dedup import line_dedup

    rows = [(1, "Go\n\nstay here\nb"), (2, "go \nnew\nSTAY  here\n\nb"), (3, None), (None, "new\nold"), (None, "new\nold"), (4, ""), (5, "b\nx")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, removed string, key int")
    got = sorted(((r.doc_id or 0, r.n_removed, r.chars_removed, r.text, [tuple(x) for x in r.removed]) for r in line_dedup(docs).collect()), key=str)
    gone = [(0, 0, 3, 1, 0), (2, 8, 10, 1, 2), (4, 20, 1, 1, 3)]
    want = [(1, 0, 0, "Go\n\nstay here\nb", []), (2, 3, 14, "new\n", gone), (3, 0, 0, None, []), (4, 0, 0, "", []), (5, 1, 1, "x", [(0, 0, 1, 1, 3)])]
    want += [(0, 1, 3, "old", [(0, 0, 3, 2, 1)])] * 2
    assert got == sorted(want, key=str)
    long = "one\ntwo"
    docs = spark.createDataFrame([(1, f"{long}\n \n\nend"), (2, f"start\n\nOne\ntwo"), (3, "two")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup(docs, kind="paragraph").collect()} == {1: f"{long}\n \n\nend", 2: "start", 3: "two"}
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_of_two_letters_in_thues_order_differ():
    import numpy as np
    from quantloom.llm.common import HASH_A

    word = np.array([97 + bin(k).count("1") % 2 for k in range(2048)], np.uint8)
    hashed = lambda x: int(HASH_A.ranges(HASH_A.prefix(x), np.array([0]), np.array([len(x)]))[0])
    for n in (1024, 2048):
        assert hashed(word[:n]) != hashed(195 - word[:n])
    text = np.frombuffer(b"abcabcabcdabc" * 3000, np.uint8)  # longer than a tile
    prefix = HASH_A.prefix(text)
    got = {}
    for k, h in enumerate(HASH_A.windows(prefix, 7).tolist()):
        assert got.setdefault(text[k : k + 7].tobytes(), h) == h
    assert len(set(got.values())) == len(got)


def test_block_max_search_is_exact_at_any_threshold(monkeypatch):
    import numpy as np
    import quantloom.llm.search as module

    for name, value in (("BLOCK", 4), ("LONG", 5), ("GAP", 1), ("RUN", 3)):
        monkeypatch.setattr(module, name, value)
    rng = np.random.RandomState(3)
    terms = [np.unique(rng.zipf(1.3, rng.randint(0, 40)).clip(1, 60)).astype(np.uint64) for _ in range(150)]
    counts = [rng.randint(1, 5, len(x)) for x in terms]
    sizes, ids = [int(c.sum()) for c in counts], rng.permutation(1000)[:150].tolist()
    row = module.shard_row(ids, sizes, terms, counts)
    shard = module.Shard(dict(zip(module.INDEX, row, strict=True)), 20.0)
    idf = rng.rand(61) * 3
    for k in range(150):
        scores = {}
        for i, size, own, n in zip(ids, sizes, terms, counts, strict=True):
            both = [(t, c) for t, c in zip(own.tolist(), n.tolist(), strict=True) if t in terms[k]]
            scores[i] = sum(int(module.weight(idf[t], c * 2.2 / (c + 1.2 * (0.25 + 0.75 * (size / 20.0))))) for t, c in both)
        best = sorted(((-s, i) for i, s in scores.items() if s > 0 and i != ids[k]))
        for threshold in (0.0, float(-best[9][0]) if len(best) > 9 else 1.0, float(-best[0][0]) if best else 5.0, 1e12):
            found, points = shard.search(ids[k], terms[k], idf[terms[k].astype(int)], threshold, 10)
            want = [x for x in best if -x[0] >= threshold][:10]
            assert list(zip((-points).tolist(), found.tolist(), strict=True)) == want


def test_search_over_many_shards(spark, monkeypatch):
    import random

    import quantloom.llm.search as module

    rng = random.Random(9)
    texts = [(k, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(0, 60)))) for k in range(300)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in [*texts, (None, "w1"), (400, None)]], "doc_id long, text string, shard int, term string").repartition(3)
    rows = lambda: [tuple(r) for r in module.top_documents(docs, docs.where("doc_id % 7 = 0"), 5).orderBy("query_id", "rank").collect()]
    whole = rows()
    monkeypatch.setattr(module, "SHARD", 20)
    assert rows() == whole and len(whole) > 150
    again = docs.where("doc_id = 7").union(docs.where("doc_id = 7"))
    assert [tuple(r) for r in module.top_documents(docs, again, 5).orderBy("rank").collect()] == [r for r in whole if r[0] == 7]


def test_paths_tell_equal_prefixes_across_parts():
    import random

    import numpy as np
    from quantloom.llm.suffix_order import at_depth, carried, common, paths

    rng = random.Random(5)
    for _ in range(150):
        strings = sorted({"".join(rng.choices("ab", k=rng.randrange(1, 9))).encode() for _ in range(rng.randrange(1, 40))})
        cuts = sorted(rng.sample(range(len(strings) + 1), rng.randrange(0, min(6, len(strings)))))
        rows = [(sum(c <= k for c in cuts), s) for k, s in enumerate(strings)]
        placed = [(p, sum(1 for q, t in rows if q == p and t < s), s) for p, s in rows]
        ends = {}
        for part, s, path in paths(iter(placed), {}):
            ends.setdefault(part, [part, s, s, path])[2:] = [s, list(path)]
        begin = carried([tuple(x) for x in ends.values()])
        got = {s: list(path) for _, s, path in paths(iter(placed), begin)}
        assert len(got) == len(strings)
        rank = lambda s, d: int(at_depth(np.array([x for x, _ in got[s]]), np.array([x for _, x in got[s]]), np.array([d]))[0])  # noqa: E731, B023
        for a in strings:
            assert rank(a, 0) == -1 and got[a][-1][0] == len(a)
            for b in strings:
                for d in range(1, min(len(a), len(b)) + 1):
                    assert (rank(a, d) == rank(b, d)) == (common(a, b) >= d)


def test_suffix_order_in_spark(spark):
    from quantloom.llm.suffix_order import suffix_order

    texts = [f"{'x' * (k % 7)}{k % 5}{k}" for k in range(400)] + [""]
    rows = spark.createDataFrame([(t.encode(),) for t in texts * 2], "s binary").repartition(5)
    got = suffix_order(rows, "test").collect()
    assert len(got) == 400 and all(list(r.depths) == sorted(set(r.depths)) and len(r.depths) == len(r.ranks) for r in got)
    first = {}
    for r in got:
        first.setdefault(r.ranks[0], set()).add(bytes(r.digest))
    assert len(first) == 1 + len({t[0] for t in texts if t and t[0] != "x"})
    assert suffix_order(rows.where("false"), "test").count() == 0


def test_repeats_in_thues_order(spark):
    from quantloom.llm.suffix_dedup import suffix_dedup
    from tests.llm.test_dedup import brute_removed

    word = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word[:1024], "", "", 0), (2, other[:1024], "", "", 0), (3, "c" + word[100:900], "", "", 0), (4, "ab" * 300 + "c" + "ab" * 210, "", "", 0), (5, "a" * 900, "", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for least, gram in ((400, 128), (24, 8)):
        assert sorted(map(tuple, suffix_dedup(docs, least, gram).collect())) == brute_removed(rows, least)


def test_components_in_one_task_and_in_rounds(spark, monkeypatch):
    import random

    import quantloom.llm.common as module

    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5000 + k) for k in range(1, 40)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {x: root(x) for x in parent if root(x) != x}
    table = spark.createDataFrame(edges, "a long, b long").repartition(6)
    for most in (1 << 20, 60):
        monkeypatch.setattr(module, "LOCAL_EDGES", most)
        got = module.components(table).collect()
        assert {r.node: r.component for r in got if r.node != r.component} == want and len({r.node for r in got}) == len(got)
    assert module.components(table.where("false")).count() == 0


def test_peeling_recovers_the_digests_that_differ(spark):
    from quantloom.llm.fingerprints import KEY_SPACE, compared

    many = [f"paragraph {k} of many" for k in range(900)]
    texts = {5: "\n".join(many), 4: "\n".join(many[:300] + ["new one", *many[400:]]), 3: "a\nb\nc", 2: "", 1: None, 6: "\n".join(many * 2)}
    rows = compared(spark.createDataFrame([(i, t, 7, "x") for i, t in texts.items()], "doc_id long, text string, next int, part string")).collect()
    units = {t or "": {u for u in (t or "").split("\n") if u} for t in texts.values()}
    every = sorted(set().union(*units.values()))
    digest = {r.u: r.k for r in spark.createDataFrame([(u,) for u in every], "u string").selectExpr("u", f"xxhash64(u) & {KEY_SPACE - 1}L as k").collect()}
    keys = {t: {digest[u] for u in us} for t, us in units.items()}
    assert len(rows) == len(texts)
    for r in rows:
        t, after = texts[r.doc_id] or "", texts[r.doc_id - 1 or 6] or ""
        assert set(r.near_next_lost) == keys[t] - keys[after] and set(r.near_next_gained) == keys[after] - keys[t] and r.near_next_direct == 0
        assert len(r.near_next_lost) == len(set(r.near_next_lost)) and len(r.near_next_gained) == len(set(r.near_next_gained))


def test_fingerprints_of_repeated_and_unnamed_rows(spark):
    from quantloom.llm.fingerprints import fingerprints

    rows = [(3, "c"), (3, "c"), (3, "b"), (1, "a"), (None, "n"), (None, "m")]
    got = fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "3", "3", "3", "None", "None"]
    assert len({r.fingerprint for r in got}) == 5 and all(0 <= r.near_next <= 1 and r.n_chars == 1 for r in got)
