"""Fingerprints, archives, packing, mixing, search, toxicity, chat and the pipeline against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sample(spark, n=60):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(n).collect()]
    more = [(10_001, None, None, None, None), (10_002, "", "en", "src1", 0), (10_003, " \n\t", "en", "src1", 3), (10_004, "x" * 30_000 + "\n" + "word " * 3000, "en", "src1", 45_000)]
    return rows + more + [rows[3]]


def test_fingerprints(spark):
    from quantloom.llm.fingerprints import fingerprints

    rows = list(dict.fromkeys(sample(spark)))
    order = sorted(rows, key=lambda r: -r[0])
    got = {r.doc_id: r for r in fingerprints(spark.createDataFrame(rows, DOCS)).collect()}
    units = lambda t: set(re.findall(r"[^\n]{1,256}", t))
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, t, *_) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(like(units(t), units(edited))) and r.near_next == pytest.approx(like(units(t), units(after)))
    assert got[10_001].fingerprint == got[10_002].fingerprint
    assert fingerprints(spark.createDataFrame([], DOCS)).count() == 0
    one = fingerprints(spark.createDataFrame([(5, "only one here", "", "", 0)], DOCS)).first()
    assert one.near_next == 1.0 and one.fingerprint


def test_fingerprints_have_no_python(spark):
    from quantloom.llm.fingerprints import fingerprints

    plan = fingerprints(spark.createDataFrame(sample(spark)[:5], DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan


def test_warc_round_trip(spark):
    from quantloom.llm.warc import round_trip

    long = "<p>" + "é" * 5000 + "</p>"
    rows = [(1, "http://a/ b", "short"), (2, None, "short"), (9, "u", long), (4, "u", long), (7, "u", long), (5, "u", None), (6, "u", ""), (None, "u", long), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 30), (10, "u", "y" * 100), (11, "u", "y" * 100), (12, "u", "y" * 99), (13, "u", "y" * 99), (14, "u", "z" * 3_000_000)]
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in round_trip(spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, digest string, refers_to int")).collect())
    first = defaultdict(list)
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h].append(i)
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        low = min(first[h]) if h in first and i is not None else None
        again = low is not None and i > low
        want[(i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", low if again else None)] += 1
    assert got == want and sum(1 for k in want if k[3] == "revisit") == 3
    assert round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_normalised_members_stand_alone(spark, tmp_path):
    from quantloom.llm.warc import archived, normalise, write_archives

    pages = spark.createDataFrame([(i, f"http://x/{i}", "body " * i) for i in range(40)], "page_id long, url string, html string")
    raw = write_archives(archived(pages), f"file://{tmp_path}/whole")
    index = normalise(raw, f"file://{tmp_path}/members")
    by_file = defaultdict(list)
    for r in index.collect():
        by_file[r.path.removeprefix("file://")].append((r.offset, r.length, r.record_id))
    assert sum(map(len, by_file.values())) == 40
    for path, rows in by_file.items():
        data, at = open(path, "rb").read(), 0
        for offset, length, name in sorted(rows):
            assert offset == at and name.encode() in zlib.decompress(data[offset : offset + length], 31)
            at += length
        assert at == len(data) and len(open(path + ".idx").read().splitlines()) == len(rows)


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from quantloom.llm.packing import packed_documents

    rows = [*list(dict.fromkeys(sample(spark))), (10_010, "a <|endoftext|> b", "", "", 0)]
    got = packed_documents(spark.createDataFrame(rows, DOCS).withColumnRenamed("n_chars", "uid")).collect()
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, fill = {(r.doc_id, r.piece): r for r in got}, defaultdict(list)
    assert len(pieces) == len(got)
    total = 0
    for i, t, *_ in rows:
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        start = piece = 0
        while start < len(ids):
            end = start + ((len(ids) - start) % 1024 or 1024)
            r = pieces.pop((i, piece))
            assert (r.start, r.length, r.ids_crc32) == (start, end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes()))
            start, piece = end, piece + 1
    assert not pieces
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(fill) <= -(-total // 1024) + 2
    assert packed_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_packing_in_rounds(spark, monkeypatch):
    import quantloom.llm.packing as module

    monkeypatch.setattr(module, "GROUP", 16)
    rng = random.Random(1)
    items = [(i, rng.randrange(1, 1025)) for i in range(300)]
    got = {r.uid: r for r in module.pack(spark.createDataFrame(items, "uid long, length long")).collect()}
    fill = defaultdict(int)
    for uid, n in sorted(items, key=lambda x: got[x[0]].offset):
        assert got[uid].offset == fill[got[uid].sequence_id]
        fill[got[uid].sequence_id] += n
    assert len(got) == 300 and max(fill.values()) <= 1024 and len(fill) <= 1.15 * sum(n for _, n in items) / 1024 + 2


def water(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, sum(sizes.values())
    capped = set()
    while True:
        left = [s for s in order if s not in capped]
        share = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in left) if left else 0
        more = {s for s in left if weight[s] * share > 3 * sizes[s]}
        if not more:
            return {s: 3.0 * sizes[s] if s in capped else weight[s] * share for s in order}
        capped |= more


def test_mixture(spark):
    from quantloom.llm.mixing import mix_stage, mixture

    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(0, 60), "en", rng.choice(["a", "b", "é", "Z", None]), 0) for i in range(900)]
    rows += [(2000 + i, "w w w", "en", "tiny", 0) for i in range(3)] + [(3000, None, "en", "void", 0), rows[5]]
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "target")
    got = mixture(docs).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert r.taken <= 3 * r["size"] and r.taken == r["size"] * r.copies
    want = water(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.01 * want[s], 3)
    again = Counter((r.doc_id, r.taken) for r in mixture(docs.repartition(3)).collect())
    assert again == Counter((r.doc_id, r.taken) for r in got)
    copies = Counter(r.doc_id for r in mix_stage(spark, docs, "").collect())
    assert copies == Counter({i: n for i, n in Counter({r.doc_id: 0 for r in got}).items()} | dict(sum((Counter({r.doc_id: r.copies}) for r in got), Counter())))
    assert mixture(spark.createDataFrame([], DOCS)).count() == 0


def test_search(spark):
    from quantloom.llm.search import SCALE, top_documents

    rows = list(dict.fromkeys(sample(spark, 120)))
    docs = spark.createDataFrame(rows, DOCS)
    got = defaultdict(list)
    for r in top_documents(docs, docs.where("doc_id % 10 = 0"), 7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, round(r.score * SCALE)))
    words = {i: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for i, t, *_ in rows}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    tf = {i: Counter(ws) for i, ws in words.items()}
    for q in (i for i in words if i % 10 == 0):
        points = {}
        for i in words:
            if i != q:
                p = sum(math.floor(SCALE * (math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * (tf[i][w] * 2.2 / (tf[i][w] + 1.2 * (0.25 + 0.75 * (len(words[i]) / mean))))) + 0.5) for w in set(words[q]) & tf[i].keys())
                if p > 0:
                    points[i] = p
        want = sorted(points.items(), key=lambda x: (-x[1], x[0]))[:7]
        assert [x[0] for x in got[q]] == [x[0] for x in want] and all(abs(a[1] - b[1]) <= 2 for a, b in zip(got[q], want, strict=True))
    assert top_documents(spark.createDataFrame([], DOCS), spark.createDataFrame([], DOCS)).count() == 0


def test_toxicity(spark):
    from quantloom.llm.toxicity import THRESHOLD, toxicity, toxicity_stage

    rng = random.Random(4)
    plain = [f"word{k}" for k in range(60)]
    rows, labels = [], []
    for i in range(800):
        bad = i % 5 == 0
        parts = [" ".join(rng.choices(plain, k=9)) for _ in range(rng.randrange(1, 7))]
        if bad:
            parts[rng.randrange(len(parts))] += rng.choice([" vile", " Nasty", " foul,"])
        rows.append((i, ". ".join(parts), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    rows += [(5000, None, "", "", 0), (5001, "", "", "", 0), (None, "vile", "", "", 0), rows[0]]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, None, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= THRESHOLD) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [(r.predicted, labels[r.doc_id][2]) for r in got if r.held_out and r.doc_id < 800]
    assert sum(a == b for a, b in held) >= 0.98 * len(held)
    text = {r[0]: r[1] for r in rows}
    found = [text[r.doc_id][r.worst_start : r.worst_end] for r in got if r.n_offending and r.doc_id is not None]
    assert found and all(re.search("vile|Nasty|foul", s) for s in found)
    import quantloom.llm.toxicity as module

    assert module.fit([], []).score("x")[0] < THRESHOLD
    assert toxicity(spark.createDataFrame([], DOCS), marks).count() == 0
    assert toxicity_stage.__doc__


def test_chat_round_trip(spark):
    from quantloom.llm.chat import CONTROLS, escape, formatted, loss_tokens, parse, read_back, render, unescape

    rng = random.Random(6)
    pieces = [*CONTROLS, "\\", " ", "\n", "é", "<", "[", "ok", "😀", ".", "system", ""]
    turns = [(c, t, rng.choice(["user", "assistant", "system", "tool <s>", None, ""]), rng.choice([None, "".join(rng.choices(pieces, k=rng.randrange(12)))])) for c in range(60) for t in range(rng.randrange(1, 9))]
    turns += [(None, 0, "user", "hi"), (99, 5, "assistant", "b"), (99, 1, "user", "a")]
    rows = spark.createDataFrame([(*x, "extra") for x in turns], "conv_id long, turn long, role string, text string, run string")
    got = {r.conv_id: r for r in read_back(formatted(rows)).collect()}
    by = defaultdict(list)
    for c, t, role, text in turns:
        by[c].append((t, role is not None, role or "", text or "", role))
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort(key=lambda x: x[:4])
        loss = "".join(x[3] for x in own if x[4] == "assistant")
        r = got[c]
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in own).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for _ in range(2000):
        text = "".join(rng.choices(pieces, k=rng.randrange(12)))
        assert unescape(escape(text)) == text
        assert parse(render([(None, text), ("assistant", text), (text, "x")])[0]) == [(None, text), ("assistant", text), (text, "x")]
    assert loss_tokens([(2, 5)], [(0, 3), (3, 4), (4, 6), (6, 7)]) == [(0, 2, 3), (1, 3, 4), (2, 4, 5)]
    assert read_back(formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_long_conversation_in_runs(spark, monkeypatch):
    import quantloom.llm.chat as module

    monkeypatch.setattr(module, "RUN_CHARS", 50)
    rows = spark.createDataFrame([(1, t, "assistant" if t % 2 else "user", f"text {t} </s>") for t in range(40)], "conv_id long, turn long, role string, text string")
    r = module.read_back(module.formatted(rows)).first()
    loss = "".join(f"text {t} </s>" for t in range(1, 40, 2))
    assert r.n_turns == 40 and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {r.doc_id for r in docs.select("doc_id").collect()}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        now = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
        assert now <= seen and now
        if k < 4:
            assert docs.columns == columns, name
        seen = now
    assert docs.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 1024
