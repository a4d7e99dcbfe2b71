"""Lines by Bloom filters, repair of conversations and periodic runs against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

SPACE = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


# Lines.
def lines_brute(rows, least=10):
    """(doc_id, n_lines, n_dropped, kept text) of rows (doc_id, text)."""
    key = lambda x: x.strip(SPACE).translate(LOWER)
    rank = lambda i: (i is None, i or 0)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(rank(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 2 or min(holders[key(x)]) == rank(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=lambda r: (rank(r[0]), r[1:]))


def line_rows():
    rnd = random.Random(3)
    some = ["a shared line of text", "  A SHARED line of Text\t", "shared nine", "shared ten", "É shared ÉÉ accents", "é shared éé accents", "日本語日本語日本語日", "日本語日本語日本語", "x" * 50_000, "", " \r"]
    rows = [(i, "\n".join(rnd.choice([*some, f"own line {rnd.random()}"]) for _ in range(rnd.randrange(1, 12)))) for i in range(80)]
    hot = [(1000 + i, f"boilerplate of every page\nown {i} words here\nboilerplate of every page") for i in range(60)]
    return rows + hot + [(None, "a shared line of text\nonly here, once"), (None, "null ids hold this\nboth of them"), (None, "null ids hold this"), (5000, None), (5001, ""), rows[3], (rows[4][0], "another row of one id\na shared line of text"), (6000, "own\n" * 3000 + "shared ten")]


def test_lines_by_two_filters(spark):
    from quantloom.llm.bloom_lines import line_dedup_bloom

    rows = line_rows()
    clash = "doc_id long, text string, key string, gone string, digest int, hashes int, segment int, dropped int, n_lines int, _id long, _key binary"
    got = line_dedup_bloom(spark.createDataFrame([(*r, "k", "g", 1, 2, 3, 4, 5, 6, b"7") for r in rows], clash).repartition(5)).collect()
    assert sorted(((r.doc_id, r.n_lines, len(r.dropped), r.text or "") for r in got), key=lambda r: ((r[0] is None, r[0] or 0), r[1:])) == lines_brute(rows)
    assert {r.text for r in got if r.doc_id == 5000} == {None}
    assert line_dedup_bloom(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_full_filters_change_nothing(spark, monkeypatch):
    """With far too few cells all keys are suspected; the digests still decide."""
    from quantloom.llm import bloom_lines

    monkeypatch.setattr(bloom_lines, "MAX_SEGMENTS", 1)
    rows = [(i, "\n".join(f"line {k} of document {i // 2 * 2 if k % 3 else i}" for k in range(2000))) for i in range(60)]
    got = bloom_lines.line_dedup_bloom(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.n_lines, len(r.dropped), r.text) for r in got) == lines_brute(rows)


def test_second_filter_holds_what_two_tasks_marked():
    import numpy as np

    from quantloom.llm.bloom_lines import cells, hashed

    keys = [b"key %d" % k for k in range(20_000)]
    at = cells(hashed(keys), 3)
    assert (at >> np.uint64(16)).max() == 2 and ((at >> np.uint64(16)) == (at[:, :1] >> np.uint64(16))).all()


# Conversations.
def repair_brute(rows):
    """faults, cost, audit and lines of rows (role, text), by all edits in order of cost, then audit."""
    seen, faults = set(), []
    for role, text in rows:
        t = text.strip(SPACE)
        faults.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else None)
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names, heap, done = {"u": "user", "a": "assistant"}, [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return faults, cost, audit, out
        if (i, state) in done:
            continue
        done.add((i, state))
        for x in "ua":
            if (state, x) in step:
                heapq.heappush(heap, (cost + 5, audit + "I", i, x, (*out, names[x] + ":")))
        if i < len(rows):
            (role, text), more = rows[i], 5 * (faults[i] == "truncated")
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
            if faults[i] not in ("blank", "duplicate"):
                if (state, role[:1]) in step:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*out, f"{role}:{text}")))
                for x in "ua":
                    if (state, x) in step:
                        heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, x, (*out, f"{names[x]}:{text}")))


def repairs_brute(rows):
    conversations = defaultdict(list)
    for c, t, role, text in rows:
        held, role, text = conversations[c], " " if role is None else role, " " if text is None else text
        way = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        held += [(t, "user" if way == 4 else role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    out = {}
    for c, held in conversations.items():
        held = sorted(held, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        faults, cost, audit, lines = repair_brute([r[1:] for r in held])
        turns, first = {r[0] for r in held} - {None}, [r[1][:1] for r in held]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
        out[c] = (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def turn_rows():
    rnd, rows = random.Random(5), []
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "unknown"], ["Hi.", "a! ", "b?\n", "cut", "same.", None, "", " \n", "é"]
    for c in [*range(60), None]:
        for t in range(rnd.choice([0, 1, 2, 3, 5, 8, 13, 60])):
            if rnd.random() > 0.1:
                rows.append((c, None if rnd.random() < 0.03 else t + (rnd.random() < 0.05), rnd.choice(roles), rnd.choice([*texts, f"x {rnd.random()}."])))
    rows += [(1000, t, rnd.choice(roles[:2]), f"t {t}.") for t in range(300)]
    rows += [(1001, t, "user", f"t {t}.") for t in range(300)]  # costs at the borders of its chunks keep alternating
    rows += [(1002, t, roles[t % 2], f"t {t}") for t in range(200)]
    rows += [(1003, t, "system", f"t {t}.") for t in range(100)] + [(1004, t, "user", "same.") for t in range(200)] + [(1005, 2, "user", "one row, often.")] * 50
    return rows + rows[:5] + [(1006, 0, "user", "long " * 100_000 + ".")]


@pytest.mark.parametrize("chunk_rows", (1 << 16, 41))
def test_repair(spark, chunk_rows):
    from quantloom.llm.queries import damaged
    from quantloom.llm.repair import repaired

    rows, want = turn_rows(), repairs_brute(turn_rows())
    clash = "conv_id long, turn long, role string, text string, seq int, pid int, digest string, part int, kind int, edits string, symbol string"
    df = spark.createDataFrame([(*r, 1, 2, "d", 3, 4, "e", "s") for r in rows], clash)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in repaired(damaged(df), df, chunk_rows).collect()}
    assert got == want


def test_repair_of_nothing(spark):
    from quantloom.llm.repair import repaired

    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, copies int")
    assert repaired(none).count() == 0
    ids = spark.createDataFrame([(7,), (7,), (None,)], "conv_id long")
    got = sorted(repaired(none, ids).collect(), key=lambda r: r.conv_id or 0)
    assert [(r.conv_id, r.cost, r.audit, r.repaired_sha256) for r in got] == [(None, 0, "", hashlib.sha256(b"").hexdigest()), (7, 0, "", hashlib.sha256(b"").hexdigest())]


def test_fix_up_stops_where_costs_differ_by_a_constant():
    from quantloom.llm.repair import END, run_back

    rnd = random.Random(1)
    for _ in range(200):
        symbols = [rnd.choice(["s", "u", "a", "u!", "a!", "t"]) for _ in range(rnd.randrange(40))]
        known = END, run_back(symbols, END)
        for end in {run_back([rnd.choice("ua")] * k, END) for k in range(6)}:
            assert run_back(symbols, end, known) == run_back(symbols, end)


# Runs.
def runs_brute(w):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((i, n, q) for (i, n), q in found.items()), key=lambda r: (r[0], r[2]))


def word_lists():
    rnd, out = random.Random(9), []
    fib, other = ["a"], ["a", "b"]
    while len(other) < 900:
        fib, other = other, other + fib
    thue = ["t" if bin(i).count("1") % 2 else "m" for i in range(900)]
    for k in range(240):
        n, size = rnd.choice([0, 5, 24, 47, 48, 60, 100, 150, 333, 700]), rnd.choice([1, 2, 3, 10])
        w = [str(rnd.randrange(size)) for _ in range(n)]
        if k % 6 == 1:
            p = [str(rnd.randrange(size)) for _ in range(rnd.randint(1, 120))]
            w = (p * (n // len(p) + 1))[:n]
        elif k % 6 == 2:
            w = []
            while len(w) < n:
                p = [str(rnd.randrange(rnd.choice([2, 1000]))) for _ in range(rnd.randint(1, 60))]
                w += (p * rnd.randint(1, 6))[: rnd.randint(1, 300)]
        elif k % 6 == 3:
            w = ((["a"] * rnd.randint(1, 60) + ["b"] * rnd.randint(0, 40)) * rnd.randint(1, 4) + ["c"] * rnd.randint(0, 2)) * rnd.randint(1, 6)
        elif k % 6 == 4:
            w = (fib if k % 12 == 4 else thue)[:n]
        out.append(w)
    return out


def test_runs_of_words():
    from quantloom.llm.runs import document_runs, top_run

    lists = word_lists()
    got = document_runs([[x.encode() for x in w] for w in lists])
    want = [runs_brute(w) for w in lists]
    assert [[tuple(r) for r in g.tolist()] for g in got] == want
    assert sum(q >= 32 for each in want for _, _, q in each) > 50
    for g, each in zip(got, want, strict=True):
        assert top_run(g) == max(each, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)


def test_periodic_runs_query(spark, tmp_path):
    from quantloom.llm.queries import op13_periodic_runs

    lists = word_lists()[:120]
    rows = [(i, "\x0b".join(w) if i % 2 else "  " + "\n\t".join(w)) for i, w in enumerate(lists)] + [(500, None), (501, ""), (502, " \n "), (None, "a " * 30), (503, "word " * 50_000), (504, " ".join(str(k % 7919) for k in range(30_000))), (505, "\xa0".join("a" * 40))]
    rows.append(rows[1])
    spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, runs string, top int, collapsed int").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        each = [(0, 30_000, 7919)] if i == 504 and h % 10 else [(0, 50_000, 1)] if i == 503 else runs_brute(w)
        gone = {k for a, n, q in each for k in range(a + q, a + n)}
        top = max(each, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(each), *(top or (None,) * 3), top and 1000 * top[1] // top[2], digest("".join(f"{a},{n},{q}\n" for a, n, q in each)), digest(" ".join(x for k, x in enumerate(w) if k not in gone))))
    order = lambda r: (r[0] is None, r[0] or 0, r[6])
    got = op13_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    from quantloom.llm.runs import periodic_runs

    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
