"""Passages of many words that documents share: phrases of words against all windows."""

import random
import re
from collections import defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain(rows, words):
    """Bytes of each row in runs of so many words that another row holds too."""
    spans, holders = [[m.span() for m in WORD.finditer((t or "").encode())] for _, t in rows], defaultdict(set)
    window = lambda k, i: (rows[k][1] or "").encode()[spans[k][i][0] : spans[k][i + words - 1][1]]
    for k, own in enumerate(spans):
        for i in range(len(own) - words + 1):
            holders[window(k, i)].add(k)
    out = {}
    for k, own in enumerate(spans):
        n, reach = 0, -1
        for i in range(len(own) - words + 1):
            if len(holders[window(k, i)]) > 1:
                n += own[i + words - 1][1] - own[max(i, reach)][0] if i > reach else own[i + words - 1][1] - own[reach - 1][1]
                reach = i + words
        out[rows[k][0]] = n
    return out


def texts():
    rnd = random.Random(51)
    some = lambda n: " ".join(rnd.choice(["ab", "é", "word", "x", "lon\tger", "the"]) + str(rnd.randrange(99)) for _ in range(n))
    passages = [some(n) for n in (51, 52, 60, 130)] + [" ".join(["again and"] * 40)]
    rows = [some(rnd.randrange(1, 300)) for _ in range(60)]
    for k in range(60):
        if k % 2:
            at = rnd.randrange(len(rows[k]))
            rows[k] = f"{rows[k][:at]} {passages[k % 5]}\n{rows[k][at:]}"
    once = some(70)
    rows += [rows[3], rows[4], some(50), some(50), f"{once} {once}", some(51), some(51), "", None, None, " ".join(rows[5].split()[20:])]
    rows += [rows[-5]]
    return list(enumerate(rows))


def test_op10_counts_short_passages_of_other_documents(spark, tmp_path):
    """51 words of under 400 bytes repeat no 400-byte string; op10 counts them all the same and removes nothing for them."""
    from quantloom.llm.queries import QUERIES

    rows = texts()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op10_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert {k: r.n_passage_bytes for k, r in got.items()} == plain(rows, 51)
    assert any(r.n_passage_bytes and not r.n_removed for r in got.values())


def test_shared_passages_equal_all_windows(spark):
    from quantloom.llm.suffix_dedup import suffix_dedup

    rows = texts()
    out = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), words=20)
    assert {r.doc_id: r.n_passage_bytes for r in out.collect()} == plain(rows, 20)
    empty = suffix_dedup(spark.createDataFrame([], "doc_id long, text string"), words=51)
    assert empty.columns[-1] == "n_passage_bytes" and empty.count() == 0
