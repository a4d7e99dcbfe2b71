"""The whole pipeline, and the stages' models, against plain versions on a small corpus with planted cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.test_corpus import water
from tests.llm.test_dedup import brute_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def planted():
    """Clean texts, near and exact copies, a shared passage, toxic texts, empty and null ones, rows without id or source."""
    rng = random.Random(12)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(300))
    sentence = lambda n: " ".join(word() for _ in range(n)) + "."
    texts = [" ".join(sentence(rng.randrange(5, 12)) for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    labels = []
    for k in range(150):
        if k % 4 == 0:
            texts[k] += " You vile " + sentence(3)
        labels.append((k, 1, int(k % 4 == 0)))
    passage = sentence(60)
    for k in (1, 2, 3):
        texts[k] += f"\n{passage}\n" + sentence(4)
    texts += [texts[5], texts[5] + " more", texts[6].replace(".", " .", 1), None, "", " \n", "long " * 3000, " ".join(word() for _ in range(2500))]
    rows = [(k, t, "en", ("a", "b", "é", None)[k % 4], len(t or "")) for k, t in enumerate(texts)]
    return [*rows, (None, "no id here at all", "en", "a", 17), rows[9]], labels


def noisy_or(model, text):
    """1 - product of (1 - sigmoid(bias + weights of a sentence's words)); sentences without known words count once."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    sentences = [set(re.findall(r"[a-z0-9\x80-\U0010ffff]+", s)) for s in re.split(r"[.!?\n]", low)]
    left, plain = 1.0, False
    for words in filter(None, sentences):
        known = [model.weights[w.encode()] for w in words if w.encode() in model.weights]
        if known:
            left *= 1 - 1 / (1 + math.exp(-(model.bias + sum(known))))
        plain |= not known
    some = any(w.encode() in model.weights for s in sentences for w in s)
    return 1 - left * (1 - 1 / (1 + math.exp(-model.bias)) if plain or not some else 1)


def test_scores_are_noisy_or():
    from quantloom.llm.toxicity import Model, fit

    rng = random.Random(1)
    weights = {w.encode(): rng.uniform(-1, 3) for w in ("vile", "foul", "nice", "é", "x1")}
    model = Model(weights, -3.0)
    pieces = ["vile", "Foul", "nice", "é", "x1", "plain", ".", "!", "?", "\n", ",", " ", "😀"]
    for _ in range(500):
        text = " ".join(rng.choices(pieces, k=rng.randrange(12)))
        assert model.score(text)[0] == pytest.approx(noisy_or(model, text), abs=1e-12), text
    assert model.score(None)[0] == model.score("")[0] == pytest.approx(noisy_or(model, ""))
    rows, labels = planted()
    model = fit([rows[k][1] for k, *_ in labels], [t for *_, t in labels])
    assert b"vile" in model.weights and all(model.score(rows[k][1])[0] == pytest.approx(noisy_or(model, rows[k][1]), abs=1e-9) for k in range(150))


def test_clashing_columns_do_not_change_scores(spark):
    from quantloom.llm.toxicity import toxicity

    rows, labels = planted()
    docs, marks = spark.createDataFrame(rows[:60], DOCS), spark.createDataFrame(labels, LABELS)
    read = lambda d: sorted((str(r.doc_id), r.score, r.predicted) for r in toxicity(d, marks).collect())
    clash = docs.withColumnsRenamed({"lang": "score", "source": "offending", "n_chars": "toxic"})
    assert read(docs) == read(clash)


def cut_brute(rows, least, words):
    """Texts without bytes of strings of least bytes, and of runs of so many words in fewer bytes, that occur elsewhere too."""
    raws = [(t or "").encode() for _, t, *_ in rows]
    seen, runs = Counter(), Counter()
    spans = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", t)] for t in raws]
    for t, own in zip(raws, spans, strict=True):
        seen.update(t[i : i + least] for i in range(len(t) - least + 1))
        runs.update(t[a[0] : b[1]] for a, b in zip(own, own[words - 1 :], strict=False))
    out = []
    for (i, text, *rest), t, own in zip(rows, raws, spans, strict=True):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - least + 1):
            if seen[t[k : k + least]] > 1:
                gone[k : k + least] = True
        for a, b in zip(own, own[words - 1 :], strict=False):
            if b[1] - a[0] < least and runs[t[a[0] : b[1]]] > 1:
                gone[a[0] : b[1]] = True
        out.append((i, None if text is None else bytes(np.frombuffer(t, np.uint8)[~gone]).decode("utf-8", "ignore"), *rest))
    return out


def test_run_equals_plain_stages(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    from quantloom.llm.toxicity import THRESHOLD, train

    rows, labels = planted()
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "minhash_near_dedup", "suffix_array_dedup", "mixture", "best_fit_packing"]
    plain = lambda frame: Counter(map(tuple, frame.select(*docs.columns).collect()))

    model = train(docs, marks)
    clean = [r for r in rows if noisy_or(model, r[1]) < THRESHOLD]
    assert plain(stages["toxicity"](spark, docs, str(tmp_path))) == Counter(clean)
    assert not any("vile" in (r[1] or "") for r in clean) and {r[0] for r in rows if r[0] is None or r[0] % 4 or r[0] >= 150} <= {r[0] for r in clean}

    named = [r for r in clean if r[0] is not None]
    roots = brute_components(named, 5, 80)
    kept = [r for r in clean if r[0] is None or roots[r[0]][1] == r[0]]
    assert {150, 151} & {r[0] for r in kept} == set() and len(kept) < len(clean)
    assert plain(stages["minhash_near_dedup"](spark, spark.createDataFrame(clean, DOCS), str(tmp_path))) == Counter(kept)

    cut = [(i, t, a, b, None if t is None else len(t)) for i, t, a, b, _ in cut_brute(kept, 256, 51)]
    assert sum(x[1] != y[1] for x, y in zip(cut, kept, strict=True)) >= 3
    assert plain(stages["suffix_array_dedup"](spark, spark.createDataFrame(kept, DOCS), str(tmp_path))) == Counter(cut)

    mixed = Counter(r.doc_id for r in stages["mixture"](spark, spark.createDataFrame(cut, DOCS), str(tmp_path)).collect())
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in cut}
    own, given, sizes = defaultdict(int), Counter(r[0] for r in cut), defaultdict(int)
    for i, t, _, s, _ in cut:
        sizes[s] += size[i]
    for i, s in {(r[0], r[3]) for r in cut}:
        own[s] += mixed[i] * size[i]
        assert mixed[i] <= 3 * given[i]
    for s, target in water(sizes).items():
        assert abs(own[s] - target) <= max(0.02 * target, max(size.values())), s

    coder, text = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {r[0]: r[1] for r in cut}
    pieces, fill = Counter(), defaultdict(list)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for r in out:
        pieces[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
        fill[r.sequence_id].append((r.offset, r.length))
    want = Counter()
    for i, n in mixed.items():
        ids, at, piece = np.array([*coder.encode(text[i] or "", add_special_tokens=False).ids, 2], "<u4"), 0, 0
        while at < len(ids):
            end = at + ((len(ids) - at) % 1024 or 1024)
            want[(i, piece, at, end - at, zlib.crc32(ids[at:end].tobytes()))] += n
            at, piece = end, piece + 1
    assert pieces == want
    for parts in fill.values():
        assert [a for a, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024


def test_stages_on_empty_tables_and_null_texts(spark):
    import corpus_pipeline

    marks = spark.createDataFrame([], LABELS)
    for rows in ([], [(1, None, None, None, None), (None, None, None, None, None)]):
        docs = spark.createDataFrame(rows, DOCS)
        for name, stage in corpus_pipeline.STAGES:
            if name == "toxicity":
                from quantloom.llm.toxicity import toxicity

                assert toxicity(docs, marks).count() == len(rows)
                continue
            got = stage(spark, docs, "").collect()
            assert len(got) == len(rows) if name != "mixture" else len(got) <= 3 * len(rows), name
