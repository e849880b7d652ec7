"""The pipeline against its stages done by hand, and on tables that are empty or awkward."""

import random
from collections import Counter

import pyarrow as pa

import corpus_pipeline
from tessellum.llm import minhash, mixing, packing, quality
from tests.llm import test_lines, test_minhash, test_mixing_packing
from tests.llm.cases import DOCS, awkward, sentence
from tests.llm.test_quality import LABELS, labelled


def tables(spark, folder, rows, labels):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def corpus():
    r = random.Random(6)
    rows, labels = labelled(240, 5)
    rows = [(i, t, "en", r.choice("aaab"), len(t)) for i, t, *_ in rows]
    shared = [sentence(r, 20) for _ in range(4)]
    for i in range(300, 340):  # lines that documents share
        text = "\n".join([sentence(r, 25), r.choice(shared), sentence(r, 25)])
        rows.append((i, text, "en", "c", len(text)))
    for base in range(8):  # near copies whose lines break elsewhere, so that no line is like another
        words = sentence(r, 120).split()
        for copy in range(3):
            own = list(words)
            own[r.randrange(120)] = "other"
            text = "\n".join(" ".join(own[max(0, k) : k + 12]) for k in range(-4 * copy, 120, 12))
            rows.append((400 + 10 * base + copy, text, "en", "d", 1))
    return rows, labels


def test_every_stage_agrees_with_brute_force(spark, tmp_path):
    rows, labels = corpus()
    sf_dir = tables(spark, tmp_path, rows, labels)
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = [tuple(x) for x in docs.collect()]
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    x = quality.features(pa.array([r[1] for r in rows]))
    good = dict((i, y) for i, y, _ in labels)
    own = [k for k, r in enumerate(rows) if r[0] in good]
    model = quality.trained(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    want = [r for r, s in zip(rows, model.score(x), strict=True) if s >= model.threshold]
    assert sorted(seen["quality"]) == sorted(want) and 0 < len(want) < len(rows)
    kept = {r[0] for r in want}
    assert sum((rows[k][0] in kept) == bool(good[rows[k][0]]) for k in own) >= 0.98 * len(own)

    texts = test_lines.brute(seen["quality"])
    assert {r[0]: r[1] for r in seen["line_dedup"]} == texts
    assert len(seen["line_dedup"]) == len(seen["quality"]) and sum(map(len, texts.values())) < sum(len(r[1]) for r in want)

    groups = test_minhash.brute(seen["line_dedup"], minhash.THRESHOLD)
    gone = {i for g in groups for i in g[1:]}
    assert gone and sorted(seen["near_dedup"]) == sorted(r for r in seen["line_dedup"] if r[0] not in gone)

    tokens = Counter()
    for r in seen["near_dedup"]:
        tokens[r[3]] += len(r[1].split())
    shares = {s.source: s for s in mixing.shares(dict(tokens), mixing.ENTROPY, mixing.MAX_EPOCHS, None)}
    spent, times = Counter(), Counter(r[0] for r in seen["mixing"])
    for r in seen["mixing"]:
        spent[r[3]] += len(r[1].split())
    assert all(abs(spent[k] - s.budget) <= 100 for k, s in shares.items()) and {r[0] for r in seen["near_dedup"] if r[1]} <= set(times)
    assert all(shares[r[3]].full <= times[r[0]] <= shares[r[3]].full + 1 for r in seen["near_dedup"])

    pieces, copies, waves = Counter(), Counter(), {}
    for r in seen["mixing"]:
        n = len(r[1].split())
        lengths = waves.setdefault(copies[r[0]], [])
        copies[r[0]] += 1
        for p in range(-(-n // packing.CAPACITY)):
            pieces[r[0], p] += 1
            lengths.append(min(packing.CAPACITY, n - p * packing.CAPACITY))
    assert Counter(r[:2] for r in seen["packing"]) == pieces
    assert len({r[4] for r in seen["packing"]}) == sum(test_mixing_packing.best_fit_decreasing(x, packing.CAPACITY) for x in waves.values())
    assert max(Counter((r[0], r[4]) for r in seen["packing"]).values()) == 1

    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == Counter(seen["packing"])


def test_awkward_and_empty_tables(spark, tmp_path):
    got = corpus_pipeline.run(spark, tables(spark, tmp_path / "a", awkward(), [])).collect()
    ids = {r.doc_id for r in got}
    assert {6, 8} <= ids and {1, 2, 3, 5}.isdisjoint(ids)  # without tokens, or the copy of another
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "b", [], [])).count() == 0


def test_line_stage_agrees_with_edit_similarity_alone(spark):
    pairs = test_lines.changed(random.Random(11), 120)
    rows = [(i, f"{x}\n{sentence(random.Random(i), 25)}", "en", "s", 1) for i, x in enumerate(a for p in pairs for a in p)]
    got = {x.doc_id: x.text for x in dict(corpus_pipeline.STAGES)["line_dedup"](spark, spark.createDataFrame(rows, DOCS), "").collect()}
    found = sum(rows[2 * k + 1][1].split("\n")[1] == got[2 * k + 1] for k in range(len(pairs)))
    assert found >= 0.9 * len(pairs)
    assert all(got[2 * k] == rows[2 * k][1] for k in range(len(pairs)))
