import math
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tessellum.llm import quality as q
from tessellum.llm import queries
from tests.llm.cases import DOCS, awkward, clashing, sentence


def labelled(n=600, seed=2):
    r, rows, labels = random.Random(seed), [], []
    for i in range(n):
        good = r.random() < 0.8
        text = sentence(r, r.randint(5, 80)) if good else r.choice([
            lambda: " ".join([sentence(r, 1)] * 30), lambda: " ".join(w + "###" for w in sentence(r, 30).split()), lambda: sentence(r, 30).upper() + "!!",
        ])()
        rows.append((i, text, "en", "s", 1))
        labels.append((i, int(good), 0))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows, DOCS)
    model = q.trained(docs.where("doc_id < 400"), spark.createDataFrame(labels, LABELS))
    kept = {r.doc_id for r in q.filtered(docs.where("doc_id >= 400"), model).collect()}
    right = sum((i in kept) == bool(g) for i, g, _ in labels[400:])
    assert right >= 0.98 * 200
    good = [i for i, g, _ in labels[400:] if g]
    assert sum(i in kept for i in good) >= 0.98 * len(good)


def test_pairs_learn_an_interaction_that_main_effects_cannot():
    r = np.random.default_rng(1)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = q.fit(x[:3000], y[:3000])
    assert (1, 0) in m.pairs
    assert ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_scores_are_sums_of_table_entries():
    r = np.random.default_rng(2)
    x = r.random((500, 3))
    m = q.fit(x, (x[:, 0] + 0.2 * r.random(500) > 0.6).astype(float))
    row = x[7]
    want = m.base + sum(t[sum(v >= e for e in edges)] for v, edges, t in zip(row, m.edges, m.tables, strict=True))
    for (a, b), t in m.pairs.items():
        want += t[sum(row[a] >= e for e in m.pair_edges[a]), sum(row[b] >= e for e in m.pair_edges[b])]
    assert np.isclose(m.logit(x)[7], want)


def test_features_of_whole_texts():
    x = q.features(pa.array(["A b!! 12\nzz#", None, "", "w " * 200_000]))
    f = dict(zip(q.FEATURES, x[0], strict=True))
    assert np.isclose(f["words_per_line"], 2) and np.isclose(f["upper_share"], 1 / 12) and np.isclose(f["digit_share"], 2 / 12)
    assert np.isclose(f["shout_share"], 2 / 12) and np.isclose(f["symbol_word_share"], 1 / 4) and f["repeat_share"] == 0
    assert (x[1] == x[2]).all() and np.isclose(x[3][0], np.log1p(400_000)) and x[3][-3] > 0.99


def measured(text):
    """The features of one text, counted without arrays."""
    raw = (text or "").encode()
    words, lines = re.findall(rb"[^\t\n\x0b\x0c\r ]+", raw), raw.count(b"\n") + 1
    b, w = max(1, len(raw)), max(1, len(words))
    symbols = b"#$%&*|<>{}[]=\\/@^~_+"
    among = lambda chars: sum(c in chars for c in raw) / b
    return [
        math.log(1 + len(raw)), len(words) / lines, sum(map(len, words)) / w, sum(len(x) > 16 for x in words) / w, sum(65 <= c <= 90 for c in raw) / b, sum(48 <= c <= 57 for c in raw) / b,
        among(symbols), among(b".,;:!?'\"-()"), sum(c > 127 for c in raw) / b, among(b"!"), sum(any(c in symbols for c in x) for x in words) / w,
        sum(x == y for x, y in zip(words, words[1:], strict=False)) / w, len(set(words)) / w, math.log(lines),
    ]


def looked_up(m, row):
    """A score from the model's tables, one entry after the other."""
    f = m.base + sum(t[sum(x >= e for e in edges)] for x, edges, t in zip(row, m.edges, m.tables, strict=True))
    for (a, b), t in m.pairs.items():
        f += t[sum(row[a] >= e for e in m.pair_edges[a]), sum(row[b] >= e for e in m.pair_edges[b])]
    return 1 / (1 + math.exp(-f))


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no tables here")
def test_the_query_agrees_with_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = q.trained(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = {r.doc_id: measured(r.text) for r in docs.collect()}
    want = {i: looked_up(model, x) for i, x in rows.items()}
    got = {r.doc_id: r.score for r in queries.op4_quality_gam(spark, sf).collect()}
    # a feature at the edge of a bin may be rounded to either side
    edges = [np.concatenate(e) for e in zip(model.edges, model.pair_edges, strict=True)]
    sure = [i for i, x in rows.items() if not any(((e != v) & (abs(e - v) < 1e-12)).any() for v, e in zip(x, edges, strict=True))]
    assert len(sure) > 50
    for i in sure:
        assert (i in got) == (want[i] >= model.threshold) and abs(got.get(i, want[i]) - want[i]) < 1e-9
    assert sum((i in got) == (want[i] >= model.threshold) for i in want) >= 0.99 * len(want)


def test_features_agree_with_those_of_single_texts():
    r = random.Random(9)
    texts = ["".join(r.choice(["word ", "Großes ", "12 ", "#a ", "!!\n", "\t", "x" * 20 + " ", "a a ", "<b> "]) for _ in range(r.randint(0, 60))) for _ in range(100)] + [None, ""]
    assert np.allclose(q.features(pa.array(texts)), [measured(t) for t in texts])


def test_a_labelled_id_of_many_rows_is_one_row_of_the_fit(spark, monkeypatch):
    rows, labels = labelled(100)
    docs = spark.createDataFrame(rows + [(5, f"{i} rows", "en", "s", 1) for i in range(500)], DOCS)
    seen = []
    monkeypatch.setattr(q, "fit", lambda x, y, keep: seen.append(len(x)) or q.Model())
    q.trained(docs, spark.createDataFrame(labels, LABELS))
    assert seen == [100]


def test_the_bound_on_labels_holds(spark):
    rows, labels = labelled(500)
    docs, table = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    model = q.trained(docs, table, max_labels=200)
    assert model.tables and len({r.doc_id for r in q.filtered(docs, model).collect()}) > 300


def test_awkward_rows(spark):
    docs = clashing(spark.createDataFrame(awkward(), DOCS))
    none = q.trained(docs, spark.createDataFrame([], LABELS))
    assert q.filtered(docs, none).count() == docs.count()
    rows, labels = labelled(300)
    labels += [(None, 1, 0), (5, None, None), (6, 2, 0), (7, 1, 0), (7, 0, 0)]
    model = q.trained(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    out = q.filtered(docs, model)
    assert out.columns == docs.columns
    scores = q.scored(docs.select("doc_id", "text"), model).where("doc_id = 8").collect()
    assert len(scores) == 2 and scores[0].score == scores[1].score
    assert q.filtered(spark.createDataFrame([], DOCS), model).count() == 0
