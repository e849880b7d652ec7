"""The recurrent language model: its arithmetic, its gradients, and what it learns."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tessellum.llm import lm
from tests.llm.cases import DOCS, awkward, clashing, sentence


def small(classes=4):
    words = [(int(h), 50 - i) for i, h in enumerate(np.arange(1, 21, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))]
    return lm.Vocabulary.of(words, [7, 3, 0], 11, classes)


def brute(model, v, doc):
    """The log-likelihood, one word at a time, with the softmax written out."""
    k, h, before, total = model.u.shape[0], np.zeros(model.u.shape[0]), v.end, 0.0
    sig = lambda x: 1 / (1 + np.exp(-x))
    for y in doc:
        a, g = model.x[before].astype(float), h @ model.u.astype(float)
        z, r = sig(a[:k] + g[:k]), sig(a[k : 2 * k] + g[k : 2 * k])
        n = np.tanh(a[2 * k :] + r * g[2 * k :])
        h = z * h + (1 - z) * n
        c = int(v.class_of[y])
        b, e = v.classes[c], v.classes[c + 1]
        lc, lw = h @ model.wc + model.bc, h @ model.wo[:, b:e] + model.bo[b:e]
        total += lc[c] - np.log(np.exp(lc).sum()) + lw[y - b] - np.log(np.exp(lw).sum())
        before = y
    return total


def documents(v, sizes, seed=3):
    r = np.random.default_rng(seed)
    ids = np.concatenate([np.append(r.integers(0, v.counts.size, n - 1), v.end) for n in sizes]).astype(np.int32)
    return ids, np.concatenate([[0], np.cumsum(sizes)])


@pytest.mark.parametrize("lanes,steps", [(1, 4), (3, 5), (64, 32)])
def test_scores_are_those_of_whole_documents_whatever_the_lanes_and_windows(lanes, steps):
    v = small()
    model = lm.Gru.fresh(v, 6)
    ids, first = documents(v, [1, 9, 40, 2, 133, 1, 17])
    got = model.run(ids, first, v, lanes=lanes, steps=steps)
    want = [brute(model, v, ids[a:b]) for a, b in zip(first, first[1:], strict=False)]
    assert np.allclose(got, want, rtol=1e-4)


def test_probabilities_of_all_words_sum_to_one():
    v = small()
    model = lm.Gru.fresh(v, 6)
    n = v.counts.size
    before = np.full((1, n), v.end, np.int32)
    logp, _ = model.window(before, np.arange(n, dtype=np.int32)[None], np.ones((1, n), bool), np.ones((1, n), bool), np.zeros((n, 6), np.float32), v, False)
    assert math.isclose(np.exp(logp).sum(), 1, rel_tol=1e-5)


def test_gradients_against_differences():
    """A first step of adagrad has the sign of the gradient; its squared sum is kept in memory."""
    v = small()
    model = lm.Gru.fresh(v, 5)
    for p in model.params():
        p += np.random.default_rng(8).standard_normal(p.shape).astype(np.float32) * 0.2
    steps, lanes = 6, 4
    r = np.random.default_rng(2)
    target = r.integers(0, v.counts.size, (steps, lanes)).astype(np.int32)
    before = r.integers(0, v.counts.size, (steps, lanes)).astype(np.int32)
    fresh, live = np.zeros((steps, lanes), bool), np.ones((steps, lanes), bool)
    fresh[0, :2] = fresh[3, 1] = True
    live[4:, 3] = False
    h = r.standard_normal((lanes, 5)).astype(np.float32) * 0.3
    copy = model.filled(model.flat().copy())
    loss = lambda m: -float(m.window(before, target, fresh, live, h.copy(), v, False)[0][live].sum(dtype=np.float64)) / live.sum()
    copy.window(before, target, fresh, live, h.copy(), v, True)
    for which, (p, mem) in enumerate(zip(model.params(), copy.memory, strict=True)):
        flat = p.reshape(-1)
        for i in r.choice(flat.size, min(12, flat.size), replace=False):
            old, eps = flat[i], 2e-2
            flat[i] = old + eps
            up = loss(model)
            flat[i] = old - eps
            down = loss(model)
            flat[i] = old
            g = (up - down) / (2 * eps)
            step = (old - copy.params()[which].reshape(-1)[i]) / lm.RATE * math.sqrt(mem.reshape(-1)[i])
            assert math.isclose(step, g, rel_tol=0.05, abs_tol=2e-3), (which, i, step, g)


def test_a_very_long_document_costs_only_its_own_length():
    v = small()
    model = lm.Gru.fresh(v, 4)
    sizes = [200_000, *[3] * 600]
    ids, first = documents(v, sizes)
    import tracemalloc

    tracemalloc.start()
    out = model.run(ids, first, v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.size == len(sizes) and peak < 60e6


def test_encoding():
    v = small()
    h = np.concatenate([v.hashes, np.array([5, 6, 7], np.uint64)])
    ids = v.encode(h)
    assert sorted(ids[:20]) == sorted(v.ids) and (ids[20:] == v.shared[[2, 0, 1]]).all()
    got, first = v.documents(pa.array([None, "", "a b", "--"]))
    assert np.diff(first).tolist() == [1, 1, 3, 1] and (got[first[1:] - 1] == v.end).all()


def test_vocabulary_counts_the_whole_corpus(spark):
    rows = [(i, " ".join(["alpha"] * 5 + ["beta"] * 3 + [f"w{i}"]), "en", "s", 1) for i in range(50)]
    v = lm.vocabulary(spark.createDataFrame(rows, DOCS).repartition(3), words=2, shared=4, classes=3)
    assert v.counts.sum() == pytest.approx(50 * 10 + 0.5 * (v.counts == 0.5).sum())
    assert v.counts[0] == 250 and v.counts[1] == 150 and v.counts.size == 7


def test_learns_order_that_frequencies_do_not_have(spark):
    r = random.Random(4)
    cycle = "red green blue white black grey pink brown".split()

    def text():
        at = r.randrange(8)
        return " ".join(cycle[(at + k) % 8] for k in range(r.randint(20, 60)))

    rows = [(i, text(), "en", "s", 1) for i in range(400)]
    held = [(1000 + i, text(), "en", "s", 1) for i in range(50)]
    noise = [(2000 + i, " ".join(r.choice(cycle) for _ in range(40)), "en", "s", 1) for i in range(50)]
    docs = spark.createDataFrame(rows, DOCS).repartition(2)
    v = lm.vocabulary(docs)
    model = lm.trained(docs, v)
    got = {x.doc_id: x.bits_per_token for x in lm.scored(spark.createDataFrame(held + noise, DOCS), model, v).collect()}
    ordered, mixed = (float(np.mean([b for k, b in got.items() if (k < 2000) == first])) for first in (True, False))
    assert ordered < 2.6 and ordered < mixed - 0.3  # frequencies alone give 3 bits


def test_awkward_rows(spark):
    rows = awkward()
    docs = clashing(spark.createDataFrame(rows, DOCS))
    v = lm.vocabulary(docs)
    out = lm.scored(docs, lm.trained(docs, v), v)
    assert out.columns == ["doc_id", "n_tokens", "log_likelihood", "bits_per_token"]
    got = out.collect()
    assert len(got) == len(rows) and all(math.isfinite(x.log_likelihood) and x.log_likelihood < 0 for x in got)
    by = {x.doc_id: x for x in got}
    assert by[1].n_tokens == by[2].n_tokens == by[3].n_tokens == 1 and by[4].n_tokens == 48_001
    assert by[4].log_likelihood == pytest.approx(by[5].log_likelihood, rel=1e-4)
    twins = [x for x in got if x.doc_id == 8]
    assert len(twins) == 2 and twins[0].log_likelihood == pytest.approx(twins[1].log_likelihood, rel=1e-4)


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 2000)
    r = random.Random(8)
    rows = [(i, sentence(r, r.randint(5, 120)), "en", "s", 1) for i in range(300)]
    scores = []
    for parts in (1, 4):
        docs = spark.createDataFrame(r.sample(rows, len(rows)), DOCS).repartition(parts)
        v = lm.vocabulary(docs)
        assert v.tokens > 8 * 2000
        scores.append({x.doc_id: x.bits_per_token for x in lm.scored(docs, lm.trained(docs, v), v).collect()})
    one, four = scores
    assert max(abs(one[i] - four[i]) for i in one) < 1e-4


def test_counts_of_words_come_with_the_model_or_by_the_join(spark, monkeypatch):
    r = random.Random(6)
    docs = spark.createDataFrame([(i, sentence(r, 30), "en", "s", 1) for i in range(60)], DOCS)
    scores = []
    for common in (lm.COMMON, 12):
        monkeypatch.setattr(lm, "COMMON", common)
        v = lm.vocabulary(docs, words=10, shared=4)
        assert v.common.size == min(common, v.known.count())
        scores.append({x.doc_id: x.log_likelihood for x in lm.scored(docs, lm.trained(docs, v), v).collect()})
    assert all(abs(scores[0][i] - scores[1][i]) < 1e-6 * abs(scores[0][i]) for i in scores[0])


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    v = lm.vocabulary(docs)
    assert lm.scored(docs, lm.trained(docs, v), v).count() == 0


def test_rare_and_unknown_words_cost_more_than_ordinary_text(spark):
    r = random.Random(10)
    words = [f"{chr(97 + k % 26)}{k}" for k in range(3000)]
    weight = [1 / (k + 1) for k in range(3000)]
    text = lambda: " ".join(r.choices(words, weight, k=60))
    rows = [(i, text(), "en", "s", 1) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS).repartition(2)
    v = lm.vocabulary(docs, words=40, shared=4)
    model = lm.trained(docs, v)
    seen = sorted({w for x in rows for w in x[1].split()} - set(words[:60]))
    kinds = [[text() for _ in range(30)], [" ".join(r.choices(seen, k=60)) for _ in range(30)], [" ".join(f"junk{r.random()}" for _ in range(30)) for _ in range(30)]]
    some = [(1000 * k + i, t, "en", "s", 1) for k, ts in enumerate(kinds) for i, t in enumerate(ts)]
    got = {x.doc_id: x.bits_per_token for x in lm.scored(spark.createDataFrame(some, DOCS), model, v).collect()}
    plain, random_words, junk = (np.mean([b for i, b in got.items() if i // 1000 == k]) for k in range(3))
    assert len(got) == 90 and plain + 1 < random_words < junk
    # a word's own share of its id: two documents of one word each differ by the counts
    counts = {w: sum(x[1].split().count(w) for x in rows) for w in seen}
    one = [w for w in seen if v.encode(hashed(w)) == v.encode(hashed(seen[0]))]
    a, b = min(one, key=counts.get), max(one, key=counts.get)
    got = {x.doc_id: x.log_likelihood for x in lm.scored(spark.createDataFrame([(1, a, "en", "s", 1), (2, b, "en", "s", 1)], DOCS), model, v).collect()}
    assert got[2] - got[1] == pytest.approx(math.log(counts[b] / counts[a]), abs=1e-3) and counts[b] > counts[a]


def hashed(word):
    from tessellum.llm import text as tx

    _, _, buf, offs = next(tx.chunks(pa.array([word])))
    starts, ends, _ = tx.spans(buf, offs)
    return tx.span_hashes(buf, starts, ends)
