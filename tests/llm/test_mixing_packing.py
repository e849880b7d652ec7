import math
import random
from bisect import bisect_left, insort
from collections import Counter

import duckdb
import pytest

from tessellum.llm import mixing, packing
from tests.llm.cases import DOCS, awkward, clashing, sentence


def some_docs(n=200, seed=1):
    r = random.Random(seed)
    return [(i, sentence(r, r.randint(1, 60)), "en", r.choice("aaaaaaaaaabbbccd"), 1) for i in range(n)]


@pytest.mark.parametrize("entropy,max_epochs", [(mixing.ENTROPY, mixing.MAX_EPOCHS), (0.99, 100.0), (0.9, 1.5), (0.0, 4.0)])
def test_mixture_agrees_with_sql(spark, entropy, max_epochs):
    rows = some_docs() + awkward()
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mixed(docs, entropy, max_epochs, with_order=True).select("doc_id", "source", "block", "order_key", "n_tokens").fillna("", ["source"]).collect()
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(mixing.sql(entropy, max_epochs)).fetchall()
    key = lambda x: tuple("" if v is None else str(v) for v in x)
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, want))


def weights(tokens, a):
    return [n**a / sum(m**a for m in tokens) for n in tokens]


def test_exponent_meets_the_targets():
    tokens = [1000, 400, 100, 10]
    w = weights(tokens, mixing.exponent(tokens, 0.9, 1e9))
    assert math.isclose(-sum(x * math.log(x) for x in w), 0.9 * math.log(4), abs_tol=1e-6)
    w = weights(tokens, mixing.exponent(tokens, 0.999, 3.0))
    assert math.isclose(w[3] / 10 / (w[0] / 1000), 3.0, rel_tol=1e-6)
    w = weights(tokens, mixing.exponent(tokens, 0.999, 3.0, 1510))
    assert math.isclose(max(x * 1510 / n for x, n in zip(w, tokens, strict=True)), 3.0, rel_tol=1e-6)
    assert mixing.exponent(tokens, 0.1, 1.0) == 1.0
    with pytest.raises(ValueError):
        mixing.exponent(tokens, 0.9, 2.0, 4000)


@pytest.mark.parametrize("seed", range(20))
def test_natural_weights_give_every_document_once(seed):
    r = random.Random(seed)
    tokens = {f"s{i}": r.randint(1, 10**9) for i in range(r.randint(1, 30))}
    assert [(s.tokens, s.full, s.rest) for s in mixing.shares(tokens, 0.0, 4.0, None)] == [(tokens[k], 1, 0) for k in sorted(tokens)]
    assert sum(s.budget for s in mixing.shares(tokens, 0.9, 1e9, 12345)) == 12345


def test_natural_mixture_is_the_identity(spark):
    rows = some_docs(300, 3) + awkward()
    docs = spark.createDataFrame(rows, DOCS)
    some = Counter((r[0], r[1]) for r in rows if (r[3] or "") and r[1])
    got = Counter((r.doc_id, r.text) for r in mixing.mixed(docs, entropy=0.0).collect() if r.source and r.text)
    assert got == some


def test_budgets_are_met_to_within_half_a_document(spark):
    rows = some_docs(300, 3)
    docs = spark.createDataFrame(rows, DOCS)
    for budget in (None, 3000):
        got = mixing.mixed(docs, budget=budget, with_order=True).collect()
        counts = Counter()
        for r in rows:
            counts[r[3]] += len(r[1].split())
        spent = Counter()
        for g in got:
            spent[g.source] += g.n_tokens
        for s in mixing.shares(dict(counts), mixing.ENTROPY, mixing.MAX_EPOCHS, budget):
            assert abs(spent[s.source] - s.budget) <= 30
            assert budget or s.full
        # whole blocks hold each document once
        for (doc, block), n in Counter((g.doc_id, g.block) for g in got).items():
            assert n == 1 and (block == 0 or (doc, block - 1) in {(g.doc_id, g.block) for g in got})
    assert max(s.full for s in mixing.shares(dict(counts), mixing.ENTROPY, mixing.MAX_EPOCHS, None)) > 1


def test_awkward_rows_pass_with_all_columns(spark):
    docs = clashing(spark.createDataFrame(awkward(), DOCS))
    out = mixing.mixed(docs, entropy=0.0)
    assert out.columns == docs.columns
    assert out.count() > 0
    assert mixing.mixed(spark.createDataFrame([], DOCS)).count() == 0
    assert mixing.mixed(spark.createDataFrame([(1, None, "en", "a", 0)], DOCS)).count() == 0


def best_fit_decreasing(lengths, capacity):
    spaces, bins = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect_left(spaces, n)
        if i < len(spaces):
            s = spaces.pop(i)
        else:
            s, bins = capacity, bins + 1
        if s > n:
            insort(spaces, s - n)
    return bins


@pytest.mark.parametrize("seed", range(60))
def test_plan_uses_as_many_bins_as_best_fit_over_documents(seed):
    r = random.Random(seed)
    capacity = r.choice([5, 20, 64])
    lengths = [r.randint(1, capacity) for _ in range(r.randint(1, 300))]
    seen, ranks = set(), Counter()
    for n, a, b, first, n_bins, offset in packing.plan(Counter(lengths), capacity):
        assert a == ranks[n]
        ranks[n] = b
        for i in range(b - a):
            at = offset + i // n_bins * n
            assert at + n <= capacity
            cells = {(first + i % n_bins, x) for x in range(at, at + n)}
            assert not cells & seen
            seen |= cells
    assert ranks == Counter(lengths)
    assert len({b for b, _ in seen}) == best_fit_decreasing(lengths, capacity)


def test_every_token_gets_one_slot(spark):
    rows = some_docs(150, 9) + awkward()
    docs = clashing(spark.createDataFrame(rows, DOCS))
    capacity = 50
    got = packing.packed(docs, capacity=capacity, bucket_rows=40).collect()
    want, seen = Counter(), Counter()
    waves = {}  # lengths by copy
    for r in rows:
        n = len((r[1] or "").split())
        lengths = waves.setdefault(seen[r[0], n], [])
        seen[r[0], n] += 1
        for p in range(-(-n // capacity)):
            size = min(capacity, n - p * capacity)
            want[r[0], p, p * capacity, size] += 1
            lengths.append(size)
    assert Counter((g.doc_id, g.piece, g.first_token, g.n_tokens) for g in got) == want
    cells = [(g.bin_id, g.bin_offset + i) for g in got for i in range(g.n_tokens)]
    assert len(cells) == len(set(cells)) and max(c for _, c in cells) < capacity
    bins = {g.bin_id for g in got}
    assert bins == set(range(len(bins))) and len(waves) == 2
    assert len(bins) == sum(best_fit_decreasing(x, capacity) for x in waves.values())


@pytest.mark.parametrize("waves", [2, 16])
def test_no_sequence_holds_two_copies(spark, waves):
    r = random.Random(4)
    docs = [(i, sentence(r, r.randint(1, 9)), "en", "s", 1) for i in range(120)]
    rows = [d for d in docs for _ in range(r.choice([1, 3, 10]))]
    got = packing.packed(spark.createDataFrame(rows, DOCS), capacity=20, waves=waves).collect()
    assert Counter(g.doc_id for g in got) == Counter(d[0] for d in rows)
    cells = [(g.bin_id, g.bin_offset + i) for g in got for i in range(g.n_tokens)]
    assert len(cells) == len(set(cells)) and max(c for _, c in cells) < 20
    twice = sum(n - 1 for n in Counter((g.bin_id, g.doc_id) for g in got).values())
    assert twice == 0 or waves == 2  # with more copies than waves some share a sequence, but no slot


def test_a_document_that_is_most_of_the_rows(spark):
    rows = [(1, "a b c", "en", "s", 1)] * 3000 + [(i, "x " * (i % 7 + 1), "en", "s", 1) for i in range(2, 200)]
    got = packing.packed(spark.createDataFrame(rows, DOCS), capacity=10).collect()
    assert Counter(g.doc_id for g in got) == Counter(d[0] for d in rows)
    cells = [(g.bin_id, g.bin_offset + i) for g in got for i in range(g.n_tokens)]
    assert len(cells) == len(set(cells)) and max(c for _, c in cells) < 10


def test_nothing_to_pack(spark):
    assert packing.packed(spark.createDataFrame([], DOCS)).count() == 0
    assert packing.packed(spark.createDataFrame([(1, None, "en", "a", 0), (2, "", "en", "a", 0)], DOCS)).count() == 0
