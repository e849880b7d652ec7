import random

import numpy as np
import pyarrow as pa
import pytest

from tessellum.llm import minhash as m
from tessellum.llm import text as tx
from tests.llm.cases import DOCS, awkward, clashing, sentence


def sets_of(texts):
    out = []
    for i, j, buf, offs in tx.chunks(pa.array(texts)):
        h, d = m.shingles(buf, offs)
        out += [set(h[d == k].tolist()) for k in range(j - i)]
    return out


def brute(rows, threshold):
    """Groups by true Jaccard similarity of the pair sets."""
    rows = [r for r in rows if r[0] is not None]
    s, root = sets_of([r[1] for r in rows]), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            union = len(s[i] | s[j])
            if (len(s[i] & s[j]) / union if union else 1) >= threshold:
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), set()).add(r[0])
    return sorted(sorted(g) for g in groups.values() if len(g) > 1)


def listed(found):
    """{class: its documents}, checked for what n_links promises."""
    out = {}
    for g in found.collect():
        out.setdefault(g.class_doc_id, []).append(g.doc_id)
        assert g.n_links > 0
    for k, v in out.items():
        v.sort()
        assert k == v[0] and len(v) > 1
    return out


def test_groups_agree_with_brute_force(spark):
    r, rows = random.Random(7), []
    for base in range(12):
        words = sentence(r, 150).split()
        for copy in range(r.randint(1, 5)):
            own = list(words)
            for _ in range(4 * copy):
                own[r.randrange(len(own))] = sentence(r, 1)
            rows.append((base * 10 + copy, " ".join(own), "en", "s", 1))
    for block, span in ((2048, 16384), (2, 3)):
        got = listed(m.duplicates(spark.createDataFrame(rows, DOCS), block=block, span=span))
        assert sorted(got.values()) == brute(rows, m.THRESHOLD)


def test_a_large_group_of_near_copies_is_one(spark):
    r = random.Random(3)
    words = sentence(r, 200).split()
    rows = []
    for i in range(300):
        own = list(words)
        for _ in range(5):
            own[r.randrange(200)] = sentence(r, 1)
        rows.append((i, " ".join(own), "en", "s", 1))
    assert listed(m.duplicates(spark.createDataFrame(rows, DOCS))) == {0: list(range(300))}


def test_awkward_rows(spark):
    docs = clashing(spark.createDataFrame(awkward(), DOCS))
    assert listed(m.duplicates(docs)) == {1: [1, 2, 3], 4: [4, 5], 6: [6, 7]}
    left = m.deduplicated(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.select("doc_id").collect()]
    assert {2, 3, 5, 7}.isdisjoint(ids) and {1, 4, 6, None} <= set(ids) and ids.count(8) == 2 and len(ids) == 26


def test_empty_table(spark):
    assert m.duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert m.deduplicated(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("similarity", [0.6, 0.8, 0.95])
def test_odd_sketches_estimate_high_similarities(similarity):
    r = np.random.default_rng(0)
    n, errors = 600, []
    for _ in range(40):
        same = int(n * 2 * similarity / (1 + similarity))
        both = r.integers(0, 1 << 63, 2 * n - same, dtype=np.uint64)
        a, b = both[:n], both[n - same :]
        h, doc = np.concatenate([a, b]), np.repeat([0, 1], n)
        odd = m.odd_sketches(m.signatures(h, doc, 2))
        errors.append(m.estimate(odd[0], odd[1]) - same / (2 * n - same))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_one_id_with_several_texts(spark):
    r = random.Random(5)
    x, y, z = (sentence(r, 60) for _ in range(3))
    docs = spark.createDataFrame([(1, x, "en", "s", 1), (2, y, "en", "s", 1), (2, x, "en", "s", 1), (2, z, "en", "s", 1), (3, z, "en", "s", 1)], DOCS)
    assert sorted((r.doc_id, r.text) for r in m.deduplicated(docs).collect()) == sorted([(1, x), (2, y), (2, z)])
    assert listed(m.duplicates(docs)) == {1: [1, 2], 2: [2, 3]}
