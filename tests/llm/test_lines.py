import random

import numpy as np
import pyarrow as pa

from tessellum.llm import lines as L
from tessellum.llm import text as tx
from tests.llm.cases import DOCS, awkward, clashing, sentence


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(line):
    import re

    return re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", line.lower()).strip(" ")


def brute(rows):
    """Texts without the lines that an all-pairs search finds surplus."""
    order = sorted({(r[0], r[1]) for r in rows if r[1]})
    lines = []
    for doc, text in order:
        for i, j, buf, offs in tx.chunks(pa.array([text])):
            of, number, whole, _ = L.line_hashes(buf, offs)
            sim, _, values = L.line_sketches(buf, offs, of, number)
            parts = text.split("\n")
            assert values.to_pylist() == [plain(parts[n]) for n in number]
            lines += [(doc, int(n), int(w), int(s) & (1 << 64) - 1, plain(parts[n])) for n, w, s in zip(number, whole, sim, strict=True)]
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            a, b = lines[i], lines[j]
            same = a[2] == b[2]
            if not same and (a[3] ^ b[3]).bit_count() <= L.DISTANCE:
                same = edits(a[4], b[4]) <= int((1 - L.SIMILARITY) * max(len(a[4]), len(b[4])) + 1e-9)
            if same:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    gone = {(lines[i][0], lines[i][1]) for i in range(len(lines)) if find(i) != i}
    return {doc: "\n".join(x for n, x in enumerate(text.split("\n")) if (doc, n) not in gone) for doc, text in order}


def test_results_agree_with_brute_force(spark):
    r, pool = random.Random(4), []
    for _ in range(25):
        base = sentence(r, 30).split()
        pool.append(" ".join(base))
        for _ in range(4):
            own = list(base)
            own[r.randrange(30)] = r.choice([sentence(r, 1), own[0].upper() + ",", "a"])
            pool.append(r.choice(["", "  ", "- "]) + " ".join(own))
    rows = [(i, "\n".join(r.choice(pool) for _ in range(6)), "en", "s", 9) for i in range(40)]
    got = {x.doc_id: x for x in L.deduplicated(spark.createDataFrame(rows, DOCS), counts=True).collect()}
    want = brute(rows)
    assert {k: v.text for k, v in got.items()} == want
    assert sum(v.n_dropped for v in got.values()) > 100
    assert all(v.n_chars == len(v.text) for v in got.values() if v.n_dropped)


def test_awkward_rows(spark):
    rows = awkward()
    docs = clashing(spark.createDataFrame(rows, DOCS))
    out = L.deduplicated(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(rows)
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x.text)
    assert by[1] == [None] and by[2] == [""] and by[3] == [" \n\t\n "]
    assert by[4] == [rows[3][1]] and by[5] == [""] and by[6] == ["one"] and by[7] == [""]
    assert by[None] == [rows[7][1]] and by[8] == [rows[8][1]] * 2


def test_empty_table(spark):
    assert L.deduplicated(spark.createDataFrame([], DOCS), counts=True).count() == 0


def test_edit_distances_against_the_table_of_prefixes():
    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r, pairs = random.Random(1), [("", ""), ("", "abc"), ("a" * 64, "a" * 65), ("é☃", "𝄞")]
    for _ in range(250):
        a = "".join(r.choice("abcdé☃𝄞 ") for _ in range(r.choice([0, 1, 5, 63, 64, 65, 127, 128, 129, 200])))
        b = list(a)
        for _ in range(r.randint(0, 20)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randint(0, 1)] = r.choice(["", "x", "q", "a"])
        pairs.append((a, "".join(b)))
    want = [table(a, b) for a, b in pairs]
    assert L.edits(pairs).tolist() == L._edits_by_blocks(pairs).tolist() == [L._edits_by_integers(a, b) for a, b in pairs] == want
    assert L.edits([]).tolist() == []
    for part in (pairs, pairs * 9):
        most = np.array([r.choice([0, 3, 20, 90, 200]) for _ in part])
        exact = np.array(want * (len(part) // len(pairs)))
        for got in (L.edits(part, most), L._edits_by_blocks(part, most)):
            assert ((got == exact) | ((got > most) & (exact > most))).all()
    sure = [1 - d / max(1, len(a), len(b)) >= 0.85 for d, (a, b) in zip(want[1:], pairs[1:], strict=True)]
    assert L.similar(pairs[1:], 0.85).tolist() == sure


def typo(r, line):
    k = r.randrange(len(line))
    return line[:k] + r.choice("qxzjk") + line[k + 1 :]


def replaced(r, line):
    words = line.split()
    words[r.randrange(len(words))] = sentence(r, 1)
    return " ".join(words)


def changed(r, n):
    """(line, its copy) with a typo in 20 words, a word of 12 or three of 40 replaced; all of edit similarity 0.85."""
    out = []
    while len(out) < n:
        size, change, times = r.choice([(20, typo, 1), (12, replaced, 1), (40, replaced, 3)])
        a = b = sentence(r, size)
        for _ in range(times):
            b = change(r, b)
        if plain(a) != plain(b) and edits(plain(a), plain(b)) <= 0.15 * max(len(plain(a)), len(plain(b))):
            out.append((a, b))
    return out


def test_copies_are_found_by_edit_similarity_alone(spark):
    pairs = changed(random.Random(7), 240)
    rows = [(i, x, "en", "s", 1) for i, x in enumerate([a for a, _ in pairs] + [b for _, b in pairs])]
    got = {x.doc_id: x.text for x in L.deduplicated(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i] == a for i, (a, _) in enumerate(pairs))
    assert sum(got[len(pairs) + i] == "" for i in range(len(pairs))) >= 0.9 * len(pairs)


def test_quick_bound_is_never_below_the_edit_distance():
    r = random.Random(8)
    for _ in range(200):
        a = [sentence(r, 1) for _ in range(r.randint(1, 12))]
        b = [w for w in a if r.random() < 0.9]
        b.insert(r.randrange(len(b) + 1), r.choice(["x", sentence(r, 1)]))
        a, b = " ".join(a), " ".join(b)
        assert edits(a, b) <= L._at_most(a, b)


def test_rows_that_are_most_of_the_table(spark):
    r = random.Random(2)
    text = "\n".join(sentence(r, 8) for _ in range(5))
    rows = [(7, text, "en", "s", 1)] * 400 + [(9, sentence(r, 8) + "\n" + text, "en", "s", 1), (3, sentence(r, 9), "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = L.deduplicated(docs).collect()
    assert len(got) == 402 and {x.text for x in got if x.doc_id == 7} == {text}
    assert {x.text for x in got if x.doc_id == 9} == {rows[400][1].split("\n")[0]}


def test_bounded_distances_of_long_pairs():
    r = random.Random(5)
    for _ in range(60):
        size = r.choice([1, 40, 300, 700])
        a = "".join(r.choice("ab cd") for _ in range(size))
        b = list(a)
        for _ in range(r.randint(0, max(1, size // 3))):
            k = r.randrange(len(b) + 1)
            b[k : k + r.choice([0, 1, 1, 2])] = r.choice(["", "x", "ab", "c"])
        b = "".join(b)
        want = L._edits_by_integers(a, b)
        for most in {max(0, want - 1), want, want + 1, size // 7, r.randint(0, size)}:
            got = L._edits_by_integers(a, b, most)
            assert got == want or min(got, want) > most


def test_lines_travel_by_parts():
    """A row for each part; a line's further places are told apart from its first one, but for rows that are repeated."""
    texts = ["a b\nc, d\nA  B", "x\n\nc d", "x\n\nc d"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 2]), pa.array([10, 20, 20]), pa.array(texts)], names=["doc", "th", "text"])
    rows = pa.concat_batches(list(L._lines(iter([batch]), 2)))
    assert len(rows) <= 2
    size, data, *gone = [np.concatenate(x) for x in zip(*L.buckets.unpacked(iter([rows]), list(L.LINES.values())), strict=True)][5:]
    cut = np.append(0, np.cumsum(size))
    assert sorted(data[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)) == [b"a b", b"c d", b"x"]
    assert set(zip(*(x.tolist() for x in gone), strict=True)) == {(1, 10, 2), (2, 20, 2)}


def test_lines_of_unlike_length_are_no_candidates():
    """Nothing that is similar is left out, and most that lengths forbid is."""
    size = np.arange(1, 1500)
    mark = L._lengths(pa.array(["x" * n for n in size]), L.SIMILARITY).view(np.int64)
    near = L.buckets.Near(L.DISTANCE, L.BITS, L.APART)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(size.size), np.arange(size.size)))
    longer = np.maximum(size[a], size[b])
    may = np.abs(size[a] - size[b]) <= np.floor((1 - L.SIMILARITY) * longer + 1e-9)
    got = L.buckets._near(mark[a], mark[b], near)
    assert not (may & ~got).any()
    assert got[~may].mean() < 0.3
    key, grp, side = (np.arange(size.size), np.arange(size.size), np.full(size.size, L.buckets.BLOCK_SIDE))
    side[::2] = L.buckets.MAJOR
    pairs = list(L.buckets._candidates(0, size.size, key, mark, grp, side, near))
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    u, w = np.meshgrid(key[side == L.buckets.BLOCK_SIDE], key[side == L.buckets.MAJOR], indexing="ij")
    ok = L.buckets._near(mark[u], mark[w], near)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(u[ok].tolist(), w[ok].tolist(), strict=True))
    for similarity in (0.0, 0.3, 1.0):
        own = L._lengths(pa.array(["x" * n for n in size]), similarity).view(np.int64)
        may = np.abs(size[a] - size[b]) <= np.floor((1 - similarity) * longer + 1e-9)
        assert L.buckets._near(own[a], own[b], near)[may].all()


def test_pairs_beyond_their_bounds_are_left_early(monkeypatch):
    """Distances within the bounds are exact, and pairs of no similarity take few steps."""
    r, looks = random.Random(11), []
    least = L._least
    monkeypatch.setattr(L, "_least", lambda step, *x: looks.append(step) or least(step, *x))
    text = lambda n: "".join(r.choice("abcd é☃") for _ in range(n))
    for size in (1, 63, 64, 65, 200, 700):
        pairs = []
        for _ in range(25):
            a = text(r.randint(size // 2, size))
            b = list(a)
            for _ in range(r.choice([0, 1, size // 20, size // 5])):
                k = r.randrange(len(b) + 1)
                b[k : k + r.choice([0, 1])] = r.choice(["", "x", "ab"])
            pairs.append((a, r.choice(["".join(b), text(len(a))])))
        most = np.array([r.choice([0, 1, 64, max(map(len, x)) // 7]) for x in pairs])
        want = np.array([L._edits_by_integers(*x) for x in pairs])
        got = L._edits_by_blocks(pairs, most)
        assert ((got == want) | ((got > most) & (want > most))).all()
    looks.clear()
    assert (L._edits_by_blocks([("a" * 2000, "b" * 2000)] * 3, np.full(3, 100)) > 100).all()
    assert max(looks) < 500
