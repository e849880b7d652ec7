"""Language-model scores of whole documents by a gated recurrent network.

Words (lower case, punctuation ignored) are counted over the whole corpus; the most
frequent ones get ids, the others share ids by hash, and an end mark closes every
document.  A word that shares an id has, given the id, its share of the id's count over
the whole corpus, so every word of the corpus has a probability of its own; one unit of
each id is left to words that the corpus lacks, which are spelled byte by byte, all
bytes alike likely.  Ids are sorted by frequency and cut into classes of like mass, so that the
output is a softmax over classes and one over the words of a class.

Training is truncated backpropagation in numpy.  Every document is used once.  A hash of
its id and text puts it in a round and, there, in a shard, of which a larger corpus has more and
larger ones; a shard trains, in the order of the hash, from the weights that the round
begins with, and the weights, averaged by tokens in a two-level tree, open the next
round.  So the model follows from the rows alone, however files and tasks divide them (test_lm.py
compares one partition with four; scores differ by what sums of 32 bits are rounded by).
What is gathered grows with the corpus, while the driver holds a few models.

Documents run side by side in lanes.  A lane carries its state from window to window
and drops it only where a document begins, so the log-likelihood is that of the
complete document, whatever its length.

Defined results: a null or empty text has just the end mark; a text of any length is
scored whole; rows alike in doc_id and text score alike and each gets a row; null doc_ids
are kept; no documents: no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.llm import text as tx
from tessellum.llm.store import bounded, written

WORDS, SHARED, CLASSES, HIDDEN = 991, 32, 24, 16  # with the end mark 1024 ids
COMMON = 65_536  # words whose counts go along with the model; those of others are looked up by a join
LANES, WINDOW, RATE, ROUNDS, SEED = 512, 32, 0.08, (0.15, 0.85), 29
FILL_BYTES = 24 << 20  # of text that lanes are filled with at a time
SHARD_TOKENS = 500_000  # of the only shard of a small corpus; others have (tokens / SHARD_TOKENS) ** (2 / 3) shards


@dataclass
class Vocabulary:
    """Ids in order of frequency; hashes holds the frequent words' hashes in order, at their ids."""

    hashes: np.ndarray
    ids: np.ndarray
    shared: np.ndarray
    end: int
    counts: np.ndarray
    classes: np.ndarray  # first id of each class, and the number of ids
    tokens: float = 0.0
    common: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # hashes in order, and the logarithms of their counts
    log_counts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    known: DataFrame | None = None  # (h, n) of every word; stays with the driver

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None}

    @property
    def class_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.classes.size - 1, dtype=np.int16), np.diff(self.classes))

    @classmethod
    def of(cls, words: list[tuple[int, int]], rest: list[int], documents: int, classes: int) -> Vocabulary:
        """words: (hash, count); rest: counts of the shared ids."""
        items = [(n, 0, h) for h, n in words] + [(n, 1, i) for i, n in enumerate(rest)] + [(documents, 2, 0)]
        items.sort(key=lambda x: (-x[0], x[1], x[2]))
        at = {(kind, key): i for i, (_, kind, key) in enumerate(items)}
        hashes = np.array(sorted(np.uint64(h) for h, _ in words), dtype=np.uint64)
        counts = np.maximum(np.array([x[0] for x in items], dtype=float), 0.5)
        mass = np.cumsum(np.sqrt(counts))
        cut = np.unique(np.searchsorted(mass, mass[-1] * np.arange(1, classes) / classes, side="left"))
        return cls(
            hashes,
            np.array([at[0, int(h)] for h in hashes], dtype=np.int64),
            np.array([at[1, i] for i in range(len(rest))], dtype=np.int64),
            at[2, 0],
            counts,
            np.unique(np.concatenate([[0], cut, [len(items)]])),
        )

    def encode(self, h: np.ndarray) -> np.ndarray:
        out = self.shared[(h % np.uint64(self.shared.size)).astype(np.int64)]
        if self.hashes.size:
            at = np.minimum(np.searchsorted(self.hashes, h), self.hashes.size - 1)
            out = np.where(self.hashes[at] == h, self.ids[at], out)
        return out.astype(np.int32)

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end marks included, and the first of each text (n + 1 values)."""
        parts, sizes = [], []
        for i, j, buf, offs in tx.chunks(texts):
            starts, ends, first = tx.spans(buf, offs)
            ids = self.encode(tx.span_hashes(buf, starts, ends))
            parts.append(np.insert(ids, first[1:], self.end))
            sizes.append(np.diff(first) + 1)
        if not parts:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


    def rare(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """(text, hash, times, bytes) of each text's words under shared ids, in order of text, but the common ones; and the log-share in the ids of these, and of one unit for the others."""
        out = []
        for i, _, buf, offs in tx.chunks(texts):
            starts, ends, first = tx.spans(buf, offs)
            h, text = tx.span_hashes(buf, starts, ends), i + np.repeat(np.arange(first.size - 1), np.diff(first))
            own = np.isin(self.encode(h), self.shared)
            h, text, size = h[own], text[own], (ends - starts)[own]
            order = np.lexsort((h, text))
            h, text, size = h[order], text[order], size[order]
            head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])[: h.size])
            out.append((text[head], h[head], np.diff(np.append(head, h.size)), size[head]))
        text, h, times, size = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        share = -np.log(self.counts[self.shared] + 1)[(h % np.uint64(self.shared.size)).astype(np.int64)]
        if self.common.size:
            at = np.minimum(np.searchsorted(self.common, h), self.common.size - 1)
            own = self.common[at] == h
            share[own] += self.log_counts[at[own]]
        else:
            own = np.zeros(h.size, dtype=bool)
        total = np.bincount(text, times * share, len(texts))
        return text[~own], h[~own], times[~own], size[~own], total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, count) of a partition's words; merged as they come, so that few rows are shuffled."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n_docs, size = 0, 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        h, n = (np.concatenate(x) for x in zip(*held, strict=True))
        u, at = np.unique(h, return_inverse=True)
        return u, np.bincount(at, n, u.size).astype(np.int64)

    def rows(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(np.zeros(h.size, np.int64))], names=["h", "n", "docs"])

    for batch in batches:
        n_docs += len(batch)
        for _, _, buf, offs in tx.chunks(batch.column(0)):
            starts, ends, _ = tx.spans(buf, offs)
            u, n = np.unique(tx.span_hashes(buf, starts, ends), return_counts=True)
            held.append((u, n))
            size += u.size
            if size > 2_000_000:
                held = [merged()]
                size = held[0][0].size
                if size > 1_000_000:  # give out, and go on
                    yield rows(*held[0])
                    held, size = [], 0
    if held:
        yield rows(*merged())
    yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([n_docs])], names=["h", "n", "docs"])


def vocabulary(docs: DataFrame, words: int = WORDS, shared: int = SHARED, classes: int = CLASSES) -> Vocabulary:
    """Counted over every document; the driver gets one row for each id."""
    counted = bounded(docs).select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "h long, n long, docs long")
    counts = written(counted.groupBy("h").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "words")
    top = counts.where("n > 0").select("h", "n").orderBy(F.desc("n"), "h").limit(max(words, COMMON)).toArrow()
    common = list(zip(top.column("h").to_numpy().view(np.uint64).tolist(), top.column("n").to_pylist(), strict=True))
    frequent = common[:words]
    bucket = F.expr(f"cast(pmod(cast(h as decimal(20, 0)) + if(h < 0, 18446744073709551616, 0), {shared}) as int)")
    got = counts.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).collect()
    rest = [0] * shared
    for r in got:
        rest[r["b"]] += r["n"]
    for h, n in frequent:
        rest[h % shared] -= n
    v = Vocabulary.of(frequent, rest, sum(r["docs"] for r in got), classes)
    common.sort()
    v.common, v.log_counts = np.array([h for h, _ in common], dtype=np.uint64), np.log(np.array([n for _, n in common], dtype=np.float64))
    v.known, v.tokens = counts.where("n > 0").select("h", "n"), float(v.counts.sum())
    return v


@dataclass
class Gru:
    """Weights: input rows (gates z, r, n), state matrix, class and word outputs."""

    x: np.ndarray
    u: np.ndarray
    wc: np.ndarray
    bc: np.ndarray
    wo: np.ndarray
    bo: np.ndarray
    memory: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def fresh(cls, v: Vocabulary, hidden: int = HIDDEN, seed: int = SEED) -> Gru:
        """Small random weights; the biases give the corpus frequencies."""
        r, n = np.random.default_rng(seed), v.counts.size

        def some(*shape: int) -> np.ndarray:
            return (r.standard_normal(shape) * 0.1).astype(np.float32)

        mass = np.add.reduceat(v.counts, v.classes[:-1])
        within = np.log(v.counts / np.repeat(mass, np.diff(v.classes)))
        return cls(some(n, 3 * hidden), some(hidden, 3 * hidden), some(hidden, mass.size), np.log(mass / mass.sum()).astype(np.float32), some(hidden, n), within.astype(np.float32))

    def params(self) -> list[np.ndarray]:
        return [self.x, self.u, self.wc, self.bc, self.wo, self.bo]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params()])

    def filled(self, flat: np.ndarray) -> Gru:
        out, at = [], 0
        for p in self.params():
            out.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Gru(*out)

    def _step(self, a: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        k = h.shape[1]
        g = h @ self.u
        zr = a[:, : 2 * k] + g[:, : 2 * k]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        n = g[:, 2 * k :] * zr[:, k:]
        n += a[:, 2 * k :]
        np.tanh(n, out=n)
        new = h - n
        new *= zr[:, :k]
        new += n
        return new, zr, n, g[:, 2 * k :]

    def window(self, before: np.ndarray, target: np.ndarray, fresh: np.ndarray, live: np.ndarray, h: np.ndarray, v: Vocabulary, learn: bool) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities (steps, lanes) and the state behind; arrays are (steps, lanes). learn: takes a training step."""
        steps, lanes = target.shape
        k = self.u.shape[0]
        a = self.x[before]
        states, kept = np.empty((steps, lanes, k), np.float32), []
        for t in range(steps):
            new_doc = np.flatnonzero(fresh[t])
            if new_doc.size:
                h = h.copy()
                h[new_doc] = 0
            new, zr, n, hn = self._step(a[t], h)
            if learn:
                kept.append((h, zr, n, hn))
            states[t] = h = new
        s, y, on = states.reshape(-1, k), target.ravel(), live.ravel()
        cls = v.class_of[y]
        logits = np.minimum(s @ self.wc + self.bc, 60)  # states are within -1..1: no need to look for a row's greatest
        p = np.exp(logits)
        z = p.sum(axis=1)
        at = np.arange(y.size)
        logp = logits[at, cls] - np.log(z)
        if learn:
            p /= z[:, None]
            p[at, cls] -= 1
            p[~on] = 0
            scale = np.float32(1 / max(1, int(on.sum())))
            grad = [None, None, s.T @ p, p.sum(axis=0), np.zeros_like(self.wo), np.zeros_like(self.bo)]
            ds = p @ self.wc.T
        order = np.argsort(cls, kind="stable")
        cut = np.searchsorted(cls[order], np.arange(v.classes.size))
        for c in range(v.classes.size - 1):
            own = order[cut[c] : cut[c + 1]]
            if not own.size:
                continue
            b, e = v.classes[c], v.classes[c + 1]
            if e - b == 1:
                continue
            so = s[own]
            lo = np.minimum(so @ self.wo[:, b:e] + self.bo[b:e], 60)
            q = np.exp(lo)
            zq = q.sum(axis=1)
            i, hit = np.arange(own.size), y[own] - b
            logp[own] += lo[i, hit] - np.log(zq)
            if learn:
                q /= zq[:, None]
                q[i, hit] -= 1
                q[~on[own]] = 0
                grad[4][:, b:e] = so.T @ q
                grad[5][b:e] = q.sum(axis=0)
                ds[own] += q @ self.wo[:, b:e].T
        if learn:
            ds = ds.reshape(steps, lanes, k)
            da, dg = np.empty((steps, lanes, 3 * k), np.float32), np.empty((steps, lanes, 3 * k), np.float32)
            hs, zr, n, hn = (np.stack(x) for x in zip(*kept, strict=True))
            # all that does not depend on the gradient behind, for all steps at once
            slope = zr * (1 - zr)
            to_z = (hs - n) * slope[:, :, :k]
            to_n = (1 - zr[:, :, :k]) * (1 - n * n)
            to_r = hn * slope[:, :, k:]
            ut = np.ascontiguousarray(self.u.T)
            dh = np.zeros((lanes, k), np.float32)
            for t in range(steps - 1, -1, -1):
                dh += ds[t]
                d, g = da[t], dg[t]
                np.multiply(dh, to_z[t], out=d[:, :k])
                np.multiply(dh, to_n[t], out=d[:, 2 * k :])
                np.multiply(d[:, 2 * k :], to_r[t], out=d[:, k : 2 * k])
                g[:, : 2 * k] = d[:, : 2 * k]
                np.multiply(d[:, 2 * k :], zr[t, :, k:], out=g[:, 2 * k :])
                dh *= zr[t, :, :k]
                dh += g @ ut
                dh[fresh[t]] = 0
            grad[1] = hs.reshape(-1, k).T @ dg.reshape(-1, 3 * k)
            ids = before.ravel()
            by = np.argsort(ids.astype(np.int16) if v.counts.size < 1 << 15 else ids, kind="stable")
            head = np.flatnonzero(np.concatenate([[True], np.diff(ids[by]) != 0]))
            rows = ids[by[head]]
            gx = np.add.reduceat(da.reshape(-1, 3 * k)[by], head, axis=0) * scale
            if not self.memory:
                self.memory = [np.full_like(w, 1e-8) for w in self.params()]
            self.memory[0][rows] += gx * gx
            self.x[rows] -= RATE * gx / np.sqrt(self.memory[0][rows])
            for w, m, g in zip(self.params()[1:], self.memory[1:], grad[1:], strict=True):
                g = g * scale
                m += g * g
                w -= RATE * g / np.sqrt(m)
        return logp.reshape(steps, lanes), h

    def run(self, ids: np.ndarray, first: np.ndarray, v: Vocabulary, learn: bool = False, lanes: int = LANES, steps: int = WINDOW) -> np.ndarray:
        """The log-likelihood of each document; first: each one's first id (n + 1 values)."""
        size = np.diff(first)
        if not size.size:
            return np.zeros(0)
        lanes = min(lanes, size.size)
        # longest first onto the shortest lane, in rounds of as many documents as there are lanes
        order, load, lane, place = np.argsort(-size, kind="stable"), np.zeros(lanes, np.int64), np.empty(size.size, np.int64), np.empty(size.size, np.int64)
        for at in range(0, size.size, lanes):
            d = order[at : at + lanes]
            free = np.argsort(load, kind="stable")[: d.size]
            lane[d], place[d] = free, load[free]
            load[free] += size[d]
        rank = np.empty(lanes, np.int64)
        rank[np.argsort(-load, kind="stable")] = np.arange(lanes)  # longest lanes first: those that live are a prefix
        lane, load = rank[lane], -np.sort(-load)
        # lanes lie behind one another, each filled up to whole windows: a very long one costs only its own length
        begin = np.concatenate([[0], np.cumsum(-(-load // steps) * steps)])
        target, fresh, live = np.full(begin[-1], v.end, np.int32), np.zeros(begin[-1], bool), np.zeros(begin[-1], bool)
        head = begin[lane] + place
        flat = np.repeat(head - first[:-1], size) + np.arange(ids.size)
        target[flat], live[flat], fresh[head] = ids, True, True
        before = np.full_like(target, v.end)
        before[1:] = target[:-1]
        before[head] = v.end
        h, out = np.zeros((lanes, self.u.shape[0]), np.float32), np.empty(begin[-1], np.float32)
        for t in range(0, int(load[0]), steps):
            n = int(np.searchsorted(-load, -t))
            at = begin[:n] + t + np.arange(steps)[:, None]
            logp, h = self.window(before[at], target[at], fresh[at], live[at], h[:n], v, learn)
            out[at] = logp
        c = np.concatenate([[0], np.cumsum(out[flat], dtype=np.float64)])
        return c[first[1:]] - c[first[:-1]]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that fill the lanes, however small the batches were cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= FILL_BYTES:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _learn(batches: Iterator[pa.RecordBatch], model: Gru, v: Vocabulary) -> Iterator[pa.RecordBatch]:
    """One row: the shard, its tokens and its weights."""
    own, tokens, shard = model.filled(model.flat().copy()), 0, None
    for batch in _joined(batches):
        ids, first = v.documents(batch.column(1))
        if ids.size:
            own.run(ids, first, v, learn=True)
            tokens += int(ids.size)
            shard = batch.column(0)[0].as_py()
    if tokens:
        weights = pa.array([own.flat().astype(np.float32).tobytes()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([tokens]), weights], names=["part", "tokens", "weights"])


def _average(table: pa.Table) -> tuple[int, np.ndarray]:
    table = table.sort_by("part")
    n = np.array(table.column("tokens"), dtype=np.float64)
    total = sum(w * np.frombuffer(b, dtype=np.float32) for w, b in zip(n, table.column("weights").to_pylist(), strict=True))
    return int(n.sum()), (total / n.sum()).astype(np.float32)


def _branch(table: pa.Table) -> pa.Table:
    tokens, weights = _average(table)
    return pa.table({"part": table.column("part").slice(0, 1), "tokens": [tokens], "weights": pa.array([weights.tobytes()], pa.binary())})


def trained(docs: DataFrame, v: Vocabulary, rounds: tuple[float, ...] = ROUNDS, hidden: int = HIDDEN) -> Gru:
    """The model after all rounds, which share all documents between them."""
    model = Gru.fresh(v, hidden)
    spark, schema = docs.sparkSession, "part long, tokens long, weights binary"
    place = F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    texts = bounded(docs).select(place.alias("place"), F.col("text").cast("string").alias("text"))
    when = F.pmod("place", F.lit(1 << 30))
    shards = max(1, math.ceil((v.tokens / SHARD_TOKENS) ** (2 / 3)))
    shard = F.pmod(F.shiftrightunsigned("place", 30), F.lit(shards))
    edges = [round((1 << 30) * x) for x in np.cumsum([0.0, *rounds]) / sum(rounds)]
    for low, high in zip(edges, edges[1:], strict=False):
        held = spark.sparkContext.broadcast((model, v))  # a fixed size, whatever the corpus
        own = texts.where((when >= low) & (when < high)).withColumn("shard", shard).repartitionById(shards, F.col("shard").cast("int"))
        own = own.sortWithinPartitions("place").select("shard", "text").mapInArrow(lambda it, held=held: _learn(it, *held.value), schema)
        own = written(own, "weights")
        n = own.count()
        if not n:
            continue
        branches = own.groupBy((F.col("part") % max(1, math.isqrt(n))).alias("branch")).applyInArrow(_branch, schema)
        model = model.filled(_average(branches.toArrow())[1])
    return model


def scored(docs: DataFrame, model: Gru, v: Vocabulary) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, bits_per_token) of every document."""
    held = docs.sparkSession.sparkContext.broadcast((model, v))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vocab = held.value
        row = TaskContext.get().partitionId() << 40
        for batch in _joined(batches):
            ids, first = vocab.documents(batch.column(1))
            text, h, times, size, share = vocab.rare(batch.column(1))
            at = pa.array(np.searchsorted(text, np.arange(len(batch) + 1)).astype(np.int32))
            words = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(times.astype(np.int32)), pa.array(size.astype(np.int32))], names=["h", "times", "size"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(len(batch))), batch.column(0), pa.array(np.diff(first)), pa.array(own.run(ids, first, vocab) + share), pa.ListArray.from_arrays(at, words)],
                names=["row", "doc_id", "n_tokens", "ll", "words"],
            )
            row += len(batch)

    narrow = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = written(narrow.mapInArrow(work, "row long, doc_id long, n_tokens long, ll double, words array<struct<h:long,times:int,size:int>>"), "scores")
    asked = base.select("row", F.explode("words").alias("w")).select("row", "w.*")
    each = F.when(F.col("n").isNull(), -(F.col("size") + 1) * math.log(257)).otherwise(F.log("n"))
    terms = asked.join(v.known, "h", "left").groupBy("row").agg(F.sum(F.col("times") * each).alias("term"))
    ll = F.col("ll") + F.coalesce("term", F.lit(0.0))
    return base.join(terms, "row", "left").select(
        "doc_id", "n_tokens", ll.alias("log_likelihood"), (-ll / F.greatest("n_tokens", F.lit(1)) / math.log(2)).alias("bits_per_token")
    )
