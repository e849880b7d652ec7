"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text gets a lookup table over its quantile bins, learnt by cyclic
gradient boosting: in turn, a shallow tree of one feature takes a small step down the
logistic loss.  The pairs of features that explain most of what is left get tables of
two dimensions in the same way.  A score is the sigmoid of a sum of table entries, so
scoring is a handful of vectorised additions, and the model is a few kilobytes.

The model is fitted on at most about MAX_LABELS labelled rows, picked by a hash of
doc_id; everything else sees all rows.  The threshold lets KEEP_GOOD of the rows
labelled good pass, but is never above one half.

Defined results: null texts score as empty ones; texts of any length are measured whole;
of rows with a doc_id labelled more than once the least label counts; of rows that
repeat a labelled doc_id the one with the least features is fitted; null labels and ids are
left out of the fit; without labels of both kinds every document passes with a score of
1; repeated rows score alike; an empty table gives an empty one; other columns are kept
as they are, whatever their names (scored() replaces one of the name it is given).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.llm import text as tx
from tessellum.llm.store import bounded, unused

MAX_LABELS, KEEP_GOOD = 20_000, 0.995
MAIN_BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, PENALTY = 48, 12, 120, 60, 8, 0.1, 4.0

FEATURES = (
    "log_bytes", "words_per_line", "word_bytes", "long_word_share", "upper_share", "digit_share", "symbol_share", "mark_share",
    "wide_share", "shout_share", "symbol_word_share", "repeat_share", "distinct_share", "log_lines",
)


def _kind(chars: bytes | range) -> np.ndarray:
    t = np.zeros(256, dtype=np.int64)
    t[list(chars)] = 1
    return t


_UPPER, _DIGIT, _SYMBOL, _MARK, _WIDE, _BREAK, _SHOUT = (
    _kind(x) for x in (range(65, 91), range(48, 58), b"#$%&*|<>{}[]=\\/@^~_+", b".,;:!?'\"-()", range(128, 256), b"\n", b"!")
)
_SYMBOLIC = _SYMBOL.astype(bool)


def features(texts: pa.Array) -> np.ndarray:
    """(rows, features) of whole texts."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, j, buf, offs in tx.chunks(texts, lower=False):
        n_bytes = np.diff(offs).astype(float)

        def share(kind: np.ndarray, buf: np.ndarray = buf, offs: np.ndarray = offs) -> np.ndarray:
            return tx.segment_sums(kind[buf], offs).astype(float)

        starts, ends, first = tx.spans(buf, offs, tx.VISIBLE_BYTE)
        words = np.diff(first).astype(float)
        size = ends - starts
        h = tx.span_hashes(buf, starts, ends)
        doc = np.repeat(np.arange(j - i), np.diff(first))
        again = np.zeros(h.size, dtype=np.int64)
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        own = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        fresh = np.ones(own.size, dtype=bool)
        fresh[1:] = own[1:] != own[:-1]
        distinct = np.bincount((own[fresh] >> np.uint64(40)).astype(np.int64), minlength=j - i)
        c = np.concatenate([[0], np.cumsum(_SYMBOLIC[buf])])
        with_symbol = (c[ends] > c[starts]).astype(np.int64)
        lines = share(_BREAK) + 1
        b, w = np.maximum(n_bytes, 1), np.maximum(words, 1)
        out[i:j] = np.column_stack([
            np.log1p(n_bytes), words / lines, tx.segment_sums(size, first) / w, tx.segment_sums((size > 16).astype(np.int64), first) / w,
            share(_UPPER) / b, share(_DIGIT) / b, share(_SYMBOL) / b, share(_MARK) / b, share(_WIDE) / b, share(_SHOUT) / b,
            tx.segment_sums(with_symbol, first) / w, tx.segment_sums(again, first) / w, distinct / w, np.log(lines),
        ])
    return out


@dataclass
class Model:
    """Bin edges and tables; scores by additions alone."""

    base: float = 40.0
    edges: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    threshold: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for k, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            f += t[np.searchsorted(e, x[:, k], side="right")]
        for (a, b), t in self.pairs.items():
            f += t[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return f

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + PENALTY)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values of the best shallow tree over the bins of one feature."""
    value = np.full(g.size, g.sum() / (h.sum() + PENALTY))
    if depth and g.size > 1:
        cg, ch = np.cumsum(g), np.cumsum(h)
        gain = (_gain(cg, ch) + _gain(cg[-1] - cg, ch[-1] - ch))[:-1]
        cut = int(gain.argmax()) + 1
        if gain[cut - 1] > _gain(cg[-1], ch[-1]) + 1e-9:
            value = np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])
    return value


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree that cuts once along each of two features."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    parts = []
    for c in (cg, ch):
        low, row, col, all_ = c[1:-1, 1:-1], c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        parts.append((low, row - low, col - low, all_ - row - col + low))
    if not parts[0][0].size:
        return 0.0, np.zeros_like(g)
    gain = sum(_gain(a, b) for a, b in zip(*parts, strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    v = [a[i, j] / (b[i, j] + PENALTY) for a, b in zip(*parts, strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j] - _gain(cg[-1, -1], ch[-1, -1])), out


def fit(x: np.ndarray, y: np.ndarray, keep_good: float = KEEP_GOOD) -> Model:
    """Cyclic boosting of main effects, then of the strongest pairs."""
    if not len(y) or y.min() == y.max():
        return Model()
    m = Model(base=float(np.log(y.mean() / (1 - y.mean()))))
    m.edges = [_edges(c, MAIN_BINS) for c in x.T]
    m.pair_edges = [_edges(c, PAIR_BINS) for c in x.T]
    m.tables = [np.zeros(e.size + 1) for e in m.edges]
    at = [np.searchsorted(e, c, side="right") for e, c in zip(m.edges, x.T, strict=True)]
    f = np.full(len(y), m.base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, t in enumerate(m.tables):
            g, h = slope()
            step = RATE * _tree(np.bincount(at[k], g, t.size), np.bincount(at[k], h, t.size))
            t += step
            f += step[at[k]]
    cell = [np.searchsorted(e, c, side="right") for e, c in zip(m.pair_edges, x.T, strict=True)]
    dims = [e.size + 1 for e in m.pair_edges]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(cell[a] * dims[b] + cell[b], v, dims[a] * dims[b]).reshape(dims[a], dims[b])

    g, h = slope()
    found = sorted(((-_quadrants(grid(a, b, g), grid(a, b, h))[0], a, b) for a in range(len(dims)) for b in range(a)))
    for _, a, b in found[:PAIRS]:
        m.pairs[a, b] = np.zeros((dims[a], dims[b]))
    for _ in range(PAIR_ROUNDS):
        for (a, b), t in m.pairs.items():
            g, h = slope()
            step = RATE * _quadrants(grid(a, b, g), grid(a, b, h))[1]
            t += step
            f += step[cell[a], cell[b]]
    good = m.score(x)[y == 1]
    m.threshold = float(min(0.5, np.quantile(good, 1 - keep_good)))
    return m


def trained(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, keep_good: float = KEEP_GOOD) -> Model:
    """A model of labels.quality; max_labels bounds both what is broadcast and what is fitted."""
    own = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = own.count()
    if n > max_labels:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_labels / n))
    own = own.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("y"))
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(own), "id")

    def measure(batches):  # noqa: ANN001, ANN202
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(features(b.column(2))), pa.list_(pa.float64()))], names=["id", "y", "x"])

    # a row for each label, however many documents have its id
    measured = rows.select("id", "y", "text").mapInArrow(measure, "id long, y double, x array<double>")
    got = measured.groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x")).select("y", "x").toArrow()
    if not got.num_rows:
        return Model()
    x = np.array(got.column("x").combine_chunks().flatten()).reshape(got.num_rows, -1)
    y = np.array(got.column("y"))
    order = np.lexsort((*x.T, y))  # sums must not depend on the order of tasks
    return fit(x[order], y[order], keep_good)


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column of scores in [0, 1]."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(features(texts)))

    return bounded(docs).withColumn(name, score.asNondeterministic()(F.col("text").cast("string")))


def filtered(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model keeps, columns as they are."""
    (name,) = unused(docs, "score")
    cols = [f"`{c}`" for c in docs.columns]
    return scored(docs, model, name).where(F.col(name) >= model.threshold).select(*cols)
