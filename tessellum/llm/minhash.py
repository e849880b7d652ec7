"""Near duplicates of documents: MinHash bands verified with odd sketches.

Every document becomes the set of its normalised word pairs (lower case, punctuation
ignored; the single word where there is but one).  One-permutation hashing with
optimal densification gives K MinHash samples.  Documents with the same samples are one
class.  Bands of the samples propose candidates among classes; each sample also flips one bit
of an n-bit parity map (an odd sketch, Mitzenmacher, Pagh and Pham 2014), and the
population count of two maps' XOR estimates the Jaccard similarity, which must reach the
threshold.  Candidates are compared bucket by bucket, see buckets: first with a lead,
then, where a bucket is not one group, with all others, so that no link between different texts is lost.

Defined results: null and empty texts are copies of one another; texts of any length
count whole; rows that repeat a doc_id with the same text are one document and stay or
go together, with different texts they are documents of their own; rows without doc_id
belong to no group; a group is represented by its least doc_id; an empty table has no
groups.  Other columns are not looked at, and kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.llm import buckets
from tessellum.llm import text as tx
from tessellum.llm.store import bounded, passing, unused, written

SAMPLES, BANDS, SKETCH_BITS, THRESHOLD = 256, 32, 1024, 0.55
ROWS = 4  # samples to a band: a pair at 0.6 shares a band in 99 of 100 cases
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_picks: dict[int, np.ndarray] = {}


def shingles(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word pairs of each document, and the document of each."""
    starts, ends, first = tx.spans(buf, offs)
    h = tx.span_hashes(buf, starts, ends)
    doc = np.repeat(np.arange(offs.size - 1), np.diff(first))
    if h.size > 1:
        same = doc[1:] == doc[:-1]
        pair = tx.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[same]
        pair_doc = doc[:-1][same]
    else:
        pair, pair_doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lone = np.flatnonzero(np.diff(first) == 1)
    return np.concatenate([pair, h[first[lone]]]), np.concatenate([pair_doc, lone])


def signatures(h: np.ndarray, doc: np.ndarray, n: int, samples: int = SAMPLES) -> np.ndarray:
    """(n, samples) MinHash samples; a document without words has the same value everywhere."""
    bits = np.uint64(64 - int(samples).bit_length() + 1)
    sig = np.full(n * samples, _NONE, dtype=np.uint64)
    np.minimum.at(sig, doc * samples + (h >> bits).astype(np.int64), h)
    sig = sig.reshape(n, samples)
    base = sig.copy()
    d, b = np.nonzero(base == _NONE)
    some = (base != _NONE).any(axis=1)
    d, b = d[some[d]], b[some[d]]
    if samples not in _picks:
        t, i = np.arange(1, 16 * samples + 1, dtype=np.uint64)[:, None], np.arange(samples, dtype=np.uint64)[None]
        _picks[samples] = (tx.mix(t * np.uint64(1_000_003) + i) % np.uint64(samples)).astype(np.int64)
    for pick in _picks[samples]:
        if not d.size:
            break
        v = base[d, pick[b]]
        ok = v != _NONE
        sig[d[ok], b[ok]] = v[ok]
        d, b = d[~ok], b[~ok]
    while d.size:  # the rest take the next filled sample
        b_next = b
        while True:
            b_next = (b_next + 1) % samples
            v = base[d, b_next]
            ok = v != _NONE
            sig[d[ok], b[ok]] = v[ok]
            d, b, b_next = d[~ok], b[~ok], b_next[~ok]
            if not d.size:
                break
    return sig


def odd_sketches(sig: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """(n, bits / 64) words: the parity of the samples hashed to each bit."""
    n, k = sig.shape
    at = tx.mix(sig + np.arange(k, dtype=np.uint64)[None] * np.uint64(0xD1B54A32D192ED03)) % np.uint64(bits)
    flips = np.bincount((np.arange(n)[:, None] * bits + at.astype(np.int64)).ravel(), minlength=n * bits)
    return np.packbits((flips & 1).astype(np.uint8).reshape(n, bits), axis=1, bitorder="little").view(np.uint64)


def estimate(a: np.ndarray, b: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """Jaccard similarity from the XOR population count of odd sketches."""
    n = a.shape[-1] * 64
    odd = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    share = np.minimum(2 * odd / n, 1 - 1e-9)
    return 1 + n / (4 * samples) * np.log1p(-share)


def _sketch(batches: Iterator[pa.RecordBatch], samples: int, bands: int, bits: int) -> Iterator[pa.RecordBatch]:
    rows = min(ROWS, samples // bands)
    for batch in batches:
        ids, hashes = batch.column(0), batch.column(2)
        for i, j, buf, offs in tx.chunks(batch.column(1)):
            n = j - i
            h, doc = shingles(buf, offs)
            sig = signatures(h, doc, n, samples)
            odd = odd_sketches(sig, bits)
            coef = tx.mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
            key = (sig[:, : bands * rows].reshape(n, bands, rows) * coef).sum(axis=2, dtype=np.uint64)
            key = tx.mix(key + np.arange(bands, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            # two hashes of the samples, which together stand for them
            whole = [tx.mix((sig * (tx.mix(np.arange(k, k + samples, dtype=np.uint64)) | np.uint64(1))).sum(axis=1, dtype=np.uint64)).view(np.int64) for k in (7, 77_777)]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(i, n),
                    hashes.slice(i, n),
                    *map(pa.array, whole),
                    pa.ListArray.from_arrays(np.arange(0, n * bands + 1, bands, dtype=np.int32), pa.array(key.ravel())),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(bits // 8), n, [None, pa.py_buffer(odd.tobytes())]).cast(pa.binary()),
                ],
                names=["id", "text_hash", "h1", "h2", "keys", "odd"],
            )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), -1)


def _test(threshold: float, samples: int) -> buckets.Compare:
    def of(sketches: pa.Array):  # noqa: ANN202
        odd = _matrix(sketches)
        return lambda i, j: estimate(odd[i], odd[j], samples) >= threshold

    return of


def grouped(
    docs: DataFrame,
    samples: int = SAMPLES,
    bands: int = BANDS,
    bits: int = SKETCH_BITS,
    threshold: float = THRESHOLD,
    block: int = buckets.BLOCK,
    span: int = buckets.SPAN,
    few: int = buckets.FEW,
) -> DataFrame:
    """(doc_id, text_hash, node, first, n_links) of every row that is in a group of two documents or more.

    node: the class of its text; first: the least (doc_id, node) of the group; n_links: as in duplicates().
    """
    narrow = bounded(docs).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    narrow = narrow.where("id is not null").withColumn("text_hash", F.xxhash64("text"))
    sketched = narrow.mapInArrow(lambda it: _sketch(it, samples, bands, bits), "id long, text_hash long, h1 long, h2 long, keys array<long>, odd binary")
    sketched = written(sketched, "sketches")
    with passing() as keep:
        # documents with one signature collapse before the bands: thousands of copies cost one row each
        classes = sketched.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.count("*").alias("n"), F.first("keys").alias("keys"), F.first("odd").alias("odd"))
        classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
        nodes = classes.select("node", F.lit(0).cast("long").alias("mark"), "keys")
        sketches = classes.select("node", F.col("odd").alias("value"))
        links, groups = buckets.grouped(nodes, 0, lambda wanted: written(sketches.join(wanted, "node", "left_semi"), "odd"), _test(threshold, samples), block, span, few)
        degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
        of_class = classes.select("h1", "h2", "node", "rep", "last", "n").join(groups, "node", "left").join(degree, "node", "left")
        # classes without a link and of one document are no groups
        of_class = of_class.where("rep < last or n_links is not null").select(
            "h1", "h2", "node", "rep", F.coalesce("root", "node").alias("root"), (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links")
        )
        first = of_class.groupBy("root").agg(F.min(F.struct(F.col("rep").alias("doc_id"), "node")).alias("first"))
        of_class = keep(of_class.join(first, "root").select("h1", "h2", "node", "first", "n_links"), "members")
    return sketched.select("h1", "h2", F.col("id").alias("doc_id"), "text_hash").join(of_class, ["h1", "h2"]).drop("h1", "h2")


def duplicates(docs: DataFrame, **params: float) -> DataFrame:
    """(doc_id, class_doc_id, n_links), a row for each document that has a duplicate.

    class_doc_id is the group's least doc_id; n_links counts the other rows with the same
    samples, and the links to other texts that hold the text in its group.  No two
    texts whose sketches agree and which share a band are in different groups.
    """
    found = grouped(docs, **params)
    return found.groupBy("doc_id", "node").agg(F.first("first.doc_id").alias("class_doc_id"), F.first("n_links").alias("n_links")).drop("node")


def deduplicated(docs: DataFrame, **params: float) -> DataFrame:
    """docs without the members of a group but its first; all columns as they are.

    Rows without doc_id stay.
    """
    doc, text = unused(docs, "gone", "gone_text")
    gone = grouped(docs, **params).where("doc_id <> first.doc_id or node <> first.node").select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)).distinct()
    return docs.join(gone, (docs["doc_id"].cast("long") == F.col(doc)) & (F.xxhash64(docs["text"].cast("string")) == F.col(text)), "left_anti")
