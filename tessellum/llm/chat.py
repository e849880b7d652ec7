"""Chat formatting by token-level assembly.

Segments are encoded each on its own with a public byte-level vocabulary, so no token
spans a border and no text can spell a reserved id; the reserved ids are spliced in
between.  A conversation becomes

    BOS (ROLE_role BODY content END)*

The loss mask marks the content and END of assistant turns.  It is the prefix sum of
+1 at the first such token and -1 behind the last.  Control strings that occur in the
content are escaped: a backslash goes into `<|`, behind the backslashes that are there
already, so unescape() restores every text.

Defined results: turns are ordered by turn, role and text, nulls first, and repeated
rows stay; each row without conv_id is a conversation of its own; a null or empty text
gives a turn without content, a text of any length is encoded whole; an unknown or null
role is written as a user's; an empty table has no conversations; other columns are not
looked at.  A conversation is one row of the result, so it has to fit into one.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.llm.store import bounded

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RESERVED = ("BOS", "BODY", "END", "system", "user", "assistant", "tool")  # ids behind the vocabulary's


@lru_cache(maxsize=2)
def _encoding(path: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def reserved(path: str) -> dict[str, int]:
    n = _encoding(path).n_vocab
    return {name: n + i for i, name in enumerate(RESERVED)}


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def assemble(first: np.ndarray, roles: Sequence[str | None], segments: Sequence[Sequence[int]], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat ids and loss masks of conversations, and each one's first token (n + 1 values).

    first: each conversation's first turn (n + 1 values); segments: the turns' encoded contents.
    """
    ids = reserved(path)
    talks, turns = np.diff(first), len(roles)
    size = np.fromiter((len(s) for s in segments), np.int64, turns)
    role = np.array([ids[r] if r in ("system", "user", "assistant", "tool") else ids["user"] for r in roles], dtype=np.int64)
    talk = np.repeat(np.arange(talks.size), talks)
    before = np.concatenate([[0], np.cumsum(size + 3)])
    at = before[:-1] + talk + 1  # where each turn begins: one BOS for each conversation so far
    start = before[first] + np.arange(first.size)
    out = np.empty(int(start[-1]), dtype=np.int32)
    out[start[:-1]] = ids["BOS"]
    out[at], out[at + 1], out[at + 2 + size] = role, ids["BODY"], ids["END"]
    flat = np.concatenate([np.asarray(s, dtype=np.int32) for s in segments]) if turns else np.zeros(0, np.int32)
    within = np.arange(flat.size) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(at + 2, size) + within] = flat
    edge = np.zeros(out.size + 1, dtype=np.int8)
    own = role == ids["assistant"]
    np.add.at(edge, at[own] + 2, 1)
    np.add.at(edge, at[own] + 3 + size[own], -1)
    return out, np.cumsum(edge[:-1], dtype=np.int8), start


def _format(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = _encoding(path)
    for batch in batches:
        turns = batch.column(1)
        values = turns.flatten()
        first = np.concatenate([[0], np.cumsum(np.array(turns.value_lengths().fill_null(0)))]).astype(np.int64)
        roles = values.field("role").to_pylist()
        texts = [escape(t or "") for t in values.field("text").to_pylist()]
        out, mask, start = assemble(first, roles, enc.encode_ordinary_batch(texts, num_threads=1), path)
        at = pa.array(start.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(start).astype(np.int32)), pa.ListArray.from_arrays(at, pa.array(out)), pa.ListArray.from_arrays(at, pa.array(mask))],
            names=["conv_id", "n_tokens", "input_ids", "loss_mask"],
        )


def formatted(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(conv_id, n_tokens, input_ids, loss_mask), a row for each conversation; the vocabulary's path is the executors'."""
    part = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = bounded(turns).select(F.col("conv_id").cast("long").alias("conv_id"), part.alias("part"))
    talks = rows.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("turns"))
    talks = talks.unionByName(rows.where("conv_id is null").select("conv_id", F.array("part").alias("turns")))
    return talks.mapInArrow(lambda it: _format(it, vocabulary), "conv_id long, n_tokens int, input_ids array<int>, loss_mask array<byte>")
