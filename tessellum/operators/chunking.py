"""Splitting sources into chunks: by lines, by Markdown headings, by declarations.

Sizes and overlaps are bytes.  Each splitter is a plain function of one text, tested on its
own; chunked() applies the one that the path's language asks for to a table, in Arrow batches.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.functions import batches, paths
from tessellum.functions import text as tx

SIZE, OVERLAP, LINE_BYTES = 1000, 100, 40


def plain(source: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Windows of whole lines that stay below size, each going back by overlap // 40 lines.

    A line of size or more is a chunk of its own.  Blank windows are left out.
    """
    rows = tx.lines(source)
    upto = list(accumulate((len(r.encode()) + 1 for r in rows), initial=0))
    back, start, out = overlap // LINE_BYTES, 0, []
    while start < len(rows):
        end = max(start + 1, bisect_left(upto, upto[start] + size + 1) - 1)
        window = "\n".join(rows[start:end])
        if tx.trim(window):
            out.append(window)
        again = end - back if end > back else end
        start = end if again <= start else again
    return out


def markdown(source: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """A heading begins a chunk; a section that reaches size is cut behind its line, keeping overlap bytes."""
    out, held = [], b""

    def give() -> None:
        if body := tx.trim(held.decode()):
            out.append(body)

    for row in tx.lines(source):
        heading = row.startswith("#")
        if heading and tx.trim(held.decode()):
            give()
            held = b""
        held += row.encode() + b"\n"
        if len(held) >= size and not heading:
            out.append(tx.trim(held.decode()))
            held = tx.tail_from(held, len(held) - overlap)
    give()
    return out


def declarations(pieces: list[tuple[bool, str]], size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Joins (is a declaration, text) in order: declarations stay whole, the rest is run together."""
    out, held = [], b""
    for whole, piece in pieces:
        raw = piece.encode()
        if not whole:
            held += raw
            continue
        if len(held) + len(raw) > size and tx.trim(held.decode()):
            out.append(tx.trim(held.decode()))
            held = tx.tail_from(held, len(held) - overlap)
        held += raw + b"\n"
        if len(held) >= size:
            out.append(tx.trim(held.decode()))
            held = tx.tail_from(held, len(held) - overlap)
    if rest := tx.trim(held.decode()):
        out.append(rest)
    return out


def code(source: str, ext: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """By the declarations of a known language; by lines where there are none, or it can't be read."""
    from tessellum.structure import boundaries

    pieces = boundaries.pieces(source, ext)
    return (declarations(pieces, size, overlap) if pieces else []) or plain(source, size, overlap)


def split(source: str, ext: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    if paths.LANGUAGES.get(ext) == "markdown":
        return markdown(source, size, overlap)
    return code(source, ext, size, overlap)


def _by_parts(f, texts: pa.Array, *more: pa.Array) -> pa.Array:  # noqa: ANN001
    """f of a few texts after the other: of a batch no more than a part are Python objects at a time."""
    cut = [pa.array(f(texts[i:j], *[m[i:j] for m in more]), pa.list_(pa.string())) for i, j in batches.parts(texts)]
    return pa.concat_arrays(cut or [pa.array([], pa.list_(pa.string()))])


def _splitter(f, size: int, overlap: int):  # noqa: ANN001, ANN202
    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return _by_parts(lambda t: [None if x is None else f(x, size, overlap) for x in t.to_pylist()], texts)

    return run


def plain_chunks(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    return _splitter(plain, size, overlap)(text)


def markdown_chunks(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    return _splitter(markdown, size, overlap)(text)


def split_chunks(text: Column, path: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """The chunks that the language of the path asks for."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array, exts: pa.Array) -> pa.Array:
        return _by_parts(lambda t, x: [None if a is None else split(a, b or "", size, overlap) for a, b in zip(t.to_pylist(), x.to_pylist(), strict=True)], texts, exts)

    return run(text, paths.extension(path))


def exploded(files: DataFrame, chunks: Column) -> DataFrame:
    """files with chunk_no and chunk, a row for each chunk, without content."""
    rest = [c for c in files.columns if c != "content"]
    return batches.bounded(files).select(*rest, F.posexplode(chunks).alias("chunk_no", "chunk"))


def chunked(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """files(file_path, content, ...): the chunks of each file; files without any have no row."""
    return exploded(files, split_chunks(F.col("content"), F.col("file_path"), size, overlap))
