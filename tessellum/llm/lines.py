"""Fuzzy line deduplication over a whole corpus.

A line is normalised to its lower-case words (ASCII punctuation and spacing ignored).
Equal normalised lines are one; the distinct ones get minima of ROWS x BANDS hashes of
their GRAM-byte pieces.  Two lines are candidates if the minima of a band agree, all
ROWS of them, and if one bit of each minimum, BITS in all, differs in at most
`distance` places.  A candidate whose normalised texts have an edit similarity of at
least `similarity` is linked, and of each connected group only the first occurrence, by
(doc_id, line), stays.  Candidates are compared bucket by bucket, see buckets: first
with a lead, then, where a bucket is not one group, with all others.

Candidates are found by chance: where pieces have a Jaccard similarity of j, a band
agrees with probability j**ROWS.  More rows make fewer chance partners in a larger
corpus, more bands find more, at the price of keys.  README has the recall measured.

Defined results: lines without a word (blank, rules) always stay; a null text stays
null, an empty one empty; lines and texts of any length are compared whole; a document
that loses every line has an empty text; null doc_ids sort first; rows alike in doc_id
and text are one document and get one text; an empty table gives an empty one; other
columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.llm import buckets
from tessellum.llm import text as tx
from tessellum.llm.store import bounded, passing, unused, written

GRAM, ROWS, BANDS, SIMILARITY = 5, 5, 12, 0.85
BITS, DISTANCE = ROWS * BANDS, 17
APART = 2  # steps of the length, of which four bits hold 16
HELD_BYTES, STEP = 16 << 20, 1 << 17  # bytes of lines that are packed, and of lines that are sketched at a time
LOOK = 64  # steps after which pairs that are beyond their bounds are left out
_ODD = (tx.mix(np.arange(1, BITS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _within(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places are in one of the spans, which lie in order."""
    change = np.zeros(n + 1, dtype=np.int8)
    change[starts] = 1
    change[ends] -= 1
    return np.cumsum(change[:-1], dtype=np.int8).view(bool)


def _normalised(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines, given by their words, with a blank between words: bytes side by side, and where each begins (n + 1 values); at: each line's first word, none without words."""
    size = ends - starts
    gap = np.ones(size.size, dtype=np.int64)
    gap[at[1:] - 1] = 0
    between = ends[gap > 0]  # a word that another one of its line follows has no word byte behind it
    keep = _within(starts, ends, buf.size)
    keep[between] = True
    buf = buf.copy()
    buf[between] = 32
    return buf[keep], np.append(0, np.cumsum(size + gap)[at[1:] - 1])


def _sketches(data: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits of the minima, and (lines, BANDS) of band keys of 64 bits, of normalised lines that lie side by side."""
    n = cut.size - 1
    least = np.empty((BITS, n), dtype=np.uint32)
    i = 0
    while i < n:  # so many at a time as the cache holds
        j = max(i + 1, int(np.searchsorted(cut, cut[i] + STEP, side="right")) - 1)
        part, heads = _pieces(data[cut[i] : cut[j]], cut[i : j + 1] - cut[i]), cut[i:j] - cut[i]
        held = np.empty_like(part)
        for k, odd in enumerate(_ODD):
            least[k, i:j] = np.minimum.reduceat(np.multiply(part, odd, out=held), heads)
        i = j
    bits, bands = np.zeros(n, np.uint64), np.zeros((n, BANDS), np.uint64)
    for k in range(BITS):
        h = tx.mix(least[k] + (np.uint64(k) << np.uint64(32)))
        bits |= (h >> np.uint64(63)) << np.uint64(k)
        bands[:, k // ROWS] += h  # k is in h: no other band has the same key but by chance
    return bits, bands


def _pieces(data: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes from each byte on; behind each line are blanks."""
    n = data.size
    plain = np.full(n + GRAM - 1, 32, dtype=np.uint8)
    plain[:n] = data
    gram = plain[:n].astype(np.uint64)
    for k in range(1, GRAM):
        gram <<= np.uint64(8)
        gram |= plain[k : k + n].astype(np.uint64)
    blanks = np.uint64(0)
    for k in range(GRAM - 1, 0, -1):  # pieces of k bytes of a line
        blanks = blanks << np.uint64(8) | np.uint64(32)
        shift = np.uint64(8 * (GRAM - k))
        some = cut[1:][np.diff(cut) >= k] - k
        gram[some] = gram[some] >> shift << shift | blanks
    gram *= np.uint64(0x9E3779B97F4A7C15)
    gram ^= gram >> np.uint64(29)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    return (gram >> np.uint64(32)).astype(np.uint32)


def _split(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document and number of each line, the words (starts, ends), and each line's first word (n + 1 values)."""
    breaks = np.flatnonzero(buf == 10) + 1
    first = np.concatenate([offs[:-1], breaks])
    doc = np.concatenate([np.arange(offs.size - 1), np.searchsorted(offs, breaks - 1, side="right") - 1])
    order = np.lexsort((first, doc))  # an empty document's line starts where the next one's does
    first, doc = first[order], doc[order]
    number = np.arange(doc.size) - np.searchsorted(doc, doc)
    return doc, number, *tx.spans(buf, np.append(first, buf.size))


def _hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the words of each line."""
    h = tx.span_hashes(buf, starts, ends)
    place = np.arange(h.size) - np.repeat(at[:-1], np.diff(at))
    h += place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole, other = tx.segment_sums(tx.mix(h), at), tx.segment_sums(tx.mix(h ^ np.uint64(0xA0761D6478BD642F)), at)
    return tx.mix(whole), other


def line_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, line number, hash, second hash) of each line that has a word."""
    doc, number, starts, ends, at = _split(buf, offs)
    whole, other = _hashes(buf, starts, ends, at)
    some = np.diff(at) > 0
    return doc[some], number[some], whole[some].view(np.int64), other[some].view(np.int64)


def line_sketches(buf: np.ndarray, offs: np.ndarray, doc: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Sketch, band keys and normalised text of some lines, in order of document and number, all of which have words."""
    of, _, starts, ends, at = _split(buf, offs)
    line = np.searchsorted(of, doc) + number
    size = at[line + 1] - at[line]
    head = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(at[line] - head[:-1], size) + np.arange(head[-1])
    data, cut = _normalised(buf, starts[word], ends[word], head)
    bits, bands = _sketches(data, cut)
    return bits.view(np.int64), bands.view(np.int64), _taken(data, cut, np.arange(line.size)).cast(pa.string())


def _taken(data: np.ndarray, cut: np.ndarray, which: np.ndarray) -> pa.Array:
    """Some of the texts that lie side by side in data."""
    return pa.LargeStringArray.from_buffers(cut.size - 1, pa.py_buffer(cut), pa.py_buffer(data)).take(pa.array(which))


def _firsts(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, th: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first occurrence of each line, in order of h1, and those that are others; several of a row that is repeated are one."""
    order = np.lexsort((line, th, doc, h2, h1))
    head = np.ones(order.size, dtype=bool)
    head[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
    first = order[head]
    to = first[np.cumsum(head) - 1]
    other = (doc[order] != doc[to]) | (th[order] != th[to]) | (line[order] != line[to])
    return first, order[other]


LINES = {"h1": np.uint64, "h2": np.uint64, "doc": np.int64, "th": np.int64, "line": np.int32, "size": np.int64, "value": np.uint8, "gone_doc": np.int64, "gone_th": np.int64, "gone_line": np.int32}


def _lines(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Packed rows of the lines that have words: first occurrences within some documents, with their texts, and the places of others, which are surplus."""

    def flush() -> pa.RecordBatch:
        h1, h2, doc, th, line, size, data = (np.concatenate(x) for x in zip(*held, strict=True))
        first, gone = _firsts(h1, h2, doc, th, line)
        values = _taken(data, np.append(0, np.cumsum(size)), first)
        cut = np.frombuffer(values.buffers()[1], dtype=np.int64)[: len(values) + 1]
        text = np.frombuffer(values.buffers()[2], dtype=np.uint8)
        # the places of a frequent line are many: they go anywhere
        to = buckets.part_of(tx.mix((doc[gone] ^ th[gone]).view(np.uint64)), parts)
        gone, to = gone[order := np.argsort(to, kind="stable")], to[order]
        own = {"h1": h1[first], "h2": h2[first], "doc": doc[first], "th": th[first], "line": line[first], "size": size[first], "value": (text, cut)}
        return buckets.packed(parts, [(buckets.part_of(h1[first], parts), own), (to, {"gone_doc": doc[gone], "gone_th": th[gone], "gone_line": line[gone]})])

    held, n = [], 0
    for batch in batches:
        ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for i, j, buf, offs in tx.chunks(batch.column(2)):
            doc, number, starts, ends, at = _split(buf, offs)
            if not starts.size:
                continue
            whole, other = _hashes(buf, starts, ends, at)
            some = np.diff(at) > 0
            plain, cut = _normalised(buf, starts, ends, np.append(at[:-1][some], at[-1]))
            held.append((whole[some], other[some], ids[i:j][doc[some]], hashes[i:j][doc[some]], number[some].astype(np.int32), np.diff(cut), plain))
            n += plain.size
            if n >= HELD_BYTES:
                yield flush()
                held, n = [], 0
    if held:
        yield flush()


def _lengths(values: pa.Array, similarity: float) -> np.ndarray:
    """The bits of a mark that sketches leave free: the length in steps of which lines that are similar are APART apart at most, in a round."""
    step = 1e-9 - (1 + 1e-6) / APART * np.log(min(1.0, max(similarity, 1e-9)))
    return np.floor(np.log(np.array(pc.utf8_length(values), dtype=np.float64)) / step).astype(np.int64).view(np.uint64) << np.uint64(BITS)


NODE = "node long, doc long, th long, line int, mark long, keys binary, value string"


def _nodes(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Distinct lines, numbered, with the places where they occur first, and without a number the places of others."""
    schema = pa.schema([("node", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("line", pa.int32()), ("mark", pa.int64()), ("keys", pa.binary()), ("value", pa.string())])
    node = TaskContext.get().partitionId() << 33
    for h1, h2, doc, th, line, size, data, *gone in buckets.unpacked(batches, list(LINES.values())):
        first, other = _firsts(h1, h2, doc, th, line)
        values = _taken(data, np.append(0, np.cumsum(size)), first)
        for i, j, buf, offs in tx.chunks(values, lower=False):
            bits, bands = _sketches(buf, offs)
            bits |= _lengths(values.slice(i, j - i), similarity)
            keys = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(np.arange(0, bands.nbytes + 1, 8 * BANDS, dtype=np.int32)), pa.py_buffer(bands)])
            places = (pa.array(x[first[i:j]]) for x in (doc, th, line))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(node, node + j - i)), *places, pa.array(bits.view(np.int64)), keys, values.slice(i, j - i).cast(pa.string())], schema=schema)
            node += j - i
        places = [pa.array(np.append(x[other], y)) for x, y in zip((doc, th, line), gone, strict=True)]
        if n := len(places[0]):
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), *places, *(pa.nulls(n, t) for t in schema.types[4:])], schema=schema)


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """Both without what they begin and end with alike, which has no part in the distance."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        k = (low + high + 1) // 2
        if a[low:k] == b[low:k]:
            low = k
        else:
            high = k - 1
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        k = (low + high + 1) // 2
        if a[len(a) - k : len(a) - low] == b[len(b) - k : len(b) - low]:
            low = k
        else:
            high = k - 1
    return a[: len(a) - low], b[: len(b) - low]


def edits(pairs: list[tuple[str, str]], most: np.ndarray | None = None) -> np.ndarray:
    """Edit distances in characters, by bit vectors (Myers 1999, in blocks after Hyyroe 2003).

    Those beyond most, where it is given, are just some number beyond it: then only a
    band around the diagonal is looked at (Ukkonen 1985).  Pairs of like length go through the blocks side by
    side in numpy; where there are too few of them, or they are long, each pair is one
    integer of as many bits as characters.
    """
    pairs = [_trimmed(*x) for x in pairs]
    size = np.array([max(map(len, x)) for x in pairs], dtype=np.int64)
    bound = size if most is None else np.minimum(most, size)
    order = np.lexsort((-bound, -size)).tolist()
    out, at = np.zeros(len(pairs), dtype=np.int64), 0
    while at < len(order):
        longest = int(size[order[at]])
        end = at + 1
        while end < len(order) and end - at < 4096 and 4 * size[order[end]] >= (3 if end - at >= 64 else 2) * longest:
            end += 1
        n, words = end - at, -(-longest // 64)
        own = order[at:end]
        band = min(words, int(bound[own].max()) // 32 + 2)
        if 20e-6 + n * band * 50e-9 < n * (1e-6 + band * 20e-9):  # seconds a character, as measured
            out[own] = _edits_by_blocks([pairs[i] for i in own], bound[own])
        else:
            for i in own:
                out[i] = _edits_by_integers(*pairs[i], None if most is None else int(most[i]))
        at = end
    return out


def _edits_by_integers(a: str, b: str, most: int | None = None) -> int:
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if not a:
        return n
    far = n if most is None else min(most, n)
    if n - m > far:
        return far + 1
    equal: dict[str, int] = {}
    for i, c in enumerate(a):
        equal[c] = equal.get(c, 0) | 1 << i
    # columns in steps, each over the rows low to high, which hold the band; base is the value at row low
    step = n if far >= m else max(96, far // 2)
    low = high = base = up = down = 0
    for at in range(0, n, step):
        part = b[at : at + step]
        new_low, new_high = min(max(0, at - far), high), min(m, at + step + far)
        out = (1 << new_low - low) - 1
        base += (up & out).bit_count() - (down & out).bit_count()
        up >>= new_low - low
        down >>= new_low - low
        # rows enter with the greatest value that they can have
        up |= (1 << new_high - new_low) - (1 << high - new_low)
        low, high = new_low, new_high
        full = (1 << high - low) - 1
        here = {c: equal.get(c, 0) >> low & full for c in set(part)}
        for c in part:
            eq = here[c]
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph = (down | ~(xh | up)) << 1 | 1
            mh = (up & xh) << 1
            up = (mh | ~(xv | ph)) & full
            down = ph & xv & full
        base += len(part)
        if far < m and at + step < n:  # what any path still costs
            size = high - low
            ups, downs = (np.unpackbits(np.frombuffer(x.to_bytes(size // 8 + 1, "little"), dtype=np.uint8), count=size, bitorder="little").astype(np.int64) for x in (up, down))
            value = base + np.append(0, np.cumsum(ups - downs))
            if (value + np.abs(np.arange(m - low, m - high - 1, -1) - (n - at - step))).min() > far:
                return far + 1
    return base + up.bit_count() - down.bit_count()


def _edits_by_blocks(pairs: list[tuple[str, str]], bound: np.ndarray | None = None) -> np.ndarray:
    """The pairs side by side, and the words of a pair too: each is a column behind the one above it, which hands down what it has just found."""
    short, long = zip(*((a, b) if len(a) <= len(b) else (b, a) for a, b in pairs), strict=True)
    m, n = (np.array([len(x) for x in side]) for side in (short, long))
    count, words, length = len(pairs), max(1, -(-int(m.max()) // 64)), int(n.max())
    far = max(1, length if bound is None else int(bound.max()))

    def codes(texts: tuple[str, ...]) -> np.ndarray:
        return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)

    p, t = codes(short), codes(long)
    known = np.zeros(max(p.max(initial=0), t.max(initial=0)) + 1, dtype=np.int64)
    known[p] = known[t] = 1
    known = np.cumsum(known) * known  # from 1 on; 0 is no symbol
    # equal[symbol, word, pair]: where the short text has the symbol
    equal = np.zeros((int(known.max(initial=0)) + 1, words, count), dtype=np.uint64)
    place = np.arange(p.size) - np.repeat(np.cumsum(m) - m, m)
    np.bitwise_or.at(equal, (known[p], place >> 6, np.repeat(np.arange(count), m)), np.uint64(1) << (place & 63).astype(np.uint64))
    # long texts end at the same step; before they begin nothing is handed down, which leaves all as it is
    begin = length - n
    text = np.tile(np.arange(count), (length, 1))
    place = np.arange(t.size) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
    text[place, np.repeat(np.arange(count), n)] += known[t] * (words * count)
    unlike, word = np.invert(equal, out=equal).ravel(), np.arange(words)
    row = word[:, None] * count
    up, not_down = (np.full((words, count), ~np.uint64(0)) for _ in range(2))
    not_plus, minus = (np.zeros((words + 1, count), dtype=np.uint64) for _ in range(2))
    one, top, last = np.array(1, dtype=np.uint64), np.array(63, dtype=np.uint64), int(begin.max(initial=0))
    # a word is in the band from one step to another; from there on, the word below gets the greatest value that it can have
    enters = np.maximum(0, 64 * word - far) + word
    leaves = np.minimum(length, 64 * (word + 1) + far + last) + word
    steps = np.arange(int(leaves[-1]))
    lows, highs = np.searchsorted(leaves, steps, side="right").tolist(), np.searchsorted(enters, steps, side="right").tolist()
    before, live, found = 0, np.arange(count), np.zeros(count, dtype=np.int64)
    for step, low, high in zip(steps.tolist(), lows, highs, strict=True):
        if step <= last:
            not_plus[0] = begin > step
        if low < high:
            at = text[step - high + 1 : step - low + 1][::-1] + row[low:high]
            not_eq, pv, not_mv, in_plus, in_minus = unlike.take(at), up[low:high], not_down[low:high], not_plus[low:high], minus[low:high]
            beside = not_eq & not_mv
            eq = np.invert(not_eq, out=not_eq)
            eq |= in_minus
            xh = eq & pv
            xh += pv
            xh ^= pv
            xh |= eq
            not_ph = np.bitwise_or(xh, pv, out=eq)
            not_ph &= not_mv
            mh = np.bitwise_and(xh, pv, out=xh)
            shifted = not_ph << one
            shifted |= in_plus
            np.right_shift(not_ph, top, out=not_plus[low + 1 : high + 1])
            np.bitwise_or(shifted, beside, out=not_mv)
            beside &= shifted
            np.left_shift(mh, one, out=shifted)
            shifted |= in_minus
            np.right_shift(mh, top, out=minus[low + 1 : high + 1])
            np.bitwise_or(shifted, beside, out=pv)
        if low > before:
            not_plus[low], minus[low], before = 0, 0, low
        if bound is not None and step % LOOK == LOOK - 1 and low < high and step < length:
            kept = _least(step, low, high, up, ~not_down, not_plus, minus, begin, n - m) <= bound[live]
            if np.count_nonzero(kept) <= 0.8 * live.size:
                found[live[~kept]] = bound[live[~kept]] + 1
                live, begin, m, n = live[kept], begin[kept], m[kept], n[kept]
                text, up, not_down, not_plus, minus = (x.compress(kept, axis=1) for x in (text, up, not_down, not_plus, minus))
                if not live.size:
                    return found
    size = np.clip(m - 64 * word[:, None], 0, 64)
    rows = np.where(size > 0, ~np.uint64(0) >> (64 - np.maximum(size, 1)).astype(np.uint64), np.uint64(0))
    found[live] = n + (np.bitwise_count(up & rows).astype(np.int64) - np.bitwise_count(~not_down & rows)).sum(axis=0)
    return found


def _least(step: int, low: int, high: int, up: np.ndarray, down: np.ndarray, not_plus: np.ndarray, minus: np.ndarray, begin: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """What the distance is at least: any path goes by the cells just found, and from there on costs what lengths differ by."""
    net = lambda a, b: np.bitwise_count(up[a:b]).astype(np.int32) - np.bitwise_count(down[a:b])
    column = np.maximum(0, step + 1 - np.arange(low, high)[:, None] - begin).astype(np.int32)
    heads = column[:1] + net(0, low).sum(axis=0, dtype=np.int32)
    behind = net(low, high - 1) - (1 - not_plus[low + 1 : high].astype(np.int32) - minus[low + 1 : high].astype(np.int32))
    heads = np.concatenate([heads, heads + np.cumsum(behind, axis=0, dtype=np.int32)])
    bits = [np.unpackbits(np.ascontiguousarray(x[low:high])[..., None].view(np.uint8), axis=-1, bitorder="little").view(np.int8) for x in (up, down)]
    value = heads[..., None] + np.cumsum(bits[0] - bits[1], axis=-1, dtype=np.int8)
    rest = (longer - column + 64 * np.arange(low, high, dtype=np.int32)[:, None]).astype(np.int32)[..., None] + np.arange(1, 65, dtype=np.int32)
    return (value + np.abs(rest)).min(axis=(0, 2)) - 2


def _at_most(a: str, b: str, most: float = float("inf")) -> int:
    """A bound of the edit distance from above: words in turn, one of either side left out where the next ones agree; beyond most, just some number beyond it."""
    x, y = a.split(" "), b.split(" ")
    i = j = cost = 0
    m, n = len(x), len(y)
    while i < m and j < n and cost <= most:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
        elif i + 1 < m and j + 1 < n and x[i + 1] == y[j + 1]:
            cost += max(len(x[i]), len(y[j]))
            i, j = i + 1, j + 1
        elif i + 1 < m and x[i + 1] == y[j]:
            cost += len(x[i]) + 1
            i += 1
        elif j + 1 < n and x[i] == y[j + 1]:
            cost += len(y[j]) + 1
            j += 1
        else:
            cost += max(len(x[i]), len(y[j]))
            i, j = i + 1, j + 1
    return cost + sum(len(w) + 1 for w in x[i:]) + sum(len(w) + 1 for w in y[j:])


def similar(pairs: list[tuple[str, str]], similarity: float) -> np.ndarray:
    """Whether the edit similarity 1 - edits / longer length reaches the bound."""
    longer = np.array([max(map(len, x)) for x in pairs], dtype=np.int64)
    most = np.floor((1 - similarity) * longer + 1e-9).astype(np.int64)
    out = np.array([abs(len(a) - len(b)) for a, b in pairs], dtype=np.int64) <= most
    some, bounds = [], most.tolist()
    for i in np.flatnonzero(out).tolist():
        a, b = _trimmed(*pairs[i])
        if max(len(a), len(b)) > bounds[i] and _at_most(*pairs[i], bounds[i]) > bounds[i]:
            some.append(i)
    some = np.array(some, dtype=np.int64)
    out[some] = edits([pairs[i] for i in some], most[some]) <= most[some]
    return out


def _test(similarity: float) -> buckets.Compare:
    def of(texts: pa.Array):  # noqa: ANN202
        lines = texts.to_pylist()
        return lambda i, j: similar([(lines[a], lines[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)], similarity)

    return of


def _doc(doc_id: Column) -> Column:
    """doc_id as a key: a null one is the least."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))


def surplus(docs: DataFrame, distance: int = DISTANCE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc, th, lines): numbers of the lines that go from each row; th is xxhash64(text), doc what _doc() makes of doc_id."""
    narrow = bounded(docs).select(_doc(F.col("doc_id")).alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))
    with passing() as keep:
        parts = buckets.n_parts(narrow)
        packed = narrow.mapInArrow(lambda it: _lines(it, parts), ", ".join(["part int", *(f"{name} binary" for name in LINES)]))
        nodes = written(packed.repartition("part").sortWithinPartitions("part").mapInArrow(lambda it: _nodes(it, similarity), NODE), "nodes")
        distinct = nodes.where("node is not null")

        def values(wanted: DataFrame) -> DataFrame:
            return written(distinct.select("node", "value").join(wanted, "node", "left_semi"), "texts")

        _, groups = buckets.grouped(distinct.select("node", "mark", "keys"), buckets.Near(distance, BITS, APART), values, _test(similarity))
        place = F.struct("doc", "th", "line")
        alike = written(distinct.select("node", place.alias("place")).join(groups, "node").select("root", "place"), "alike")
        stays = alike.groupBy("root").agg(F.min("place").alias("stay"))
        gone = alike.join(stays, "root").where("place <> stay").select("place.*")
        gone = gone.unionByName(nodes.where("node is null").select("doc", "th", "line"))
        return keep(gone.groupBy("doc", "th").agg(F.collect_set("line").alias("lines")), "gone")


def deduplicated(docs: DataFrame, counts: bool = False, **params: float) -> DataFrame:
    """docs with the surplus lines taken out of text and n_chars, if there, brought up to date.

    counts adds n_lines and n_dropped.
    """
    doc, th, gone, parts = unused(docs, "own", "own_th", "gone", "all_lines")
    away = surplus(docs, **params).select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("lines").alias(gone))
    text = docs["text"]
    joined = docs.join(away, (_doc(docs["doc_id"]) == F.col(doc)) & (F.xxhash64(text.cast("string")) == F.col(th)), "left")
    cols = [docs[f"`{c}`"] for c in docs.columns]
    split = joined.select(*cols, F.col(gone), F.split(text, "\n").alias(parts))  # once for each text, not for each line
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    new = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.col(parts)[i]), "\n"))
    out = []
    for c in docs.columns:
        own = F.col(f"`{c}`")
        if c == "text":
            own = new.alias(c)
        elif c == "n_chars":
            own = F.when(F.col(gone).isNull(), own).otherwise(F.length(new).cast(docs.schema[c].dataType)).alias(c)
        out.append(own)
    if counts:
        out += [F.size(parts).alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).alias("n_dropped")]
    return split.select(*out)
