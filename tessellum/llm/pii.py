"""Personal data: a linear-chain conditional random field over word shapes.

Tokens are runs of visible characters but brackets, quotes, commas and their like, chains
are lines.  Every token is described by
its collapsed word shape (runs of upper case, lower case and digits become one sign
each) and by small tables over lengths, digit and sign counts and end characters; the
neighbours' shapes count as well.  The field is trained by gradient ascent on a small
table of labelled texts and decoded by Viterbi in numpy, all lines of a batch at once.

Defined results: null and empty texts hold nothing; texts of any length are decoded
whole; rows that repeat a doc_id are decoded each on its own; an empty table has no
findings; other columns are not looked at, and kept by redacted().
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.llm import text as tx
from tessellum.llm.store import bounded

TAGS = ("O", "EMAIL", "IP", "CARD", "PHONE", "PHONE+", "SECRET")  # PHONE+ continues a number
SPANS = "array<struct<start:int,end:int,label:string>>"
SHAPES = 4096

_CLASS = np.zeros(256, dtype=np.uint8)  # 0: other sign
for _code, _chars in enumerate(
    (range(65, 91), range(97, 123), range(48, 58), b".", b"@", b"-", b"+", b"(", b")", b"\"'`", b"=:", b"_", b"/\\", b",;!?", b"#$%&*|~^", range(128, 256)), 1
):
    _CLASS[list(_chars)] = _code
_CLASS[list(range(128, 256))] = 2  # letters, as most are
_N = 17
_TOKEN_BYTE = tx.VISIBLE_BYTE.copy()
_TOKEN_BYTE[list(b"<>[]{}\"'`,;=|")] = False
_HEX = np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True

#: sizes of the feature tables: own shape, then small tables, then the neighbours' shapes
SIZES = (SHAPES, 17 * 8, 22 * 5, 3 * 5 * 2, _N * _N, 2 * 4 * 17, 96, 8 * 8, SHAPES, SHAPES, 96, 96)


def _runs(flag: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of runs of True within each span."""
    up = flag.copy()
    up[1:] &= ~flag[:-1]
    c = np.concatenate([[0], np.cumsum(up)])
    return c[ends] - c[starts] + (flag[starts] & ~up[starts])


def token_features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """(tokens, features) of indexes into the tables; chain: each token's line."""
    n, cls = starts.size, _CLASS[buf]
    if not n:
        return np.zeros((0, len(SIZES)), np.int32)

    def count(flag: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flag, dtype=np.int32)])
        return c[ends] - c[starts]

    size = ends - starts
    digits, dots, ats, dashes = (count(cls == k) for k in (3, 4, 5, 6))
    letters = count((cls == 1) | (cls == 2))
    hexes = count(_HEX[buf])
    plus, left, right, quotes, equals = (np.minimum(count(cls == k), 1) for k in (7, 8, 9, 10, 11))
    other = size - digits - letters
    bucket = np.minimum(np.where(size <= 8, size, 7 + np.log2(np.maximum(size, 1) / 4).astype(int) * 2), 16)
    edge = np.zeros(buf.size, dtype=bool)
    edge[starts] = True
    kept = np.empty(buf.size, dtype=bool)
    kept[0] = True
    kept[1:] = (cls[1:] != cls[:-1]) | edge[1:]
    kept &= _TOKEN_BYTE[buf]
    place = np.concatenate([[0], np.cumsum(kept)])
    shape = (tx.span_hashes(cls[kept] + np.uint8(48), place[starts], place[ends]) % np.uint64(SHAPES)).astype(np.int32)
    signs = ((((plus * 2 + left) * 2 + right) * 3 + np.minimum(dashes, 2)) * 2 + quotes) * 2 + equals
    letter_runs = np.minimum(_runs((cls == 1) | (cls == 2), starts, ends), 7)
    digit_runs = np.minimum(_runs(cls == 3, starts, ends), 7)

    def beside(x: np.ndarray, step: int, none: int) -> np.ndarray:
        out = np.full(n, none, dtype=np.int32)
        if n > 1:
            a, b = (slice(1, None), slice(None, -1)) if step < 0 else (slice(None, -1), slice(1, None))
            out[a] = np.where(chain[1:] == chain[:-1], x[b], none)
        return out

    return np.column_stack([
        shape,
        bucket * 8 + (digits > 0) * 4 + (letters > 0) * 2 + (other > 0),
        np.minimum(digits, 21) * 5 + np.minimum(dots, 4),
        (np.minimum(ats, 2) * 5 + np.minimum(dots, 4)) * 2 + (digits > 0),
        cls[starts] * np.int32(_N) + cls[ends - 1],
        ((hexes >= size - 2 - count(cls > 14)).astype(int) * 4 + np.minimum(digits // 4, 3)) * 17 + bucket,
        signs,
        digit_runs * 8 + letter_runs,
        beside(shape, -1, 0), beside(shape, 1, 0), beside(signs, -1, 0), beside(signs, 1, 0),
    ]).astype(np.int32)


@dataclass
class Field:
    """Weights: tables of emissions by feature, transitions, and starts of chains."""

    tables: list[np.ndarray]
    move: np.ndarray
    start: np.ndarray

    def emissions(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(TAGS)), dtype=np.float32)
        for k, t in enumerate(self.tables):
            out += t[x[:, k]]
        return out


def viterbi(emit: np.ndarray, first: np.ndarray, field: Field) -> np.ndarray:
    """The best tags of all chains; first: each chain's first token (chains + 1 values)."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    head, size = first[:-1][order], size[order]
    tags = np.zeros(len(emit), dtype=np.int8)
    live = int((size > 0).sum())
    if not live:
        return tags
    head, size = head[:live], size[:live]
    back = np.zeros(emit.shape, dtype=np.int8)
    score = field.start + emit[head]
    final = np.empty((live, emit.shape[1]), dtype=np.float32)
    for t in range(1, int(size[0])):
        m = int(np.searchsorted(-size, -t))  # chains longer than t
        if m < len(score):
            final[m : len(score)] = score[m:]
            score = score[:m]
        best = score[:, :1] + field.move[0]
        arg = np.zeros(best.shape, dtype=np.int8)
        for k in range(1, score.shape[1]):
            way = score[:, k : k + 1] + field.move[k]
            better = way > best
            best = np.where(better, way, best)
            arg[better] = k
        back[head[:m] + t] = arg
        score = best + emit[head[:m] + t]
    final[: len(score)] = score
    now = final.argmax(axis=1).astype(np.int8)
    tags[head + size - 1] = now
    for t in range(int(size[0]) - 1, 0, -1):
        m = int(np.searchsorted(-size, -t))
        now[:m] = back[head[:m] + t, now[:m]]
        tags[head[:m] + t - 1] = now[:m]
    return tags


def _chains(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tokens (starts, ends, first token of each document) and their lines (line of each token, first token of each line)."""
    starts, ends, first = tx.spans(buf, offs, _TOKEN_BYTE)
    heads = np.unique(np.concatenate([offs, np.flatnonzero(buf == 10)]))
    chain = np.searchsorted(heads, starts, side="right")
    return starts, ends, first, chain, np.append(np.searchsorted(chain, np.unique(chain)), starts.size)


#: Signs behind which an entity begins that is written in one token with what names or holds it.
_BEFORE = {"EMAIL": b":(", "IP": b"(", "CARD": b":(", "SECRET": b":(", "PHONE": b":"}


def _inner(buf: np.ndarray, a: int, b: int, tag: str) -> int:
    """Where the entity in bytes a to b begins."""
    raw = buf[a:b].tobytes()
    cut = max(raw.rfind(bytes([c]), 0, max(0, len(raw) - 4)) for c in _BEFORE[tag]) + 1
    if tag == "PHONE" and raw[cut : cut + 1] == b"(" and b")" not in raw:
        cut += 1  # a bracket around the number, not around its area
    return a + cut


_KEEP_LEFT, _KEEP_RIGHT = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
for _t, _signs in ((_KEEP_LEFT, b"+("), (_KEEP_RIGHT, b"")):
    _t[:] = tx.WORD_BYTE
    _t[list(_signs)] = True


def decode(texts: pa.Array, field: Field) -> Iterator[tuple[int, list[tuple[int, int, str]]]]:
    """(row, spans) of each text that holds something; spans in characters."""
    for i, _, buf, offs in tx.chunks(texts, lower=False):
        starts, ends, first, chain, heads = _chains(buf, offs)
        tags = viterbi(field.emissions(token_features(buf, starts, ends, chain)), heads, field)
        hit = np.flatnonzero(tags)
        if not hit.size:
            continue
        chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        rows = np.searchsorted(first, hit, side="right") - 1
        got: dict[int, list[tuple[int, int, str]]] = {}
        before = -2
        for k, row in zip(hit.tolist(), rows.tolist(), strict=True):
            a, b = int(starts[k]), int(ends[k])
            a = _inner(buf, a, b, TAGS[tags[k]].rstrip("+"))
            while a < b and not _KEEP_LEFT[buf[a]]:
                a += 1
            while b > a and not _KEEP_RIGHT[buf[b - 1]]:
                b -= 1
            if a == b:
                continue
            tag, base = TAGS[tags[k]], int(chars[offs[row]])
            span = (int(chars[a]) - base, int(chars[b]) - base, tag.rstrip("+"))
            own = got.setdefault(row, [])
            if tag == "PHONE+" and own and before == k - 1 and own[-1][2] == "PHONE" and chain[k] == chain[k - 1]:
                own[-1] = (own[-1][0], span[1], "PHONE")
            else:
                own.append(span)
            before = k
        for row, own in got.items():
            yield i + row, own


def labelled_rows(n: int = 3000, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """A small table of invented sentences with their personal data marked.

    The forms are those in common use (RFC 5322 addresses, dotted quads, 13 to 19 digits of a card,
    national and E.164 numbers, random keys of several alphabets), each drawn evenly.
    """
    r = random.Random(seed)
    parts = "an er on the re st ou ti en ha ing le de la que ment ach ung lich os ci ta ra mi éa ü ñ or at es nd".split()

    def word() -> str:
        w = "".join(r.choice(parts) for _ in range(r.randint(1, 4)))
        return w.capitalize() if r.random() < 0.1 else w.upper() if r.random() < 0.04 else w

    def code(k: int, chars: str) -> str:
        return "".join(r.choice(chars) for _ in range(k))

    def digits(k: int) -> str:
        return code(k, "0123456789")

    letters = "abcdefghijklmnopqrstuvwxyz"
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", letters + digits(0) + "0123456789", letters + letters.upper() + "0123456789", letters + letters.upper() + "0123456789-_", letters.upper() + "234567"]

    def name() -> str:
        return r.choice([word().lower(), word().lower() + digits(r.randint(1, 4)), code(1, letters)])

    def entity() -> tuple[str, str]:
        k = r.randrange(5)
        if k == 0:
            user = r.choice("._+-").join(name() for _ in range(r.choice([1, 1, 2, 2, 3])))
            if r.random() < 0.2:
                user += r.choice("._") + digits(r.randint(1, 4))
            host = ".".join(name() for _ in range(r.choice([1, 1, 2, 3])))
            return f"{user}@{host}.{r.choice(['com', 'org', 'net', 'edu', 'de', 'fr', 'es', 'io', 'co.uk', 'info', 'test'])}", "EMAIL"
        if k == 1:
            ip = ".".join(str(r.randint(0, 255)) for _ in range(4))
            return ip + r.choice(["", "", "", "", f":{r.randint(1, 65535)}", f"/{r.randint(8, 32)}"]), "IP"
        if k == 2:
            d = digits(r.choice([13, 14, 15, 16, 16, 16, 19]))
            return r.choice([d, d, "-".join(d[i : i + 4] for i in range(0, len(d), 4))]), "CARD"
        if k == 3:
            land, area, number = str(r.randint(1, 99)), digits(r.choice([2, 3, 3, 4])), [digits(3), digits(4)]
            gap = r.choice("- .")
            return r.choice([
                f"+{land} ({area}) {'-'.join(number)}", f"({area}) {gap.join(number)}", f"({area}) {'-'.join(number)}", gap.join([area, *number]), f"+{land} {area} {' '.join(number)}", f"+{land} ({area}) {gap.join(number)}",
                f"+{land}{area}{''.join(number)}", f"+{land}{gap}{area}{gap}{gap.join(number)}", f"0{area} {digits(r.randint(5, 8))}",
            ]), "PHONE"
        body = code(r.randint(20, 64), r.choice(alphabets))
        while not any(c.isdigit() for c in body):
            body = code(len(body), alphabets[3])
        return r.choice(["", "", "", code(2, letters) + "-", code(3, letters) + "_", code(4, letters.upper())]) + body + code(1, letters), "SECRET"

    def plain() -> str:
        return r.choice([
            digits(r.randint(1, 9)), digits(4), f"{r.randint(0, 20)}.{r.randint(0, 9)}", f"{r.randint(0, 20)}.{r.randint(0, 9)}.", f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}",
            f"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1990, 2030)}",
            f"{r.randint(0, 23)}:{digits(2)}", f"{r.randint(0, 23)}:{digits(2)}:{digits(2)}", f"${digits(2)}.{digits(2)}", f"${r.randint(1, 99)},{digits(3)}", f"{digits(2)}%", f"#{digits(2)}", f"{word()}-{word()}", f'"{word()}"', f"({word()})", f"({r.randint(1, 999)})",
            f"{word()}{digits(1)}", f"@{word()}", f"{word()}:", code(1, "=+|-&*/#~"), code(3, "=+|-&*/#~$%"), f"{word()}=", "3.", f"{digits(2)}-{digits(2)}", f"{digits(3)}-{digits(3)}", f"https://{word().lower()}.com/{word().lower()}", f"{word().lower()}.com",
            word() * r.randint(3, 9), f"{word()}_{word()}", f"{word().lower()}.{word().lower()}()", f"/{word()}/{word()}.{word().lower()[:3]}", f"{word().upper()}-{digits(4)}", f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(1)}.{digits(3)}.{digits(3)}", f"{word()}'{word()}",
        ])

    around = [("", "")] * 8 + [('"', '"'), ("'", "'"), ("<", ">"), ("(", ")"), ("[", "]"), ("`", "`")]
    rows = []
    for _ in range(n):
        ends = r.choice([[""]] * 6 + [[code(3, "#$%&*~|^")] * 2, ["!!"], [",", ".", ";", ""], ["", "", ")", "?"]])
        text, spans = "", []
        for _ in range(r.randint(3, 22)):
            p = r.random()
            if p < 0.09:
                e, label = entity()
                if label == "SECRET" and r.random() < 0.7:
                    text += r.choice([word(), word().upper() + "_" + word().upper(), word().lower() + "_" + word().lower()]) + r.choice([" = ", "=", ": ", ":", " := ", " "])
                before, behind = r.choice(around)
                text += before
                spans.append((len(text), len(text) + len(e), label))
                text += e + behind
            else:
                text += plain() if p < 0.24 else word() + r.choice(["", "", "", "", ",", "."])
            text += r.choice(ends) + " "
        rows.append((text.rstrip(), spans))
    return rows


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_rows(), f"text string, spans {SPANS}")


def _gold(text: str, spans: Iterable, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    tags = np.zeros(starts.size, dtype=np.int64)
    for a, b, label in spans:
        inside = np.flatnonzero((chars[starts] < b) & (chars[ends] > a))
        tags[inside] = TAGS.index(label)
        if label == "PHONE":
            tags[inside[1:]] = TAGS.index("PHONE+")
    return tags


def train(rows: Iterable[tuple[str, Iterable]], epochs: int = 12, batch: int = 64, rate: float = 0.25, decay: float = 1e-4, seed: int = 3) -> Field:
    """Maximum likelihood by Adagrad over padded batches; forward and backward in log space."""
    k, rng, data = len(TAGS), np.random.default_rng(seed), []
    for text, spans in rows:
        raw = pa.array([(text or "").replace("\n", " ")])
        for _, _, buf, offs in tx.chunks(raw, lower=False):
            starts, ends, _, chain, _ = _chains(buf, offs)
            if starts.size:
                data.append((token_features(buf, starts, ends, chain), _gold(text, spans or (), buf, starts, ends)))
    field = Field([np.zeros((s, k)) for s in SIZES], np.zeros((k, k)), np.zeros(k))
    params = [*field.tables, field.move, field.start]
    memory = [np.full(p.shape, 1e-6) for p in params]
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), batch):
            part = [data[i] for i in order[at : at + batch]]
            n, length = len(part), max(len(y) for _, y in part)
            x, y, on = np.zeros((n, length, len(SIZES)), np.int64), np.zeros((n, length), np.int64), np.zeros((n, length), bool)
            for i, (a, b) in enumerate(part):
                x[i, : len(b)], y[i, : len(b)], on[i, : len(b)] = a, b, True
            emit = sum(t[x[:, :, f]] for f, t in enumerate(field.tables))
            alpha, beta = np.zeros((n, length, k)), np.zeros((n, length, k))
            alpha[:, 0] = field.start + emit[:, 0]
            for t in range(1, length):
                new = np.logaddexp.reduce(alpha[:, t - 1, :, None] + field.move, axis=1) + emit[:, t]
                alpha[:, t] = np.where(on[:, t, None], new, alpha[:, t - 1])
            z = np.logaddexp.reduce(alpha[:, -1], axis=1)
            pair = np.zeros((k, k))
            for t in range(length - 1, 0, -1):
                way = field.move + (emit[:, t] + beta[:, t])[:, None, :]
                pair += np.where(on[:, t, None, None], np.exp(alpha[:, t - 1, :, None] + way - z[:, None, None]), 0).sum(axis=0)
                beta[:, t - 1] = np.where(on[:, t, None], np.logaddexp.reduce(way, axis=2), 0)
            diff = -np.where(on[:, :, None], np.exp(alpha + beta - z[:, None, None]), 0)
            diff[np.arange(n)[:, None], np.arange(length)[None], y] += on
            flat, keep = diff.reshape(-1, k), on.ravel()
            grads = []
            for f, s in enumerate(SIZES):
                g = np.zeros((s, k))
                np.add.at(g, x[:, :, f].ravel()[keep], flat[keep])
                grads.append(g)
            gold = np.zeros((k, k))
            both = on[:, 1:]
            np.add.at(gold, (y[:, :-1][both], y[:, 1:][both]), 1)
            grads += [gold - pair, diff[:, 0].sum(axis=0)]
            for p, m, g in zip(params, memory, grads, strict=True):
                g = g / n - decay * p
                m += g * g
                p += rate * g / np.sqrt(m)
    return Field([t.astype(np.float32) for t in field.tables], field.move.astype(np.float32), field.start.astype(np.float32))


def trained(labelled: DataFrame) -> Field:
    """A field from a table (text, spans), which has to be small: it is trained on the driver."""
    rows = [(r["text"], [tuple(s) for s in r["spans"] or ()]) for r in labelled.collect()]
    return train(rows)


def _censor(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, label in spans:
        out += [text[at:a], f"[{label}]"]
        at = b
    return "".join([*out, text[at:]])


def found(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, n_spans, spans, redacted) of each document in which something is found."""
    held = docs.sparkSession.sparkContext.broadcast(field)  # a fixed size, whatever the corpus

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            hits = sorted(decode(texts, held.value))
            rows, spans = [h[0] for h in hits], [h[1] for h in hits]
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(rows, pa.int64())),
                pa.array([len(s) for s in spans], pa.int32()),
                pa.array([[{"start": a, "end": e, "label": x} for a, e, x in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))),
                pa.array([_censor(texts[r].as_py(), s) for r, s in zip(rows, spans, strict=True)], pa.string()),
            ], names=["doc_id", "n_spans", "spans", "redacted"])

    narrow = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(work, f"doc_id long, n_spans int, spans {SPANS}, redacted string")


def redacted(docs: DataFrame, field: Field) -> DataFrame:
    """docs with what is found in text replaced by its label; all columns and rows kept."""
    held = docs.sparkSession.sparkContext.broadcast(field)

    @F.arrow_udf("string")
    def censor(texts: pa.Array) -> pa.Array:
        out = texts.to_pylist()
        for row, spans in decode(texts, held.value):
            out[row] = _censor(out[row], spans)
        return pa.array(out, pa.string())

    return bounded(docs).withColumn("text", censor(F.col("text").cast("string")))
