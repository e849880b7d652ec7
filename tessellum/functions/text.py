"""Byte-exact text functions: columns where Spark has them, plain Python for the table functions.

Sizes are in bytes of UTF-8.  Lines end at a line feed, one carriage return before it goes
too, and no empty line follows the last line feed.  Blank means Unicode white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters with the Unicode property White_Space (Python's strip() would also take U+001C to U+001F).
WHITE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_BLANK = "^[" + WHITE + "]*$"
SNIPPET, EMBEDDED = 1200, 12_000


def lines(text: str) -> list[str]:
    out = text.split("\n")
    if out[-1] == "":
        out.pop()
        return [x[:-1] if x.endswith("\r") else x for x in out]
    return [x[:-1] if x.endswith("\r") else x for x in out[:-1]] + out[-1:]


def trim(text: str) -> str:
    return text.strip(WHITE)


def is_blank(text: Column) -> Column:
    return F.rlike(text, F.lit(_BLANK))


def lines_of(text: Column) -> Column:
    """The same lines as a column; null for null."""
    body = F.regexp_replace(text, "\r\n", "\n")
    parts = F.split(body, "\n", -1)
    return F.when(F.endswith(body, F.lit("\n")) | (body == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def cut_bytes(text: Column, most: int) -> Column:
    """As much of the text as fits into that many bytes, cut back to a whole character."""
    raw = F.encode(text, "UTF-8")
    head = F.substring(raw, 1, most)
    # the byte behind the cut, and the last ones before it, tell where its character begins
    following = F.substring(raw, most + 1, 1)
    inside = F.hex(following).rlike("^[89AB]")

    def back(n: int) -> Column:
        return F.substring(raw, 1, most - n)

    lead = [F.hex(F.substring(raw, most - n + 1, 1)).rlike("^[89AB]") for n in (1, 2)]
    cut = F.when(~inside, head).when(~lead[0], back(1)).when(~lead[1], back(2)).otherwise(back(3))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(cut, "UTF-8"))


def snippet(text: Column, most: int = SNIPPET) -> Column:
    """Long texts cut, with an ellipsis on a line of its own."""
    return F.when(F.octet_length(text) > most, F.concat(cut_bytes(text, most), F.lit("\n..."))).otherwise(text)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def percent(score: Column) -> Column:
    return F.format_string("%.1f%%", score * 100)


def token_estimate(n_bytes: Column) -> Column:
    return F.ceil(n_bytes / 4)


def tail_from(raw: bytes, at: int) -> bytes:
    """The bytes from the first character boundary at or behind a place."""
    at = max(0, at)
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return raw[at:]
