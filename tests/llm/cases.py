"""Awkward documents that every operator has to stand."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta omega river stone cloud meadow winter summer silver golden copper harbor lantern pepper thunder violet window".split()


def sentence(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + str(r.randint(0, 30)) for _ in range(n))


def awkward(r: random.Random | None = None) -> list[tuple]:
    r = r or random.Random(1)
    long = "\n".join(sentence(r, 12) for _ in range(4000))
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s1", 0),
        (3, " \n\t\n ", "en", "s1", 5),
        (4, long, "en", "s1", len(long)),
        (5, long, "en", "s2", len(long)),
        (6, "one", "en", "s2", 3),
        (7, "one", "en", None, 3),
        (None, "no id at all here", "en", "s1", 17),
        (8, "Größe über alles, naïve façade — ünïcödé ☃ text", "de", "s3", 46),
        (8, "Größe über alles, naïve façade — ünïcödé ☃ text", "de", "s3", 46),
    ]
    return rows + [(100 + i, sentence(r, 40), "en", f"s{i % 3}", 1) for i in range(20)]


#: What operators call their own columns where a user's have other names, with cases mixed.
INNER = (
    "full", "_s", "__s", "__full", "__last", "__block", "Number", "whole", "node", "Lead", "gone", "__gone", "row", "__row", "__rid", "__lines", "__all", "all_lines", "Surplus",
    "__score", "kept", "wave", "piece", "copies", "class_doc_id", "n_links", "h1", "h2", "first", "stay",
)


def clashing(df):
    """Extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    for name in ("id", "key", "hash", "sim", "rid", "line", "lines", "score", "root", "bucket", "length", "n", "s", "t", "full", "last", "block", "rank", "source_", "v", "cell", *INNER):
        if name.lower() not in map(str.lower, df.columns):
            df = df.withColumn(name, F.lit("x"))
    return df
