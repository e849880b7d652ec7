"""Paths, extensions and languages as column expressions; nothing here leaves the JVM.

A null path gives null, except in the filters, which give false for it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES: dict[str, str] = {
    ext: language
    for language, exts in {
        "go": "go",
        "javascript": "cjs js jsx mjs",
        "json": "json",
        "markdown": "md mdx",
        "python": "py",
        "rust": "rs",
        "toml": "toml",
        "typescript": "cts mts ts tsx",
        "yaml": "yaml yml",
    }.items()
    for ext in exts.split()
}
INDEXABLE = sorted(LANGUAGES)
SCANNED = "js jsx ts tsx".split()
SCAN_EXCLUDED = ".cache .git .next .turbo build coverage dist node_modules".split()
TREE_IGNORED = ".claude .codex .git .glooit .next .superset .turbo build coverage dist node_modules target".split()
TREE_TESTS = "__test__ __tests__ test tests".split()
TREE_NAMES = "README LICENSE Makefile Dockerfile Procfile".split()
TREE_EXTS = "css env html json md mdx scss sh sql toml txt yaml yml".split() + (
    STRIPPED := "ts tsx js jsx mts mjs cts cjs py rs go java".split()
)


def extension(path: Column) -> Column:
    """What is behind the last dot; the whole path where there is none."""
    return F.substring_index(path, ".", -1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_indexable(path: Column) -> Column:
    """Exact case counts: main.RS is not indexable."""
    return F.coalesce(extension(path).isin(INDEXABLE), F.lit(False))


def language(path: Column) -> Column:
    """The language of a path's extension, '' for an unknown one."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.when(path.isNotNull(), F.coalesce(F.try_element_at(known, extension(path)), F.lit("")))


def language_filter(given: str) -> str:
    """ts, tsx and typescript all mean typescript; what is unknown stays as it is."""
    return LANGUAGES.get(given.rsplit(".", 1)[-1], given)


def has_extension(path: Column, exts: list[str]) -> Column:
    """A real extension of the file's name, in any case; a dot file has none."""
    own = F.regexp_extract(base_name(path), r"(?s)^.+\.([^.]*)$", 1)
    return F.coalesce((own != "") & F.lower(own).isin([e.lower() for e in exts]), F.lit(False))


def parent_dir(path: Column) -> Column:
    """The folder of a file, '.' at the top."""
    above = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    return F.when(above == "", F.lit(".")).otherwise(above)


def relative(root: str, path: Column) -> Column:
    """path below root without slashes around it, '' where it is elsewhere."""
    top = root.rstrip("/")
    inside = F.startswith(path, F.lit(top + "/"))
    return F.when(inside, F.regexp_replace(F.substr(path, F.lit(len(top) + 1)), "^/+|/+$", "")).when(path.isNotNull(), F.lit(""))


def folders(path: Column) -> Column:
    """The folders above the file, outermost first."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def below_excluded(path: Column, excluded: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(folders(path), F.array(*[F.lit(x) for x in excluded]).cast("array<string>")), F.lit(False))


def hidden(path: Column) -> Column:
    """Some part of the path begins with a dot."""
    return F.coalesce(F.rlike(path, F.lit(r"(^|/)\.")), F.lit(False))


def skipped_folder(name: Column, everything: bool = False) -> Column:
    """Folders that a tree leaves out; everything lets test folders in."""
    bad = name.isin(TREE_IGNORED) | F.startswith(name, F.lit("."))
    return F.coalesce(bad if everything else bad | name.isin(TREE_TESTS), F.lit(False))


def shown_file(name: Column) -> Column:
    return F.coalesce(name.isin(TREE_NAMES) | extension(name).isin(TREE_EXTS), F.lit(False))


def strip_known(name: Column) -> Column:
    """The name without its last extension, if that is one of a source file."""
    return F.regexp_replace(name, r"\.(?:" + "|".join(STRIPPED) + r")\z", "")


def natural_key(name: Column) -> Column:
    """An array of structs that sorts file2 before file10, whatever the case; the raw name decides last.

    Runs of digits compare as numbers, all other pairs of runs as lower-case text; a run
    of digits compares with other text by its digits.
    """
    low = F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = F.regexp_extract_all(low, F.lit("(?s)([0-9]+|[^0-9]+)"), 1)

    def part(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=[0-9])", "")
        number = F.rlike(run, F.lit("^[0-9]+$"))
        # as text, digits sort among the other first characters; equal first digits then by length and value
        return F.struct(
            F.when(number, F.lit("0")).otherwise(run).alias("text"),
            F.when(number, F.length(digits)).otherwise(F.lit(0)).alias("digits"),
            F.when(number, digits).otherwise(F.lit("")).alias("value"),
        )

    return F.struct(F.transform(runs, part).alias("parts"), name.alias("name"))
