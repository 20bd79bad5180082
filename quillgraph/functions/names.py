"""Names, keys and renderings of references."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from quillgraph.functions import text as tx

#: Parts of names that are no names.
SUFFIXES = ("jr", "jr.", "sr", "sr.", "ii", "iii", "iv")
#: Kinds of entries by kind of record.
BIBTEX_TYPES = {"journal": "article", "article": "article", "book": "book", "chapter": "incollection", "conference": "inproceedings", "thesis": "phdthesis", "report": "techreport", "web": "misc"}


def filename_key(path: Column) -> Column:
    """Letters and digits of a file's stem, folded."""
    return F.regexp_replace(tx.fold(tx.path_stem(path)), "[^a-z0-9]+", "")


def clean_authors(names: Column) -> Column:
    """Names with blanks squeezed, without suffixes on their own, each once whatever its case; the first spelling stays."""
    squeezed = F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: tx.squeeze(n)), lambda n: (n != "") & ~F.lower(n).isin(*SUFFIXES))
    return F.transform(F.array_distinct(F.transform(squeezed, lambda n: F.lower(n))), lambda low: F.filter(squeezed, lambda n: F.lower(n) == low)[0])


def bibtex(kind: Column, key: Column, **fields: Column) -> Column:
    """A BibTeX entry; blank fields are left out, braces and backslashes dropped from values."""
    names = F.create_map(*[F.lit(x) for pair in BIBTEX_TYPES.items() for x in pair])
    entry = F.coalesce(names[F.lower(kind)], F.lit("misc"))
    safe = lambda c: F.regexp_replace(c.cast("string"), r"[{}\\]", "")
    lines = F.array_compact(F.array(*[F.when(F.coalesce(safe(c), F.lit("")) != "", F.concat(F.lit(f"  {n} = {{"), safe(c), F.lit("}"))) for n, c in fields.items()]))
    return F.concat(F.lit("@"), entry, F.lit("{"), tx.lookup_key(key), F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}"))


def used_citations(answer: Column) -> Column:
    """Citation ids in square brackets, in order of first use."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(C[0-9]+)\]"), F.lit(1)))


def directive_tokens(question: str, stop: frozenset[str] = frozenset()) -> list[str]:
    """A question's content words in order, each once: what a rewritten query keeps."""
    return list(dict.fromkeys(t for t in re.findall(r"[a-z0-9][a-z0-9'-]*", question.lower()) if len(t) > 2 and t not in stop))


def slug(text: Column) -> Column:
    """Lower-case letters and digits with dashes between runs; ``unknown`` where nothing is left."""
    dashed = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit("unknown"))


def humanize_slug(text: Column) -> Column:
    """Words of a slug: underscores and case changes part them, a blank follows a comma."""
    spaced = F.replace(F.replace(text, F.lit("_"), F.lit(" ")), F.lit(","), F.lit(", "))
    parted = F.regexp_replace(F.regexp_replace(spaced, "([a-z])(?=[A-Z])", "$1 "), tx.SPACE, " ")
    return F.regexp_replace(parted, "^[ _,-]+|[ _,-]+$", "")


def filename_fields(path: Column) -> Column:
    """A struct of author, year and title from a file name like ``Smith2001-SomeTitle.pdf``; else only its title."""
    stem = tx.path_stem(path)
    parts = [F.regexp_extract(stem, "^([A-Za-z]+)([0-9]{4})-(.+)", i) for i in (1, 2, 3)]
    fits = parts[2] != ""
    return F.struct(
        F.when(fits, F.concat(F.upper(F.substring(parts[0], 1, 1)), F.lower(F.substr(parts[0], F.lit(2))))).otherwise("Unknown Author").alias("author"),
        F.when(fits, parts[1].try_cast("int")).alias("year"),
        humanize_slug(F.when(fits, parts[2]).otherwise(stem)).alias("title"),
    )
