"""Bibliographic entries in loose JSON, by the VARIANT type: a value may be a text, a list, a number or missing, and no shape
fails. All are column expressions over ``entry(text)``; what isn't JSON, or no object, has no fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillgraph.functions import text as tx
from quillgraph.functions.references import YEAR

#: Where an entry's venue stands, in order.
VENUE = ("container-title", "collection-title", "publisher", "publisher-place", "volume", "issue", "page", "note")
_NONE = "array<string>"


def entry(text: Column) -> Column:
    """The JSON as a variant; null where it is none."""
    return F.try_parse_json(text)


def _at(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$['{name}']", "variant")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _text(v: Column) -> Column:
    """A text's value; null for anything else."""
    return F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string"))


def _items(v: Column) -> Column:
    return F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def string_values(v: Column, name: str) -> Column:
    """The trimmed texts of a field that is a text or a list, without blank ones and without what is no text."""
    field = _at(v, name)
    every = F.coalesce(F.transform(_items(field), _text), F.when(_is(field, "STRING"), F.array(_text(field))), F.array().cast(_NONE))
    return F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x != "")


def _first(v: Column, *names: str) -> Column:
    return F.coalesce(*[F.get(string_values(v, n), F.lit(0)) for n in names])


def entry_title(v: Column) -> Column:
    """The first text of title, container title or note; empty without any."""
    return F.coalesce(_first(v, "title", "container-title", "note"), F.lit(""))


def entry_year(v: Column) -> Column:
    """The first year in date and year."""
    return F.regexp_extract(F.array_join(F.concat(string_values(v, "date"), string_values(v, "year")), " "), f"({YEAR})", 1).try_cast("int")


def entry_doi(v: Column) -> Column:
    """The DOI field without its last marks, else the first DOI in note, title and container title; null without one."""
    given = F.regexp_replace(_first(v, "DOI", "doi"), "[.;,]+$", "")
    hay = F.array_join(F.concat(*[string_values(v, n) for n in ("note", "title", "container-title")]), " ")
    return F.coalesce(F.nullif(given, F.lit("")), F.nullif(F.regexp_replace(F.regexp_extract(hay, r"(?i)\b(10\.[0-9]{4,9}/[-._;()/:A-Z0-9]+)\b", 1), "[.;,]+$", ""), F.lit("")))


def entry_authors(v: Column) -> Column:
    """Names of the author list, given before family, or as they stand; each once. What is no list has none."""
    part = lambda x, n: F.trim(F.coalesce(_text(F.try_variant_get(x, f"$.{n}", "variant")), F.lit("")))
    both = lambda x: F.trim(F.concat_ws(" ", F.nullif(part(x, "given"), F.lit("")), F.nullif(part(x, "family"), F.lit(""))))
    name = lambda x: F.when(_is(x, "STRING"), F.trim(_text(x))).otherwise(F.coalesce(F.nullif(both(x), F.lit("")), part(x, "literal")))
    return F.array_distinct(F.filter(F.transform(F.coalesce(_items(_at(v, "author")), F.array().cast("array<variant>")), name), lambda n: n != ""))


def author_tokens(names: Column) -> Column:
    """The last word of each name in lower case, each once."""
    words = F.transform(names, lambda n: F.regexp_extract_all(F.lower(n), F.lit("[A-Za-z][A-Za-z'-]+"), F.lit(0)))
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.size(w) > 0), lambda w: F.element_at(w, -1)))


def entry_fields(text: Column) -> Column:
    """A struct of title, year, doi, authors and author_tokens of an entry's JSON; null where it is no object."""
    v = entry(text)
    return F.when(
        _is(v, "OBJECT"),
        F.struct(entry_title(v).alias("title"), entry_year(v).alias("year"), entry_doi(v).alias("doi"), entry_authors(v).alias("authors"), author_tokens(entry_authors(v)).alias("author_tokens")),
    )


def _shown(v: Column, name: str) -> Column:
    """A text or a number as text, white space squeezed; empty otherwise."""
    field = _at(v, name)
    plain = _is(field, "STRING") | _is(field, "BIGINT") | _is(field, "DECIMAL") | _is(field, "DOUBLE")
    return tx.squeeze(F.coalesce(F.when(plain, F.try_variant_get(field, "$", "string")), F.lit("")))


def issued_year(v: Column) -> Column:
    """The year of ``issued``: its first date part, else its raw text."""
    part, raw = (F.try_variant_get(v, p, "string") for p in ("$.issued['date-parts'][0][0]", "$.issued.raw"))
    return F.regexp_extract(F.coalesce(part, raw, F.lit("")), f"({YEAR})", 1).try_cast("int")


def render_reference(text: Column) -> Column:
    """An entry as a reference: people, year, title, venue and DOI, divided by full stops; null where it is no object.

    People are the author list, else the editor list: a literal name, or family and given name with a comma.
    """
    v = entry(text)
    part = lambda x, n: tx.squeeze(F.coalesce(_text(F.try_variant_get(x, f"$.{n}", "variant")), F.lit("")))
    person = lambda x: F.when(_is(x, "STRING"), tx.squeeze(_text(x))).otherwise(F.coalesce(F.nullif(part(x, "literal"), F.lit("")), F.concat_ws(", ", F.nullif(part(x, "family"), F.lit("")), F.nullif(part(x, "given"), F.lit("")))))
    people = F.filter(F.transform(F.coalesce(_items(_at(v, "author")), _items(_at(v, "editor")), F.array().cast("array<variant>")), person), lambda p: p != "")
    year = F.coalesce(issued_year(v).cast("string"), tx.squeeze(F.coalesce(_text(F.try_variant_get(v, "$.issued.raw", "variant")), F.lit(""))))
    venue = F.array_join(F.filter(F.array(*[_shown(v, n) for n in VENUE]), lambda x: x != ""), ". ")
    doi = F.coalesce(tx.normalize_doi(F.coalesce(F.nullif(_shown(v, "DOI"), F.lit("")), _shown(v, "doi"))), F.lit(""))
    parts = F.filter(F.array(F.array_join(people, "; "), year, _shown(v, "title"), venue, doi), lambda x: x != "")
    return F.when(_is(v, "OBJECT"), F.concat(F.regexp_replace(tx.squeeze(F.array_join(parts, ". ")), "^[. ]+|[. ]+$", ""), F.lit(".")))
