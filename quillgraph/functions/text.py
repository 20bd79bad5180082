"""Text functions as column expressions: tokenisers, normalisers, extractors."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType

from quillgraph.functions.vocabulary import INTENT_STOPWORDS, STOPWORDS

SPACE = "[ \\t\\n\\r\\f\\x0b]+"


@F.pandas_udf(StringType())
def _without_marks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c)))


def fold(text: Column) -> Column:
    """Lower case without marks: compatibility decomposition, combining characters dropped. Only marked texts go to Python."""
    plain = text.rlike(r"^[\x00-\x7f]*$")
    return F.coalesce(F.when(plain, F.lower(text)), _without_marks(F.when(~plain, text)))


def found(text: Column, pattern: str) -> Column:
    """All matches of a pattern."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def is_body_token(word: Column) -> Column:
    """No stop word and more than one letter."""
    return (F.length(word) > 1) & ~word.isin(*STOPWORDS)


def body_words(text: Column) -> Column:
    """Lower-case words that start with a letter: what ``is_body_token`` chooses from, for rows of one word."""
    return found(F.lower(text), "[a-z][a-z0-9'-]*")


def body_tokens(text: Column) -> Column:
    """Lower-case words that start with a letter; no stop words, none of one letter."""
    return F.filter(body_words(text), is_body_token)


def query_tokens(text: Column) -> Column:
    """Body tokens without words that only state an intent."""
    return F.filter(body_tokens(text), lambda t: ~t.isin(*INTENT_STOPWORDS))


def token_set(text: Column) -> Column:
    """Distinct words, stop words included."""
    return F.array_distinct(found(F.lower(text), "[a-z][a-z0-9'-]*"))


def audit_tokens(text: Column) -> Column:
    """Distinct words of three letters or more that aren't stop words."""
    return F.filter(token_set(text), lambda t: (F.length(t) > 2) & ~t.isin(*STOPWORDS))


def squeeze(text: Column) -> Column:
    """White space runs to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def words(text: Column) -> Column:
    """Words between white space; none for null and blank texts."""
    t = squeeze(F.coalesce(text, F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def normalize_title(text: Column) -> Column:
    """Lower-case letters and digits, one blank between runs."""
    return F.array_join(found(F.lower(text), "[a-z0-9]+"), " ")


def normalize_doi(text: Column) -> Column:
    """A DOI without its resolver, in lower case, without trailing punctuation; null where nothing is left."""
    t = F.regexp_replace(F.lower(F.trim(text)), "^https?://(dx\\.)?doi\\.org/", "")
    return F.nullif(F.regexp_replace(t, "[.;, ]+$", ""), F.lit(""))


def identity(text: Column) -> Column:
    """Trimmed and lower-cased; null where nothing is left."""
    return F.nullif(F.lower(F.trim(text)), F.lit(""))


def lookup_key(text: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def path_stem(path: Column) -> Column:
    """A path's last part without ``.pdf``, whichever way its slashes lean."""
    last = F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.regexp_replace(last, "(?i)\\.pdf$", "")


def title_year_key(title: Column, year: Column) -> Column:
    """Normalised title, without marks, and year; null without both."""
    t = F.nullif(normalize_title(fold(title)), F.lit(""))
    return F.when(t.isNotNull() & year.isNotNull(), F.concat(t, F.lit("|"), year.cast("string")))


def first_year(text: Column) -> Column:
    """The first year from 1900 to 2099 that stands alone."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), "(^|[^0-9A-Za-z_])((19|20)[0-9]{2})([^0-9A-Za-z_]|$)", 2).try_cast("int")


def first_doi(text: Column) -> Column:
    """The first DOI in a text, without trailing punctuation; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(text, F.lit("")), "10\\.[0-9]{4,9}/[^ \\t\\n\\r]+", 0), "[.;,]+$", "")


def looks_like_references(text: Column) -> Column:
    """Starts with a heading of references, names DOIs twice, or has five years."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    heading = F.lit(False)
    for h in ("references", "bibliography", "works cited", "literature cited"):
        heading = heading | t.startswith(h)
    dois = F.size(found(t, "doi"))
    years = F.size(F.filter(found(t, "[0-9a-z_]+"), lambda w: w.rlike("^(19|20)[0-9]{2}$")))
    return (t != "") & (heading | (dois >= 2) | (years >= 5))


#: What ``html.unescape`` takes for an entity.
_ENTITY = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@F.pandas_udf(ArrayType(StringType()))
def _unescaped(entities: pd.Series) -> pd.Series:
    return entities.map(lambda found: [html.unescape(x) for x in found])


def html_text(source: Column) -> Column:
    """Line ends for breaks and closed blocks, no tags, all entities as their characters, no white space at a line's end."""
    t = F.regexp_replace(F.coalesce(source, F.lit("")), "(?i)<br[ /]*>|</(p|div|li|h[1-6]|tr)>", "\n")
    t = F.regexp_replace(t, "<[^>]*>", "")
    # Python gets the entities alone, not the texts around them.
    characters = _unescaped(F.regexp_extract_all(t, F.lit(_ENTITY), F.lit(0)))
    t = F.array_join(F.zip_with(F.split(t, _ENTITY, -1), characters, lambda x, c: F.concat(x, F.coalesce(c, F.lit("")))), "")
    return F.trim(F.regexp_replace(t, "[ \\t\u00a0]+\n", "\n"))


def sentences(text: Column) -> Column:
    """Pieces that end at a full stop, an exclamation or a question mark before white space."""
    return F.filter(F.transform(F.split(F.trim(F.coalesce(text, F.lit(""))), "(?<=[.!?])[ \\t\\n\\r]+"), lambda s: F.trim(s)), lambda s: s != "")


def eval_form(text: Column) -> Column:
    """A reference as exact comparisons take it: lower case, white space squeezed."""
    return F.lower(squeeze(F.coalesce(text, F.lit(""))))


def eval_canon(text: Column) -> Column:
    """A reference as similar ones are compared: no ``doi:``, no addresses, letters and digits alone."""
    return _alnum(_without_places(eval_form(text)))


def canon_of_form(form: Column) -> Column:
    """``eval_canon`` of what ``eval_form`` gave; it looks for ``doi:`` and addresses only where there may be some."""
    return _alnum(F.when(form.contains("doi:") | form.contains("http"), _without_places(form)).otherwise(form))


def _without_places(form: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(form, "(^|[^a-z0-9_])doi: *", "$1 "), "https?://[^ ]+", " ")


def _alnum(text: Column) -> Column:
    return F.array_join(found(text, "[a-z0-9]+"), " ")


def is_marker(text: Column) -> Column:
    """Nothing, or only a list marker such as ``[3]``, ``4.`` or ``a-5``."""
    return F.trim(F.coalesce(text, F.lit(""))).rlike(r"^(\[[0-9]+\]|[0-9]+[.)]?|[A-Za-z]-[0-9]+)?$")


def micro(x: Column) -> Column:
    """A score in millionths, rounded half up: comparable between engines."""
    return F.floor(x * 1e6 + 0.5).cast("long")
