"""Fields of one raw reference: authors as a small parser over name shapes, the rest as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType

from quillgraph.functions import text as tx
from quillgraph.functions.names import SUFFIXES

YEAR = r"\b(?:1[5-9]|20)\d{2}\b"
_DOI = r"10\.\d{4,9}/\S+"
#: Words inside family names, and words that open a title.
PARTICLES = ("van", "von", "de", "der", "den", "del", "della", "di", "da", "la", "le", "du", "ten", "ter", "dos")
TITLE_WORDS = ("an", "the", "on", "in", "of", "for", "to", "with", "from", "and")
#: Roles that are no names.
ROLES = ("ed", "ed.", "eds", "eds.")

# Shapes of names: i initials, w a capitalised word, p a particle.
_FAMILY = re.compile("p*w{1,2}")
_GIVEN = re.compile("i{1,3}|w|wi{1,2}")
_FULL = re.compile("(?:i|w)(?:i|w){0,3}p*w")


def _letter(token: str) -> str:
    letters = [c for c in token if c.isalpha()]
    if token.lower() in PARTICLES:
        return "p"
    if not letters or not token[0].isupper() or token.lower() in TITLE_WORDS or any(c not in ".-'’`" and not c.isalpha() for c in token):
        return "x"
    if all(c.isupper() for c in letters) and (len(letters) < 3 or "." in token):
        return "i"
    return "x" if "." in token.rstrip(".") else "w"


def authors(text: str | None) -> list[str]:
    """Given names before family names, each author once; empty for null and blank texts.

    Names end at the first year, colon, "in:" or "et al.", or where a part between commas has no name's shape. A family
    name and a given part after a comma are one author; a name of two words needs initials in its given part, as two full
    names in a row are two authors. Initials on their own, suffixes and roles are dropped, and so is a full stop right before the year.
    """
    head = re.split(YEAR, " ".join((text or "").split()), maxsplit=1)[0].strip(" .,:;-")
    head = re.sub(r"^(?:\[\d+\]|\d{1,3}[.)])\s*", "", head)
    head = re.split(r"(?i)\bin:|\bet al\b|:|\(", head, maxsplit=1)[0].strip(" ,;")
    pieces = re.split(r"\s*(,\s*(?:and\b|&)|,|;|\band\b|&)\s*", head)
    parts, joints = pieces[::2], [j == "," for j in pieces[1::2]] + [False]
    kept = [(p, "".join(map(_letter, p.split())), j) for p, j in zip(parts, joints, strict=True) if p]
    found: list[str] = []
    k = 0
    while k < len(kept):
        part, shape, comma = kept[k]
        after = kept[k + 1] if comma and k + 1 < len(kept) else ("", "", False)
        if part.lower() in (*SUFFIXES, *ROLES):
            k += 1
        elif _FAMILY.fullmatch(shape) and _GIVEN.fullmatch(after[1]) and (shape.count("w") == 1 or "i" in after[1]):
            found.append(f"{after[0]} {part}")
            k += 2
        elif _FULL.fullmatch(shape) or (shape == "w" and (not found or not kept[k - 1][2])):
            found.append(part)
            k += 1
        elif shape and set(shape) == {"i"} and found:
            k += 1
        else:
            break
    return list(dict.fromkeys(found))


@F.pandas_udf(ArrayType(StringType()))
def author_names(texts: pd.Series) -> pd.Series:
    """``authors`` of each text."""
    return texts.map(authors)


def family_names(names: Column) -> Column:
    """The last word of each name in lower case, each once."""
    return F.array_distinct(F.filter(F.transform(names, lambda n: F.element_at(F.split(F.lower(n), " "), -1)), lambda w: w != ""))


def year(text: Column) -> Column:
    """The first year from 1500 to 2099; null without one."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), f"({YEAR})", 1).try_cast("int")


def doi(text: Column) -> Column:
    """The first DOI, normalised; null without one."""
    return tx.normalize_doi(tx.first_doi(text))


def title(text: Column, most: int = 240) -> Column:
    """What stands after the year up to the first full stop, without DOIs; the whole text where nothing is left."""
    clean = tx.squeeze(F.coalesce(text, F.lit("")))
    place = F.regexp_instr(clean, F.lit(YEAR))
    rest = F.when(place > 0, F.substring(clean, place + 4, F.length(clean))).otherwise(clean)
    ends = "^[ .,:;]+|[ .,:;]+$"
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, ends, ""), _DOI, ""), ends, "")
    first = F.regexp_replace(F.split(rest, r"\.\s+", 2)[0], ends, "")
    return F.substring(F.when(first != "", first).otherwise(clean), 1, most)
