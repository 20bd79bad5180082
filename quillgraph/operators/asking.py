"""What comes before and after retrieval of an answer: a question made a query, and retrieved rows made an outcome.

No language model is asked: questions are rewritten by rules, and a question's outcome is the evidence that passes the gate.
All of it is column expressions, a row for each question.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgraph.functions.vocabulary import ANSWER_STOPWORDS, QUESTION_WORDS, REWRITE_GENERIC, Vocabulary
from quillgraph.operators.evidence import gate_relevance, terms

TITLE_TERMS, CONTENT_TERMS, EXTRA_TERMS = 4, 6, 12
SNIPPETS = 3
#: An answer's text by outcome.
ANSWERS = {
    "no_context": "Nothing was found that an answer could rest on.",
    "irrelevant_context": "What was found isn't relevant enough to the question.",
    "failed": "Relevant evidence was found, but no answer was made of it; see the citations and snippets.",
}
REASONS = {"no_context": "no_retrieved_context", "irrelevant_context": "no_relevant_evidence", "failed": "synthesis_unavailable"}


def _list(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _once(words: Column) -> Column:
    """Words in order, each once whatever its case, in its first form."""
    return F.aggregate(words, F.array().cast("array<string>"), lambda out, w: F.when(F.exists(out, lambda x: F.lower(x) == F.lower(w)), out).otherwise(F.concat(out, F.array(w))))


def rewrite_questions(rows: DataFrame, question: str = "question", vocabulary: Vocabulary = Vocabulary(), expansions: Mapping[str, Sequence[str]] | None = None, stop: Sequence[str] = ANSWER_STOPWORDS) -> DataFrame:
    """``rows`` with directive, compact_query, sane and search_query.

    The directive names authors (capitalised words), years, the first words for titles, and further ones with the
    ``expansions`` of the question's words for content. The compact query is its words, each once. It is searched with if it
    is sane: it has words that aren't generic, a word of every family of anchors that the question names, its critical words,
    and isn't too short; else the question is. A question without content words is its own query.
    """
    asked = F.coalesce(F.col(question), F.lit(""))
    clean = F.regexp_replace(asked, "[^A-Za-z0-9\\- ]+", " ")
    words = F.filter(F.regexp_extract_all(clean, F.lit(r"[A-Za-z][A-Za-z\-]{2,}"), F.lit(0)), lambda t: ~F.lower(t).isin(*QUESTION_WORDS))
    low = F.transform("_words", F.lower)
    hints = [F.when(F.array_contains(low, key), _list(more)).otherwise(_list(())) for key, more in (expansions or {}).items()]
    extra = F.filter(F.flatten(F.array(*hints)) if hints else _list(()), lambda t: ~F.array_contains(low, F.lower(t)))
    out = rows.withColumn("_words", words).withColumns({"_extra": extra, "_years": F.regexp_extract_all(clean, F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1))})
    parts = {
        "authors": F.filter("_words", lambda t: F.substring(t, 1, 1).rlike("[A-Z]")), "years": F.col("_years"), "title_terms": F.slice("_words", 1, TITLE_TERMS),
        "content_terms": F.concat(F.slice("_words", TITLE_TERMS + 1, CONTENT_TERMS), F.slice("_extra", 1, EXTRA_TERMS)),
    }
    shown = [F.concat(F.lit(f"{name}: "), F.when(F.size(p) > 0, F.array_join(p, " ")).otherwise("none")) for name, p in parts.items()]
    every = F.filter(F.concat(*parts.values()), lambda t: ~F.lower(t).isin("and", "or", "not"))
    compact = F.array_join(_once(F.regexp_extract_all(F.array_join(every, " "), F.lit(r"[A-Za-z0-9][A-Za-z0-9\-]*"), F.lit(0))), " ")
    out = out.withColumns({"directive": F.array_join(F.array(*shown), " | "), "compact_query": F.coalesce(F.nullif(compact, F.lit("")), F.trim(asked))})

    out = out.withColumns({"_asked": terms(asked, tuple(stop)), "_new": terms(F.col("compact_query"), tuple(stop))})
    named, met = F.lit(0), F.lit(0)
    for family in vocabulary.families.values():
        own = F.array_intersect(F.col("_asked"), _list(family))
        named, met = named + (F.size(own) > 0).cast("int"), met + (F.size(F.array_intersect(own, "_new")) > 0).cast("int")
    critical = F.array_except(F.array_intersect(F.col("_asked"), _list([w for f in vocabulary.families.values() for w in f])), _list(REWRITE_GENERIC))
    kept = F.size(F.array_intersect(critical, "_new")) >= F.greatest(F.lit(1), F.least(F.lit(2), F.size(critical)))
    sane = (
        (F.size(F.array_except(F.col("_new"), _list(REWRITE_GENERIC))) > 0) & (met >= named) & ((F.size(critical) == 0) | kept)
        & (F.size("_new") >= F.greatest(F.lit(2), F.least(F.lit(3), F.size("_asked"))))
    )
    out = out.withColumn("sane", sane)
    return out.withColumn("search_query", F.when(F.col("sane"), F.col("compact_query")).otherwise(F.coalesce(F.nullif(F.trim(asked), F.lit("")), F.col("compact_query")))).drop("_words", "_extra", "_years", "_asked", "_new")


def ground_answers(questions: DataFrame, citations: DataFrame, key: str, position: str = "position", stop: tuple[str, ...] = ANSWER_STOPWORDS, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """One row a question (key, status, fallback_reason, answer, used, excluded, snippets, summary).

    ``questions``: key, question; ``citations``: key, position, text, and title and authors if there are any: what retrieval
    found for a question, a bounded list. They are numbered C1, C2 and so on by position and pass the relevance gate or not.
    No citation is ``no_context``, none that passes ``irrelevant_context``, and the rest ``failed``, since nothing is
    synthesised here: their used citations and the first snippets of them are the result. Questions keep their rows.
    """
    own = [F.col(c).cast("string") for c in ("title", "authors", "text") if c in citations.columns]
    numbered = citations.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(position)))
    pairs = questions.select(key, "question").join(numbered.select(key, "_n", "text", F.concat_ws(" ", *own).alias("evidence")), key)
    judged = gate_relevance(pairs, stop, vocabulary)
    held = judged.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("_n").alias("n"), "usable", "text"))).alias("cs"))
    name = lambda c: F.concat(F.lit("C"), c["n"].cast("string"))
    used, excluded = F.filter("cs", lambda c: c["usable"]), F.filter("cs", lambda c: ~c["usable"])
    text = lambda c: F.trim(F.coalesce(c["text"], F.lit("")))
    snippets = F.transform(F.filter(F.slice(used, 1, SNIPPETS), lambda c: text(c) != ""), lambda c: F.concat(F.lit("["), name(c), F.lit("] "), text(c)))
    none = F.array().cast("array<string>")
    rows = questions.select(key).join(held, key, "left").withColumns({"used": F.coalesce(F.transform(used, name), none), "excluded": F.coalesce(F.transform(excluded, name), none), "snippets": F.coalesce(snippets, none)})
    status = F.when(F.col("cs").isNull(), "no_context").when(F.size("used") == 0, "irrelevant_context").otherwise("failed")
    pick = lambda texts: F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])[F.col("status")]
    rows = rows.withColumn("status", status)
    summary = F.concat(F.size("used").cast("string"), F.lit(" of "), (F.size("used") + F.size("excluded")).cast("string"), F.lit(" retrieved results passed the relevance gate"))
    return rows.select(key, "status", pick(REASONS).alias("fallback_reason"), pick(ANSWERS).alias("answer"), "used", "excluded", "snippets", summary.alias("summary"))
