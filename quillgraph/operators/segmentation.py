"""Lines, pages and blocks of documents, as windows over ``lines(doc, page, line_no, line)``.

A document's lines are ordered by page and line number; windows never cross documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgraph.functions import text as tx

_HEADING = "^(references|bibliography|works cited|literature cited)[ :.]*$"


def lines_of(docs: DataFrame, key: str, text: str = "text", per_page: int = 40) -> DataFrame:
    """(key, page, line_no, line): trimmed lines that aren't blank; ``per_page`` lines of the text make a page."""
    rows = docs.select(F.col(key), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line"))
    return rows.select(key, (F.floor(F.col("line_no") / per_page) + 1).cast("int").alias("page"), "line_no", F.trim("line").alias("line")).where("line <> ''")


def strip_running_lines(lines: DataFrame, key: str, edge: int = 3, least_pages: int = 2, least_share: float = 0.35) -> DataFrame:
    """Drops page numbers, and lines that stand among a page's first or last three on two pages or more.

    A document that would keep less than the given share of its lines, or none, stays whole.
    """
    norm = F.lower(tx.squeeze(F.col("line")))
    page = Window.partitionBy(key, "page")
    rows = lines.withColumn("norm", norm).withColumns({
        "up": F.row_number().over(page.orderBy("line_no")),
        "down": F.row_number().over(page.orderBy(F.desc("line_no"))),
    })
    at_edge = (F.col("up") <= edge) | (F.col("down") <= edge)
    repeated = rows.where(at_edge).groupBy(key, "norm").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= least_pages).select(key, "norm", F.lit(True).alias("again"))
    number = F.col("norm").rlike("^(page )?[0-9]{1,4}$") | F.col("norm").rlike("^[ivxlcdm]{1,8}$")
    marked = rows.join(repeated, [key, "norm"], "left").withColumn("keep", ~number & ~(F.coalesce("again", F.lit(False)) & ((F.col("up") <= edge) | (F.col("down") <= edge))))
    doc = Window.partitionBy(key)
    counts = marked.withColumns({"kept": F.count_if("keep").over(doc), "n": F.count("*").over(doc)})
    whole = (F.col("kept") == 0) | (F.col("kept") < F.floor(F.col("n") * least_share))
    return counts.where(F.col("keep") | whole).select(*lines.columns)


def split_references(lines: DataFrame, key: str) -> DataFrame:
    """``lines`` with ``part``: main before the first heading of references, references from there on."""
    at = F.min(F.when(F.lower("line").rlike(_HEADING), F.col("line_no"))).over(Window.partitionBy(key))
    return lines.withColumn("part", F.when(F.col("line_no") >= at, "references").otherwise("main"))


def citation_blocks(lines: DataFrame, key: str) -> DataFrame:
    """(key, block, raw_text, year, title_guess): a line that starts like a reference (names, then a year) opens a block."""
    start = F.col("line").rlike("^[A-Z][A-Za-z .,'-]+(\\(|,)? *(19|20)[0-9]{2}([^0-9A-Za-z_]|$)")
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("line", tx.squeeze(F.col("line"))).where("line <> ''").withColumn("block", F.sum(start.cast("int")).over(order))
    # Lines before the first start belong to a block of their own, the first one.
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ")
    blocks = rows.groupBy(key, "block").agg(raw.alias("raw_text"))
    year = tx.first_year(F.col("raw_text"))
    after = F.regexp_extract(F.col("raw_text"), "(^|[^0-9A-Za-z_])(19|20)[0-9]{2}([^0-9A-Za-z_].*|)$", 3)
    guess = F.regexp_replace(F.regexp_replace(F.split(after, "\\.")[0], "^[ .;:-]+", ""), "[ .;:-]+$", "")
    return blocks.withColumns({"year": year, "title_guess": F.when(F.coalesce(guess, F.lit("")) == "", F.substring("raw_text", 1, 120)).otherwise(guess)})


def sections(lines: DataFrame, key: str) -> DataFrame:
    """(key, section, level, title, start_line, end_line): Markdown headings; a section ends before the next heading of its
    level or a higher one."""
    head = lines.where(F.col("line").rlike("^#{1,6} +[^ ]")).select(key, "line_no", F.length(F.regexp_extract("line", "^#+", 0)).alias("level"), F.trim(F.regexp_replace("line", "^#+ +", "")).alias("title"))
    last = lines.groupBy(key).agg(F.max("line_no").alias("last"))
    # Six running minima, one for each level: the next heading of that level or a higher one. Read backwards, so that each
    # frame only grows.
    after = Window.partitionBy(key).orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    next_ = F.coalesce(*[F.when(F.col("level") == n, F.min(F.when(F.col("level") <= n, F.col("line_no"))).over(after)) for n in range(1, 7)])
    rows = head.withColumn("section", F.row_number().over(Window.partitionBy(key).orderBy("line_no"))).withColumn("closing", next_)
    return rows.join(last, key).select(key, "section", "level", "title", F.col("line_no").alias("start_line"), F.coalesce(F.col("closing") - 1, F.col("last")).alias("end_line"))


def reference_tail(lines: DataFrame, key: str, last: int = 80, window: int = 12, least: int = 3) -> DataFrame:
    """(key, start_line): the first line of a bibliography without a heading: among a document's last 80 lines, the first
    that looks like a reference and has three such lines within the twelve from there on."""
    lead = F.col("line").rlike("^(\\[[0-9]+\\]|[0-9]+\\.) ") | F.col("line").rlike("^[A-Z][A-Za-z'-]+,? .*(19|20)[0-9]{2}")
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("line_no")))
    tail = lines.withColumn("back", back).where(F.col("back") <= last).withColumn("lead", lead)
    near = F.sum(F.col("lead").cast("int")).over(Window.partitionBy(key).orderBy("line_no").rowsBetween(0, window - 1))
    return tail.withColumn("near", near).where((F.col("near") >= least) & F.col("lead")).groupBy(key).agg(F.min("line_no").alias("start_line"))


def section_windows(lines: DataFrame, key: str, section: str, size: int = 220, overlap: int = 45) -> DataFrame:
    """(key, section, chunk_index, chunk_text, page_start, page_end): word windows that never cross sections, of 32 words at
    least; chunks are counted through a document. ``lines`` need page and line_no; a section's lines are held together."""
    size = max(32, size)
    overlap = min(max(0, overlap), size - 1)
    step = size - overlap
    held = lines.groupBy(key, section).agg(F.array_sort(F.collect_list(F.struct("line_no", "page", "line"))).alias("ls"))
    words = F.flatten(F.transform("ls", lambda x: F.transform(tx.words(x["line"]), lambda w: F.struct(w.alias("w"), x["page"].alias("p")))))
    cut = held.select(key, section, F.get("ls.line_no", F.lit(0)).alias("first"), words.alias("ws")).where(F.size("ws") > 0)
    last = F.when(F.size("ws") <= size, 0).otherwise(F.ceil((F.size("ws") - size) / F.lit(step)).cast("int"))
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(
            i.alias("i"), F.array_join(F.slice("ws.w", i * step + 1, F.lit(size)), " ").alias("chunk_text"),
            F.get("ws.p", i * step).alias("page_start"), F.get("ws.p", F.least(F.size("ws"), i * step + size) - 1).alias("page_end"),
        ),
    )
    rows = cut.select(key, section, "first", F.inline(windows))
    place = F.row_number().over(Window.partitionBy(key).orderBy("first", "i")) - 1
    return rows.withColumn("chunk_index", place).select(key, section, "chunk_index", "chunk_text", "page_start", "page_end")


def reference_starts(chunks: DataFrame, key: str, position: str, text: str, heading: str = "(?i)(^|[^A-Za-z])(references cited|references|bibliography|works cited)([^A-Za-z]|$)") -> DataFrame:
    """(key, start): where a document's references begin: the first chunk with a heading, else the last one with eight
    numbers of four digits, else the sixth from the end."""
    t = F.coalesce(text, F.lit(""))
    numbers = F.regexp_count(t, F.lit(r"\b[0-9]{4}\b"))
    found = chunks.groupBy(key).agg(
        F.min(F.when(t.rlike(heading), F.col(position))).alias("head"), F.max(F.when(numbers >= 8, F.col(position))).alias("dense"), F.greatest(F.lit(0), F.count("*") - 6).alias("late"),
    )
    return found.select(key, F.coalesce("head", "dense", "late").cast("long").alias("start"))


#: A line of names alone, a line that a year begins, and one of names with a year.
AUTHOR_LINE = r"^[A-Z][A-Za-z'`.-]+(?:,\s*[A-Z][A-Za-z .,'`&-]+)?(?:\s+and\s+[A-Z][A-Za-z .,'`&-]+)?$"
YEAR_LINE = r"^(?:19|20)[0-9]{2}[A-Za-z]?\b"
NAMED_YEAR_LINE = r"^[A-Z].*\b(?:19|20)[0-9]{2}[A-Za-z]?\b"


def recognised_references(lines: DataFrame, key: str, least: int = 28) -> DataFrame:
    """(key, ref_index, raw_text): references in the lines(key, line_no, line) of recognised bibliographies.

    Lines are classed by themselves and the line below: names above a year are an author, who stands for each further year
    that begins a line until the next author; a year, or names with one, opens a reference, and other lines go on with it.
    Blank lines and numbers of pages go first. References of ``least`` characters or more count once each, in any case.
    """
    held = lines.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("_lines"))
    return _listed(held_references(held, key, "_lines", least), key)


def held_references(docs: DataFrame, key: str, lines: str, least: int = 28) -> DataFrame:
    """(key, references): those that ``recognised_references`` finds, in order, of rows that hold their lines as an array.

    Each row is worked by itself, without a shuffle. Lines hold no line ends, so runs of these mark what opens: one before a
    line that goes on, two before a year or names with one, three before an author. An author is always above a year, so
    cutting at three and then at two gives each author's references.
    """
    squeezed = F.filter(F.transform(lines, lambda x: tx.squeeze(F.coalesce(x, F.lit("")))), lambda x: (x != "") & ~x.rlike("^[0-9]{1,3}$"))
    year = lambda x: x.rlike(YEAR_LINE)

    def marked(clean: Column) -> Column:
        author = lambda x, i: x.rlike(AUTHOR_LINE) & year(F.coalesce(F.get(clean, i + 1), F.lit("")))
        opens = lambda x, i: F.when(author(x, i), "\n\n\n").when(year(x) | x.rlike(NAMED_YEAR_LINE), "\n\n").otherwise("\n")
        return F.array_join(F.transform(clean, lambda x, i: F.concat(opens(x, i), x)), "")

    def entries(cut: Column, i: Column) -> Column:
        own = F.transform(F.slice(cut, F.lit(2), F.size(cut)), lambda e: F.replace(e, F.lit("\n"), F.lit(" ")))
        return F.transform(own, lambda e: F.when((i > 0) & year(e), F.concat(F.get(cut, F.lit(0)), F.lit(" "), e)).otherwise(e))

    def once(rows: Column) -> Column:
        first = F.filter(rows, lambda x, i: (i == 0) | (x["low"] != F.get(rows, i - 1)["low"]))
        return F.transform(F.array_sort(F.transform(first, lambda x: F.struct(x["at"].alias("at"), x["raw"].alias("raw")))), lambda x: x["raw"])

    cuts = F.transform(F.split(_bound(squeezed, marked), "\n\n\n"), lambda part: F.split(part, "\n\n"))
    raw = F.transform(F.flatten(F.transform(cuts, entries)), lambda e: F.regexp_replace(e, "^[ .;]+|[ .;]+$", ""))
    # Sorted by their lower case and place, the first of equal ones stays.
    placed = F.array_sort(F.transform(F.filter(raw, lambda e: F.length(e) >= least), lambda e, i: F.struct(F.lower(e).alias("low"), i.alias("at"), e.alias("raw"))))
    return docs.select(key, _bound(placed, once).alias("references"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is formed once, however often it is named: filters that move below a projection repeat it whole."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_recognised(docs: DataFrame, key: str, text: str = "text", stops: tuple[str, ...] = ("article continued from",), least: int = 28) -> DataFrame:
    """(key, ref_index, raw_text): references of recognised texts, from below a line ``references`` to one that holds a stop
    phrase. Texts without such a line have none."""
    return _listed(recognised_bibliographies(docs, key, text, stops, least), key)


def _listed(held: DataFrame, key: str) -> DataFrame:
    # An inner explode would have the references formed twice, once for a filter on their number.
    return held.select(key, F.posexplode_outer("references").alias("ref_index", "raw_text")).where("ref_index is not null")


def recognised_bibliographies(docs: DataFrame, key: str, text: str = "text", stops: tuple[str, ...] = ("article continued from",), least: int = 28) -> DataFrame:
    """(key, references): as ``split_recognised``, a row for each text; null for those without a line ``references``."""
    every = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    ends = lambda x: F.coalesce(_holds(F.lower(x), stops), F.lit(False))

    def below(lines: Column) -> Column:
        start = F.array_position(F.transform(lines, lambda x: F.lower(F.trim(x))), "references").cast("int")
        return F.when(start > 0, F.slice(lines, start + 1, F.size(lines)))

    def region(tail: Column) -> Column:
        stop = F.array_position(F.transform(tail, ends), True).cast("int")
        return F.when(stop > 0, F.slice(tail, F.lit(1), stop - 1)).otherwise(tail)

    return held_references(docs.select(F.col(key), _bound(_bound(every, below), region).alias("_lines")), key, "_lines", least)


def _holds(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out
