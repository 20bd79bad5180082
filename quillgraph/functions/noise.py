"""Random changes to text that depend on a row's key alone: each draw is a digest of seed, key and a counter, so any
partitioning, retry or engine gives the same text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

#: Widths that a reference may be wrapped at.
WIDTHS = (76, 82, 88, 94)


def draw(key: Column, seed: int, counter: Column | int, n: int) -> Column:
    """A whole number from 0 to n - 1: the counter-th of the key's own stream."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")), (F.lit(counter) if isinstance(counter, int) else counter).cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n).cast("int")


def wrap(text: Column, width: Column, indent: str = "    ") -> Column:
    """``text`` in lines of ``width`` characters at most, all but the first indented; longer words stand alone. A text that
    is less than ten characters longer than the width stays as it is."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\r\\f\\x0b]+"), lambda w: w != "")
    begun = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))
    longer = lambda s, w: F.length(s["line"]) + 1 + F.length(w) > width
    step = lambda s, w: (
        F.when(s["line"] == "", F.struct(s["lines"].alias("lines"), w.alias("line")))
        .when(longer(s, w), F.struct(F.concat(s["lines"], F.array(s["line"])).alias("lines"), F.concat(F.lit(indent), w).alias("line")))
        .otherwise(F.struct(s["lines"].alias("lines"), F.concat(s["line"], F.lit(" "), w).alias("line")))
    )
    filled = F.aggregate(words, begun, step, lambda s: F.array_join(F.concat(s["lines"], F.array(s["line"])), "\n"))
    return F.when(F.length(text) < width + 10, text).otherwise(filled)


def reference_block(references: Column, key: Column, seed: int = 0, widths: Sequence[int] = WIDTHS, noise: Sequence[str] = (), noise_share: float = 0.0) -> Column:
    """References as one text, as a page might have them: plain or numbered, each wrapped at a width of its own, and in a
    share of the rows a line of ``noise`` at the end. Draw 0 is the form, 1 and 2 the noise, and 3 on the widths."""
    every = F.array(*map(F.lit, widths))
    lines = F.transform(references, lambda r, i: wrap(r, F.get(every, draw(key, seed, i + 3, len(widths)))))
    numbered = F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    block = F.array_join(F.when(draw(key, seed, 0, 2) == 0, lines).otherwise(numbered), "\n")
    if not noise:
        return block
    noisy = draw(key, seed, 1, 1_000_000) < int(noise_share * 1_000_000)
    return F.when(noisy, F.concat_ws("\n", block, F.get(F.array(*map(F.lit, noise)), draw(key, seed, 2, len(noise))))).otherwise(block)
