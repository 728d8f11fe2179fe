"""Column functions over text.  All are built-in expressions, so they stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str.split`` knows it (a fixed value), inside a character class of a
#: pattern that begins with ``UNICODE``: the property is twice as fast as its characters one by one.
UNICODE, SPACE = "(?U)", r"\s\x1c-\x1f"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` worked out once and not again at every use of it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words between white space; null gives none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"{UNICODE}[^{SPACE}]+"), F.lit(0)), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"{UNICODE}[^{SPACE}]+")), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"{UNICODE}^[{SPACE}]+|[{SPACE}]+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"{UNICODE}[{SPACE}]+", " "))


def sentences(text: Column) -> Column:
    """Parts between white space that follows ``.``, ``!`` or ``?`` and precedes A-Z; trimmed, none empty."""
    parts = F.split(text, f"{UNICODE}(?<=[.!?])[{SPACE}]+(?=[A-Z])")
    return F.coalesce(F.filter(F.transform(parts, strip), lambda x: x != ""), F.array().cast("array<string>"))


def windows(ws: Column, most: int, overlap: int) -> Column:
    """Texts of at most ``most`` words, each ``overlap`` words into the one before; no words, no texts.

    An overlap of ``most`` or more becomes a quarter of it.
    """
    overlap = overlap if overlap < most else most // 4
    step = most - overlap

    def cut(xs: Column) -> Column:
        last = F.ceil(F.greatest(F.size(xs) - F.lit(most), F.lit(0)) / step).cast("int")
        made = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(xs, i * step + 1, F.lit(most)), " "))
        return F.when(F.size(xs) > 0, made).otherwise(F.array().cast("array<string>"))

    return let(ws, cut)


def hard_split(text: Column, most: int) -> Column:
    return windows(words(text), most, 0)


def key_phrase(text: Column, most: int = 15) -> Column:
    """The first ``most`` words before the first full stop, the first letter in lower case."""
    phrase = F.array_join(F.slice(words(F.substring_index(text, ".", 1)), F.lit(1), F.lit(most)), " ")
    return F.concat(F.lower(F.left(phrase, F.lit(1))), F.substring(phrase, F.lit(2), F.lit(1 << 30)))


def token_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def jaccard(a: Column, b: Column) -> Column:
    """Of lower-case word sets; 0 if one is empty."""

    def share(s: Column) -> Column:
        x, y = s["x"], s["y"]
        return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))

    return let(F.struct(token_set(a).alias("x"), token_set(b).alias("y")), share)


def token_f1(predicted: Column, gold: Column) -> Column:
    """Of lower-case words with their multiplicities; 0 if one text has none or none is common."""

    def f1(s: Column) -> Column:
        p, g = s["p"], s["g"]

        def times(xs: Column, w: Column) -> Column:
            return F.size(F.filter(xs, lambda x: x == w))

        common = F.aggregate(F.array_intersect(p, g), F.lit(0), lambda n, w: n + F.least(times(p, w), times(g, w)))
        return F.when((F.size(p) == 0) | (F.size(g) == 0), F.lit(0.0)).otherwise(2.0 * common / (F.size(p) + F.size(g)))

    return let(F.struct(words(F.lower(predicted)).alias("p"), words(F.lower(gold)).alias("g")), f1)


def decision(answer: Column) -> Column:
    """yes, no or maybe if that is the first word, else unknown."""
    first = F.regexp_replace(F.lower(F.get(words(answer), F.lit(0))), r"[.,;:!]+$", "")
    return F.when(first.isin("yes", "no", "maybe"), first).otherwise(F.lit("unknown"))


def user_prompt(question: Column, contexts: Column) -> Column:
    """Numbered contexts, an empty line, the question."""
    numbered = F.transform(contexts, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c))
    return F.concat_ws("\n", F.lit("Context:"), F.array_join(numbered, "\n"), F.lit(""), F.concat(F.lit("Question: "), question))


def without_code_fence(text: Column) -> Column:
    """The inside of a ```-fenced answer, or the answer."""
    return strip(F.regexp_replace(strip(text), r"^```[A-Za-z]*\s*|\s*```$", ""))
