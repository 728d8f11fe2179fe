"""Quality rules: a threshold table compiled into one projection.

A rule bounds a ratio of two counts of a text.  ``quality`` adds the counts, whether the
text fails the base conditions, and the verdict, in one narrow projection of built-in
functions: no shuffle, no user function, whole texts.

Repeated 3-word windows are counted by sorting: each window becomes one long (part of its
hash above, its place below), equal neighbours are compared word by word, and the places
of the windows found twice give the words they cover.  That takes n log n steps however
often a text repeats itself.  If neighbours of one hash have other words, the text's windows
are sorted by their whole hashes and words instead, so the count is exact in any case.

Defined cases: a null text has no words and fails the base; a text of white space has no
words; words are runs of characters other than ``\\x20`` and ``\\x09-\\x0D``; repeated rows
and null ids are kept; the result has only this operator's columns besides ``doc_id``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words, and symbols.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent words of the corpus's languages.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not this are or from at "
    "le la de et les des en un du une que qui dans pour par sur pas au ce avec est se plus "
    "der die und das den von zu mit ist im ein eine auf für dem nicht es sich auch an als "
    "el los y las del por con una su para al lo no como más"
).split()
#: Longest text whose windows are told apart: 2 ** PLACE_BITS words.
PLACE_BITS = 28


@dataclass(frozen=True)
class Rule:
    """Holds if ``least <= counts[over] / counts[under] <= most``; a ratio over 0 holds."""

    name: str
    over: str
    under: str
    least: float | None = None
    most: float | None = None


#: Far from what prose shows (measured over four languages), so that prose stays.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.5, 14.0),
    Rule("symbols_a_word", "n_symbols", "n_words", None, 0.1),
    Rule("exclamations_a_word", "n_exclamations", "n_words", None, 0.5),
    Rule("stop_words", "n_stop_words", "n_words", 0.04, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.45),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.3),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def n_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def n_repeat_words(w: Column, hash_bits: int = 64 - PLACE_BITS) -> Column:
    """Words in 3-word windows that the word array holds twice or more; ``hash_bits`` of a window's hash are sorted first."""
    low = (1 << PLACE_BITS) - 1
    kept = F.lit((1 << hash_bits) - 1)

    def hashed(x: Column, i: Column) -> Column:
        return F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))

    def key(x: Column, i: Column) -> Column:
        part = hashed(x, i) if hash_bits == 64 - PLACE_BITS else hashed(x, i).bitwiseAND(kept)
        return F.shiftleft(part, PLACE_BITS).bitwiseOR(i.cast("long"))

    def same_hash(a: Column, b: Column) -> Column:
        return F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS)

    def same_words(a: Column, b: Column) -> Column:
        i, j = a.bitwiseAND(low).cast("int"), b.bitwiseAND(low).cast("int")
        equal = [F.get(w, i + k) == F.get(w, j + k) for k in range(3)]
        return equal[0] & equal[1] & equal[2]

    def beside(test, s: Column, a: Column, j: Column) -> Column:
        return F.coalesce(test(a, F.get(s, j - 1)), F.lit(False)) | F.coalesce(test(a, F.get(s, j + 1)), F.lit(False))

    def covered(places: Column) -> Column:
        steps = let(F.sort_array(places), lambda p: F.transform(p, lambda a, j: F.least(F.coalesce(F.get(p, j + 1) - a, F.lit(3)), F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    def exactly() -> Column:
        rows = F.transform(first, lambda x, i: F.struct(hashed(x, i).alias("h"), x.alias("x"), F.get(w, i + 1).alias("y"), F.get(w, i + 2).alias("z"), i.cast("long").alias("place")))
        equal = lambda a, b: (a["h"] == b["h"]) & (a["x"] == b["x"]) & (a["y"] == b["y"]) & (a["z"] == b["z"])
        return let(F.sort_array(rows), lambda s: covered(F.transform(F.filter(s, lambda a, j: beside(equal, s, a, j)), lambda a: a["place"])))

    def counted(s: Column) -> Column:
        return let(F.filter(s, lambda a, j: beside(same_hash, s, a, j)), by_hash)

    def by_hash(twice: Column) -> Column:
        clash = F.exists(F.transform(twice, lambda a, j: same_hash(a, F.get(twice, j + 1)) & ~same_words(a, F.get(twice, j + 1))), lambda x: x)
        return F.when(F.coalesce(clash, F.lit(False)), exactly()).otherwise(covered(F.transform(twice, lambda a: a.bitwiseAND(low))))

    n = F.size(w)
    first = F.slice(w, F.lit(1), n - 2)
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(F.sort_array(F.transform(first, key)), counted))


def counts(text: Column) -> Column:
    """A struct of all counts that rules name."""
    stop = [F.lit(x) for x in STOP_WORDS]

    def body(s: Column) -> Column:
        w, lines, t = s["words"], s["lines"], s["text"]
        chars = F.char_length(t).cast("long")
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            (chars - n_of(t, f"[{SPACE}]")).alias("word_chars"),
            n_of(t, f"[{SYMBOLS}]").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            n_repeat_words(w).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            n_of(t, "!").alias("n_exclamations"),
            F.size(F.filter(F.split(F.lower(t), r"[\x20\x09-\x0D.,;:]+"), lambda x: x.isin(stop))).cast("long").alias("n_stop_words"),
            F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("long").alias("n_bullet_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
        )

    with_word = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return let(F.struct(words(text).alias("words"), with_word.alias("lines"), text.alias("text")), body)


def compile_rules(rules: tuple[Rule, ...], c: Column) -> Column:
    """The names of the rules that a struct of counts fails."""
    failed = []
    for r in rules:
        ratio = c[r.over] / F.nullif(c[r.under], F.lit(0))
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (ratio < r.least)
        if r.most is not None:
            bad = bad | (ratio > r.most)
        failed.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*failed))


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts and verdict of every document; ``carry`` names input columns that come back in
    one struct, ``carried``."""
    c = counts(F.coalesce(F.col("text"), F.lit("")))

    def verdict(x: Column) -> Column:
        base = (x["n_words"] < 50) | (100 * x["n_repeat_words"] > 50 * x["n_words"])
        return let(F.struct(x.alias("c"), base.alias("base"), compile_rules(rules, x).alias("failed")), lambda y: y)

    verdicts = let(c, verdict)
    carried = [F.struct(*carry).alias("carried")] if carry else []
    rows = docs.select("doc_id", *carried, verdicts.alias("_verdict"))
    found = F.col("_verdict")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select(
        "doc_id",
        *(found["c"][k].alias(k) for k in names),
        found["base"].alias("base_failed"),
        (~found["base"] & (F.size(found["failed"]) == 0)).alias("kept"),
        F.array_join(found["failed"], ",").alias("failed_rules"),
        *(["carried"] if carry else []),
    )
