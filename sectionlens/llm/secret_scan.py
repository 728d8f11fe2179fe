"""Secret scans over a trigram inverted index.

Each rule is a regular expression.  ``trigram_clauses`` derives a Boolean trigram query
from it: one conjunction of trigrams for each way through its literals, at least one of
which any match must satisfy.  ``trigram_index`` holds postings (trigram, doc_id) for the
trigrams that the rule set's queries name; ``candidates`` intersects postings per clause,
and ``scan`` verifies candidates with the expression itself.  Rules without mandatory
trigrams scan every text.  All of it is built-in functions: no Python touches the rows.

``scan`` writes the texts once, each with a number of its own.  Postings and candidates go by
this number, not by ``doc_id``, so rows that share an id (or have none) are spread like others.

Scale: postings are filtered in the scan and partially aggregated per row before the one
shuffle that joins candidates with the texts; no trigram is a shuffle key, so frequent
trigrams make no hot partition.

Defined cases: a null text is empty; spans are code-point offsets, end exclusive, of the
leftmost non-overlapping matches of each rule; matches that fail a rule's length are
dropped; repeated rows are scanned each; other columns are not read unless carried.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import work_dir, written
from .quality_rules import let


@dataclass(frozen=True)
class Rule:
    """``least`` characters at least in capture ``group`` (0: the match), else the match is dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


#: The contract's kinds, then the added ones, in the order in which spans of one start are listed.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    # a match of [0-9a-f]+ is a whole run, so those of 24 or more are the matches of:
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
#: A whole PEM key: up to the END line or, if that is missing, over the base64 that follows.  Classes are
#: repeated rather than groups, whose unbounded repeats would recurse in Java.
_PEM_END = r"[^-]*(?:-{1,4}[^-]+){0,200}-----END [A-Z ]{0,40}PRIVATE KEY-----"
_PEM_CUT = r"[A-Za-z0-9+/=\x09\x0A\x0D\x20\x5C]*[A-Za-z0-9+/=]{24}(?:[\x09\x0D\x20]*\x0A[\x09\x20]*[A-Za-z0-9+/]{1,23}={0,2}[\x09\x0D\x20]*(?:\x0A|$))?"
ADDED = (
    Rule("private_key", rf"-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----(?:{_PEM_END}|{_PEM_CUT})?"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[0-9A-Za-z_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("url_login", r"://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/@]+@", 7),
)
RULES = BASE + ADDED
#: Ways through one expression that are told apart; beyond, a part counts as unknown.
MOST_WAYS = 64
#: Widest character class whose members count as literals.
MOST_CLASS = 8


#: Escapes that stand for a class, and those that stand for no character.
_CLASSES, _EMPTY = set("dDsSwW"), set("bBAZz")
#: A quantifier: one of ? * + or {m}, {m,}, {m,n}, then a mark of how it is matched.
_REPEAT = re.compile(r"(?:([?*+])|\{(\d*)(,?)(\d*)\})[?+]?")


class _Ways:
    """Ways through an expression: literals, with None where anything may stand.

    Reads what rules are made of: literals and escapes, classes, groups, alternatives,
    quantifiers and anchors.
    """

    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def alternatives(self) -> list[list[str | None]]:
        ways = self._sequence()
        while self.at < len(self.pattern) and self.pattern[self.at] == "|":
            self.at += 1
            ways = ways + self._sequence()
        return ways

    def _sequence(self) -> list[list[str | None]]:
        ways: list[list[str | None]] = [[]]
        while self.at < len(self.pattern) and self.pattern[self.at] not in "|)":
            options = self._repeated(self._atom())
            if len(ways) * len(options) > MOST_WAYS:
                options = [[None]]
            ways = [a + b for a, b in product(ways, options)]
        return ways

    def _repeated(self, once: list[list[str | None]]) -> list[list[str | None]]:
        found = _REPEAT.match(self.pattern, self.at)
        if not found:
            return once
        self.at = found.end()
        sign, low, comma, high = found.groups()
        least = {"?": 0, "*": 0, "+": 1}[sign] if sign else int(low or 0)
        most = {"?": 1, "*": None, "+": None}[sign] if sign else int(high) if high else None if comma else least
        if most == 1:
            return once if least else [[], *once]
        return [[*w, None] for w in once] if least else [[None]]

    def _escape(self) -> str | None:
        """The character of an escape; None for a class, the empty string for a place between characters."""
        c = self.pattern[self.at + 1]
        self.at += 2
        if c == "x":
            self.at += 2
            return chr(int(self.pattern[self.at - 2 : self.at], 16))
        return None if c in _CLASSES else "" if c in _EMPTY else {"n": "\n", "t": "\t", "r": "\r"}.get(c, c)

    def _atom(self) -> list[list[str | None]]:
        c = self.pattern[self.at]
        if c == "\\":
            literal = self._escape()
            return [[]] if literal == "" else [[literal]]
        if c == "[":
            return self._class()
        if c == "(":
            return self._group()
        self.at += 1
        return [[]] if c in "^$" else [[None]] if c == "." else [[c]]

    def _group(self) -> list[list[str | None]]:
        self.at += 1
        if flags := re.compile(r"\?[a-zA-Z]+\)").match(self.pattern, self.at):
            self.at = flags.end()
            return [[]]
        if self.pattern.startswith("?", self.at):
            if not self.pattern.startswith("?:", self.at):
                raise ValueError(f"{self.pattern}: a group of a kind that rules don't have")
            self.at += 2
        ways = self.alternatives()
        self.at += 1
        return ways

    def _class(self) -> list[list[str | None]]:
        self.at += 1
        other = self.pattern.startswith("^", self.at)
        self.at += other
        members: list[str | None] = []
        first = True
        while first or self.pattern[self.at] != "]":
            first, c = False, self.pattern[self.at]
            if c == "\\":
                members.append(self._escape())
                continue
            self.at += 1
            if c == "-" and members and members[-1] and self.pattern[self.at] != "]":  # a range from the last one on
                if self.pattern[self.at] == "\\":
                    end = self._escape()
                else:
                    end = self.pattern[self.at]
                    self.at += 1
                members += [chr(x) for x in range(ord(members[-1]) + 1, ord(end or "\0") + 1)]
            else:
                members.append(c)
        self.at += 1
        known = not other and None not in members and len(members) <= MOST_CLASS
        return [[m] for m in members] if known else [[None]]


def trigram_clauses(pattern: str) -> list[list[str]] | None:
    """Conjunctions of lower-case trigrams, one of which every matching text satisfies.

    None if some way through the expression needs no trigram: the rule must scan fully.
    """
    clauses = []
    for way in _Ways(pattern).alternatives():
        runs = "".join("\0" if c is None else c.lower() for c in way).split("\0")
        grams = sorted({run[i : i + 3] for run in runs for i in range(len(run) - 2)})
        if not grams:
            return None
        clauses.append(grams)
    distinct = {tuple(x) for x in clauses}
    return sorted(list(x) for x in distinct if not any(set(y) < set(x) for y in distinct))


def indexed_rules(rules: tuple[Rule, ...]) -> dict[str, list[list[str]]]:
    return {r.kind: c for r in rules if (c := trigram_clauses(r.pattern)) is not None}


def trigram_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id") -> DataFrame:
    """Postings (trigram, doc_id) of the trigrams that the rules' queries name; ``key`` names the column of the ids."""
    grams = sorted({g for clauses in indexed_rules(rules).values() for c in clauses for g in c})

    def present(text: Column) -> Column:
        return F.array_compact(F.array(*(F.when(text.contains(g), F.lit(g)) for g in grams), F.lit(None).cast("string")))

    lowered = F.lower(F.coalesce(F.col("text"), F.lit("")))
    return docs.select(F.col(key).alias("doc_id"), F.explode(let(lowered, present)).alias("trigram")).select("trigram", "doc_id")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, kinds): the rules some clause of which has all its trigrams in the document."""
    wanted = [(kind, i, g, len(c)) for kind, clauses in indexed_rules(rules).items() for i, c in enumerate(clauses) for g in c]
    spark: SparkSession = index.sparkSession
    # as many rows as the rules have trigrams, whatever the corpus
    queries = spark.createDataFrame(wanted or [("", 0, "", 1)], "kind string, clause int, trigram string, n_trigrams int")
    met = index.join(F.broadcast(queries), "trigram").groupBy("doc_id", "kind", "clause", "n_trigrams").agg(F.count("*").alias("n"))
    return met.where("n >= n_trigrams").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


#: Numbers that one running sum adds up; longer lists are summed block by block.
_BLOCK = 256


def sums_before(xs: Column) -> Column:
    """For each number of an array, the sum of those before it."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda a, b: a + b)

    def within(x: Column, base: Column) -> Column:
        return F.transform(x, lambda _, i: base + total(F.slice(x, F.lit(1), i)))

    def by_block(blocks: Column) -> Column:
        return let(F.transform(blocks, total), lambda sums: F.flatten(F.transform(blocks, lambda x, b: within(x, total(F.slice(sums, F.lit(1), b))))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int")), lambda b: F.slice(xs, b * _BLOCK + 1, F.lit(_BLOCK)))
    return F.when(F.size(xs) == 0, F.array().cast("array<int>")).otherwise(let(blocks, by_block))


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end) of a rule's matches in a text."""
    none = F.array().cast("array<struct<start:int,order:int,end:int>>")

    def located(s: Column) -> Column:
        lens = F.transform(s["found"], F.char_length)
        # a match starts after all pieces up to its own and all matches before it
        steps = F.zip_with(F.slice(s["pieces"], F.lit(1), F.size(s["found"])), lens, lambda piece, n: F.char_length(piece) + n)
        ends = F.zip_with(let(steps, sums_before), steps, lambda a, b: a + b)
        rows = F.zip_with(F.zip_with(ends, lens, lambda e, n: F.struct((e - n).alias("start"), F.lit(order).alias("order"), e.alias("end"))), s["group"], lambda x, g: F.struct(x.alias("x"), g.alias("g")))
        return F.transform(F.filter(rows, lambda r: F.char_length(r["g"]) >= rule.least), lambda r: r["x"])

    pattern = F.lit(rule.pattern)
    parts = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.split(text, rule.pattern, -1).alias("pieces"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("group"))
    return F.when(F.regexp_instr(text, pattern) == 0, none).otherwise(let(parts, located))


def _as_text(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["order"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _equals(value: int):
    return lambda x: x == value


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, n_base: int = len(BASE), carry: tuple[str, ...] = ()) -> DataFrame:
    """Spans of every document: counts of the first ``n_base`` rules, their digest, and all spans.

    ``found`` holds the spans as an array of (start, order, end); ``carry`` names input
    columns that come back in one struct, ``carried``.
    """
    kept = ["doc_id", *(["carried"] if carry else [])]
    indexed = indexed_rules(rules)
    # ids and texts are written and shuffled once, also if they are carried
    rest = [c for c in carry if c not in ("doc_id", "text")]
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text", *([F.struct(*rest).alias("_rest")] if rest else []))
    rows = written(rows, work_dir(docs.sparkSession, "secret-scan"))
    hits = candidates(trigram_index(rows, rules, "_row"), rules).select(F.col("doc_id").alias("_hit"), F.col("kinds").alias("_kinds"))
    rows = rows.join(hits, F.col("_row") == F.col("_hit"), "left").withColumn("_text", F.coalesce("text", F.lit("")))
    if carry:
        rows = rows.withColumn("carried", F.struct(*(F.col(c) if c not in rest else F.col("_rest")[c].alias(c) for c in carry)))
    none = F.array().cast("array<struct<start:int,order:int,end:int>>")

    def spans(rule: Rule, order: int) -> Column:
        found = rule_spans(F.col("_text"), rule, order)
        return F.when(F.array_contains("_kinds", rule.kind), found).otherwise(none) if rule.kind in indexed else found

    rows = rows.withColumn("_found", F.sort_array(F.concat(*(spans(r, i) for i, r in enumerate(rules)))))

    def body(found: Column) -> Column:
        base = F.filter(found, lambda s: s["order"] < n_base)
        orders = F.transform(found, lambda s: s["order"])
        each = [F.size(F.filter(orders, _equals(i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(rules[:n_base])]
        return F.struct(*each, F.sha2(_as_text(base, rules), 256).alias("base_sha256"), _as_text(found, rules).alias("spans"), found.alias("found"))

    rows = rows.select(*kept, let(F.col("_found"), body).alias("_out"))
    out = F.col("_out")
    names = [f"n_{r.kind}" for r in rules[:n_base]] + ["base_sha256", "spans", "found"]
    return rows.select("doc_id", *(out[k].alias(k) for k in names), *kept[1:])


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span (merged where they overlap) replaced by a mark."""
    whole = F.coalesce(text, F.lit(""))

    def merged(spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(a: Column, s: Column) -> Column:
            fresh = s["start"] >= a["at"]
            out = F.when(fresh, F.concat(a["out"], F.substring(whole, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(a["out"])
            return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

        return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(whole, a["at"] + 1, F.lit(2**31 - 1) - a["at"])))

    return F.when(F.size(found) == 0, text).otherwise(merged(found))
