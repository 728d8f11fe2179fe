"""Document fingerprints: a Merkle tree over paragraphs and sections.

A text's lines are its paragraphs; a paragraph's leaves are its sentences, cut at 256
characters where none ends.  A section is a run of paragraphs that ends after one whose
hash begins with 0-3, so that an edit moves section bounds near itself only.  A paragraph
hashes its leaves' digests, a section its paragraphs', the root its sections': whole MD5
digests all the way up, so that equal roots tell equal texts.

The fingerprint writes the tree down: ``root:sections``, sections joined by ``;``, each
``hash(paragraphs)`` with paragraphs joined by ``,``, each ``hash=leaves``, each leaf 8 hex
digits and 3 of its length; hashes below the root are shortened to 12 digits in print.
``likeness`` of two fingerprints is 1 for equal roots, else twice the characters in common
leaves (each as often as both hold it) over the characters of both, and always below 1.
``differing`` walks two trees: branches of equal hashes are left out, and what remains are
the edited paragraphs with their places in the text.

All is built-in functions.  ``with_next`` needs each document's successor in descending id
order without a global sort.  The texts are written once with their order keys (id, hash of
the text, row); a sample of the keys cuts them into ranges, ``RANGES`` a shuffle partition;
each range is one window partition, and the first row of each range is also sent to the
range before it, so the texts are shuffled once.  Splitters are keys of rows, not of ids, so
rows that share an id, or have none, fall into many ranges.  What is broadcast is a row a
range, and the sample holds ``SAMPLES`` keys a range.

Defined cases: a null text is empty (one empty paragraph without leaves); texts without
leaves have the likeness 1 or 0 as their roots tell; rows with equal ids follow each other
in the order of their texts' hashes; null ids come last; a table of one row is its own
successor; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import shuffle_partitions, work_dir, written
from .quality_rules import let
from .secret_scan import sums_before

#: Ranges of ids for each shuffle partition, and keys that are sampled for each range.
RANGES, SAMPLES = 4, 10
LEAF = r"[^.!?|]{1,256}[.!?|]{0,64}|[.!?|]{1,256}"


def _md5(value: Column) -> Column:
    return F.md5(value.cast("binary"))


def paragraphs(text: Column) -> Column:
    """Array of (hash, leaves) of a text's lines; leaves are 8 hex digits and 3 digits of length."""

    def leaf(x: Column) -> Column:
        return F.struct(_md5(x).alias("hash"), F.lpad(F.char_length(x).cast("string"), 3, "0").alias("n"))

    def paragraph(line: Column) -> Column:
        leaves = F.transform(F.regexp_extract_all(line, F.lit(LEAF), F.lit(0)), leaf)
        printed = lambda x: F.transform(x, lambda y: F.concat(F.left(y["hash"], F.lit(8)), y["n"]))
        return let(leaves, lambda x: F.struct(_md5(F.array_join(x["hash"], "")).alias("hash"), printed(x).alias("leaves")))

    return F.transform(F.split(text, "\n"), paragraph)


def tree(text: Column) -> Column:
    """(fingerprint, root, leaves): leaves as runs (leaf, times) in order."""

    def rooted(s: Column, ps: Column) -> Column:
        root = _md5(F.array_join(s["hash"], ""))
        printed = F.transform(s, lambda x: F.concat(F.left(x["hash"], F.lit(12)), F.lit("("), x["body"], F.lit(")")))
        return F.struct(
            F.concat(root, F.lit(":"), F.array_join(printed, ";")).alias("fingerprint"),
            root.alias("root"),
            _counted(F.flatten(ps["leaves"])).alias("leaves"),
        )

    def sectioned(ps: Column) -> Column:
        # sections are told by the separators that follow paragraphs: ';' after one that ends a section
        end = F.transform(ps, lambda p: F.when(p["hash"] < "4", F.lit(";")).otherwise(F.lit(",")))
        hashes = F.split(F.regexp_replace(F.array_join(F.zip_with(ps, end, lambda p, e: F.concat(p["hash"], e)), ""), "[;,]$", ""), ";")
        body = F.zip_with(ps, end, lambda p, e: F.concat(F.left(p["hash"], F.lit(12)), F.lit("="), F.array_join(p["leaves"], ""), e))
        bodies = F.split(F.regexp_replace(F.array_join(body, ""), "[;,]$", ""), ";")
        return let(F.zip_with(hashes, bodies, lambda h, x: F.struct(_md5(h).alias("hash"), x.alias("body"))), lambda s: rooted(s, ps))

    return let(paragraphs(text), sectioned)


def _counted(leaves: Column) -> Column:
    """Distinct leaves in order, and how often each occurs."""

    def runs(x: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i) != F.get(x, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(x, i).alias("leaf"), (F.coalesce(F.get(at, k + 1), F.size(x)) - i).alias("times"))))

    none = F.array().cast("array<struct<leaf:string,times:int>>")
    return let(F.array_sort(leaves), lambda x: F.when(F.size(x) == 0, none).otherwise(runs(x)))


def _length(leaf: Column) -> Column:
    return F.right(leaf, F.lit(3)).cast("long")


def _weight(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, x: n + _length(x["leaf"]) * x["times"])


def _common(a: Column, b: Column) -> Column:
    """Characters in leaves that both have: of each leaf, as many as the one with fewer."""

    def shared(x: Column) -> Column:
        # a leaf of both stands twice in a row, with the lesser count first
        pairs = F.transform(x, lambda y, i: F.when(F.get(x, i + 1)["leaf"] == y["leaf"], _length(y["leaf"]) * y["times"]).otherwise(F.lit(0).cast("long")))
        return F.aggregate(pairs, F.lit(0).cast("long"), lambda n, y: n + y)

    return let(F.sort_array(F.concat(a, b)), shared)


def _alike(a: Column, b: Column) -> Column:
    def share(both: Column) -> Column:
        most = both / (both + 1)  # other roots are never wholly alike
        return F.least(F.lit(2.0) * _common(a["leaves"], b["leaves"]) / F.nullif(both, F.lit(0)), most)

    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(F.coalesce(let(_weight(a["leaves"]) + _weight(b["leaves"]), share), F.lit(0.0)))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprint strings, 0 to 1, read from the strings alone."""

    def parsed(x: Column) -> Column:
        lists = F.regexp_extract_all(x, F.lit("=([0-9a-f]*)"), F.lit(1))
        leaves = F.flatten(F.transform(lists, lambda s: F.regexp_extract_all(s, F.lit("[0-9a-f]{8}[0-9]{3}"), F.lit(0))))
        return F.struct(F.substring_index(x, ":", 1).alias("root"), _counted(leaves).alias("leaves"))

    return let(F.struct(parsed(a).alias("a"), parsed(b).alias("b")), lambda s: _alike(s["a"], s["b"]))


def differing(a: Column, b: Column) -> Column:
    """Where the text of fingerprint ``a`` differs from that of ``b``, read from the strings alone:
    array of (section, paragraph, start, end), characters of a's text, end exclusive.

    Sections that ``b`` has as well are left out, and of the others the paragraphs that ``b``'s
    differing sections have.  Empty for equal roots.
    """
    none = F.array().cast("array<struct<section:int,paragraph:int,start:int,end:int>>")

    def sections(x: Column) -> Column:
        return F.split(F.substring_index(x, ":", -1), ";")

    def inner(section: Column) -> Column:
        return F.split(F.regexp_replace(F.substring_index(section, "(", -1), r"\)$", ""), ",")

    def known(mine: Column, theirs: Column) -> Column:
        other = F.filter(theirs, lambda x: ~F.array_contains(mine, x))
        return F.transform(F.flatten(F.transform(other, inner)), lambda p: F.left(p, F.lit(12)))

    def walked(s: Column) -> Column:
        ps = F.flatten(F.transform(s["a"], lambda x, i: F.transform(inner(x), lambda p: F.struct(i.alias("section"), p.alias("p"), F.array_contains(s["b"], x).alias("same")))))
        return let(F.struct(ps.alias("ps"), known(s["a"], s["b"]).alias("known")), placed)

    def placed(s: Column) -> Column:
        lens = F.transform(s["ps"], lambda p: F.aggregate(F.regexp_extract_all(F.substring_index(p["p"], "=", -1), F.lit("[0-9a-f]{8}([0-9]{3})"), F.lit(1)), F.lit(0), lambda n, x: n + x.cast("int")))
        return let(F.struct(s["ps"].alias("ps"), s["known"].alias("known"), lens.alias("lens")), told)

    def told(s: Column) -> Column:
        starts = let(F.transform(s["lens"], lambda n: n + 1), sums_before)
        rows = F.zip_with(F.zip_with(s["ps"], s["lens"], lambda p, n: F.struct(p.alias("p"), n.alias("n"))), starts, lambda x, at: F.struct(x["p"].alias("p"), x["n"].alias("n"), at.alias("at")))
        numbered = F.transform(rows, lambda x, k: F.struct(x["p"]["section"].alias("section"), k.alias("paragraph"), x["at"].alias("start"), (x["at"] + x["n"]).alias("end"), (x["p"]["same"] | F.array_contains(s["known"], F.left(x["p"]["p"], F.lit(12)))).alias("same")))
        return F.transform(F.filter(numbered, lambda x: ~x["same"]), lambda x: F.struct(x["section"], x["paragraph"], x["start"], x["end"]))

    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), none).otherwise(let(F.struct(sections(a).alias("a"), sections(b).alias("b")), walked))


def _range_of(key: list[Column], splitters: list[tuple[int, ...]]) -> Column:
    """How many splitters a key isn't below, by binary search in constant arrays."""
    if not splitters:
        return F.lit(0)
    columns = [F.split(F.lit(",".join(str(x[k]) for x in splitters)), ",").cast("array<long>") for k in range(len(key))]

    def reached(i: Column) -> Column:
        out = F.lit(True)
        for k in range(len(key) - 1, -1, -1):
            at = F.get(columns[k], i)
            out = (key[k] > at) | ((key[k] == at) & out)
        return (i < len(splitters)) & F.coalesce(out, F.lit(False))

    steps = [1 << k for k in range(len(splitters).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, step: n + F.when(reached(n + step - 1), step).otherwise(F.lit(0)))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): each document with the next one's text in descending id order."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    # ascending order of the keys: null ids last, others by the complement of the id, which can't overflow
    keys = [doc_id.isNull().cast("long").alias("_none"), F.coalesce(F.bitwise_not(doc_id), F.lit(0)).alias("_falling"), F.xxhash64(text).alias("_hash"), F.monotonically_increasing_id().alias("_row")]
    rows = written(docs.select(doc_id.alias("doc_id"), text.alias("text"), *keys), work_dir(spark, "fingerprints"))
    names = ["_none", "_falling", "_hash", "_row"]
    n_ranges, n = RANGES * shuffle_partitions(spark), rows.count()
    sampled = rows.select(*names)
    if n > 2 * SAMPLES * n_ranges:
        sampled = sampled.sample(SAMPLES * n_ranges / n, seed=11)
    found = sorted(tuple(r) for r in sampled.collect())  # bounds only: every row falls into a range
    splitters = sorted({found[k * len(found) // n_ranges] for k in range(1, n_ranges)}) if found else []
    own = rows.withColumn("_range", _range_of([F.col(x) for x in names], splitters))
    # the first row of each range, for the range before it (the lowest's for the last): a row a range
    rising = Window.orderBy("_range")
    heads = own.groupBy("_range").agg(F.min(F.struct(*names)).alias("_head")).withColumn("_to", F.lag("_range").over(rising))
    last = F.max("_range").over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(F.col("_head._row").alias("_head"), F.coalesce("_to", last).alias("_to"))
    sent = rows.join(F.broadcast(heads), F.col("_row") == F.col("_head")).select("doc_id", "text", *names, F.col("_to").alias("_range"), F.lit(True).alias("_ahead"))
    order = Window.partitionBy("_range").orderBy("_ahead", *names)
    both = own.withColumn("_ahead", F.lit(False)).unionByName(sent)
    return both.withColumn("next_text", F.lead("text").over(order)).where(~F.col("_ahead")).select("doc_id", "text", "next_text")


def edited(text: Column, following: Column) -> Column:
    """The text with its last half (rounded down) replaced by as much of the start of another."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.left(text, F.char_length(text) - half), F.left(following, half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every document and of its edited text, and how alike they are."""
    rows = with_next(docs)
    text, following = F.col("text"), F.col("next_text")

    def body(s: Column) -> Column:
        e = s["edited"]
        return let(F.struct(tree(s["text"]).alias("a"), tree(e).alias("e"), tree(s["next"]).alias("n"), e.alias("t")), result)

    def result(s: Column) -> Column:
        return F.struct(
            F.sha2(s["t"], 256).alias("edited_sha256"), s["a"]["fingerprint"].alias("fingerprint"), s["e"]["fingerprint"].alias("edited_fingerprint"),
            _alike(s["a"], s["e"]).alias("near_edited"), _alike(s["a"], s["n"]).alias("near_next"),
        )

    out = rows.select("doc_id", F.char_length(text).cast("long").alias("n_chars"), let(F.struct(text.alias("text"), edited(text, following).alias("edited"), following.alias("next")), body).alias("o"))
    return out.select("doc_id", "n_chars", "o.edited_sha256", "o.fingerprint", "o.edited_fingerprint", "o.near_edited", "o.near_next")
