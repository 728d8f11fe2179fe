"""Queries of the operators of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import merge_dropout, merkle, ngram_join, packing, quality_rules, secret_scan, suffix_dedup, token_counts, token_files, toxicity
from ._shared import work_dir, written

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_documents(token_files.write_token_files(documents(spark, sf_dir), WORD_BPE))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), BYTE_BPE)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = token_counts.length_histogram(documents(spark, sf_dir), BYTE_BPE, end_tokens=1)
    # the sums read it twice: texts are encoded once
    return token_counts.with_suffix_sums(written(histogram, work_dir(spark, "token-counts")))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score_documents(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.encode_and_decode(documents(spark, sf_dir), PIECE_BPE, seed=17, rate=0.1)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir)).drop("found")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_ngram_join": op2_ngram_join,
    "op3_packing": op3_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_token_counts": op5_token_counts,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_fingerprints": op7_fingerprints,
    "op8_toxicity": op8_toxicity,
    "op9_merge_dropout": op9_merge_dropout,
    "op10_secret_scan": op10_secret_scan,
}
_STOP = ", ".join(f"'{x}'" for x in sorted(set(quality_rules.STOP_WORDS)))
OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
a AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
w AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM a),
t AS (SELECT rid, i, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
n AS (SELECT *, z IS NOT NULL AND count(*) OVER (PARTITION BY rid, x, y, z) > 1 AS twice FROM t),
c AS (SELECT rid, twice OR coalesce(lag(twice, 1) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS covered FROM n WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, count(*) FILTER (WHERE covered) AS n FROM c GROUP BY rid),
b AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclamations,
    len(list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D.,;:]+'), lambda x: x IN ({_STOP}))) AS n_stop_words,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines
  FROM a LEFT JOIN r USING (rid)),
v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    concat_ws(',', {", ".join(f"CASE WHEN {' OR '.join([f'{r.over}::DOUBLE / nullif({r.under}, 0) < {r.least}'] * (r.least is not None) + [f'{r.over}::DOUBLE / nullif({r.under}, 0) > {r.most}'] * (r.most is not None))} THEN '{r.name}' END" for r in quality_rules.RULES)}) AS failed_rules FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM v
"""


#: The tree of one text, as SQL over a column ``t`` of (rid, t): fingerprint, root, counts of leaves, their characters.
_ENDS = "CASE WHEN p.h < '4' THEN ';' ELSE ',' END"
_TREE_SQL = rf"""
  SELECT rid, root || ':' || array_to_string(list_transform(range(1, len(hs) + 1), lambda i: left(hs[i], 12) || '(' || bodies[i] || ')'), ';') AS fp, root,
    list_aggregate(leaves, 'histogram') AS counts, coalesce(list_sum(list_transform(leaves, lambda x: right(x, 3)::INT)), 0) AS weight FROM (
    SELECT rid, hs, bodies, leaves, md5(array_to_string(hs, '')) AS root FROM (
      SELECT rid, list_transform(string_split(regexp_replace(array_to_string(list_transform(ps, lambda p: p.h || {_ENDS}), ''), '[;,]$', ''), ';'), lambda x: md5(x)) AS hs,
        string_split(regexp_replace(array_to_string(list_transform(ps, lambda p: left(p.h, 12) || '=' || array_to_string(p.l, '') || {_ENDS}), ''), '[;,]$', ''), ';') AS bodies,
        flatten(list_transform(ps, lambda p: p.l)) AS leaves FROM (
        SELECT rid, list_transform(ls, lambda l: {{'h': md5(array_to_string(list_transform(l, lambda y: md5(y)), '')), 'l': list_transform(l, lambda y: left(md5(y), 8) || lpad(length(y)::VARCHAR, 3, '0'))}}) AS ps FROM (
          SELECT rid, list_transform(string_split(t, chr(10)), lambda x: regexp_extract_all(x, '{merkle.LEAF}')) AS ls FROM SOURCE))))
"""
_ALIKE_SQL = """CASE WHEN a.root = {0}.root THEN 1.0::DOUBLE ELSE coalesce(least(
  2.0::DOUBLE * coalesce(list_sum(list_transform(map_keys(a.counts), lambda k: right(k, 3)::BIGINT * least(map_extract(a.counts, k)[1], coalesce(map_extract({0}.counts, k)[1], 0)))), 0) / nullif(a.weight + {0}.weight, 0),
  (a.weight + {0}.weight)::DOUBLE / (a.weight + {0}.weight + 1)), 0.0) END"""
OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS rid, doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT d.rid, d.doc_id, d.t, coalesce(x.t, (SELECT t FROM d WHERE rid = 1)) AS nt, coalesce(x.rid, 1) AS nrid FROM d LEFT JOIN d x ON x.rid = d.rid + 1),
e AS (SELECT rid, left(t, length(t) - length(t) // 2) || left(nt, length(t) // 2) AS t FROM n),
a AS ({_TREE_SQL.replace("SOURCE", "d")}), b AS ({_TREE_SQL.replace("SOURCE", "e")})
SELECT n.doc_id, length(n.t)::BIGINT AS n_chars, sha256(e.t) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint,
  {_ALIKE_SQL.format("b")} AS near_edited, {_ALIKE_SQL.format("f")} AS near_next
FROM n JOIN e USING (rid) JOIN a USING (rid) JOIN b USING (rid) JOIN a f ON f.rid = n.nrid
"""


def _secret_sql() -> str:
    """Each rule's matches and their places by splitting, then the digests."""
    both_cases = re.compile("password|passwd|secret|token|api|key")
    found, spans = [], []
    for i, r in enumerate(secret_scan.RULES):
        pattern = r.pattern
        if pattern.startswith("(?i)"):
            pattern = both_cases.sub(lambda m: "".join(f"[{c.upper()}{c}]" for c in m[0]), pattern[4:])
        pattern = pattern.replace("'", "''")
        found.append(f"regexp_extract_all(text, '{pattern}') AS m{i}, regexp_extract_all(text, '{pattern}', {r.group}) AS g{i}, string_split_regex(text, '{pattern}') AS p{i}")
        before = f"(list_sum(list_transform(p{i}[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m{i}[1:k - 1], lambda x: length(x))), 0))::BIGINT"
        spans.append(f"list_transform(list_filter(range(1, len(m{i}) + 1), lambda k: length(g{i}[k]) >= {r.least}), lambda k: {{'s': {before}, 'o': {i}, 'e': {before} + length(m{i}[k])}})")
    kinds = ", ".join(f"'{r.kind}'" for r in secret_scan.RULES)
    text = f"coalesce(array_to_string(list_transform({{0}}, lambda x: ([{kinds}])[x.o + 1] || ':' || x.s || ':' || x.e), ','), '')"
    base = f"list_filter(f, lambda x: x.o < {len(secret_scan.BASE)})"
    counts = ", ".join(f"len(list_filter(f, lambda x: x.o = {i}))::BIGINT AS n_{r.kind}" for i, r in enumerate(secret_scan.BASE))
    return (
        f"WITH m AS (SELECT doc_id, {', '.join(found)} FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)), "
        f"f AS (SELECT doc_id, list_sort({' || '.join(spans)}) AS f FROM m) "
        f"SELECT doc_id, {counts}, sha256({text.format(base)}) AS base_sha256, {text.format('f')} AS spans FROM f"
    )


#: Every 100-byte window of every text by its digest; all but the first of equal ones cover what goes.
OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, i, md5_number(substr(h, 2 * i + 1, {2 * suffix_dedup.LENGTH})) AS k FROM (SELECT rid, h, unnest(range(0, len(h) // 2 - {suffix_dedup.LENGTH - 1})) AS i FROM d)),
f AS (SELECT k, min((rid, i)) AS first FROM w GROUP BY k HAVING count(*) > 1),
c AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + {suffix_dedup.LENGTH} THEN 0 ELSE 1 END AS fresh FROM w JOIN f USING (k) WHERE (rid, i) <> first),
s AS (SELECT rid, min(i) AS a, max(i) + {suffix_dedup.LENGTH} AS b FROM (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS n FROM c) GROUP BY rid, n),
p AS (SELECT s.rid, sum(b - a) AS gone, count(*) AS n, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(b) AS last FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM s) s JOIN d ON d.rid = s.rid GROUP BY 1)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM d LEFT JOIN p USING (rid)
"""
#: All pairs that share an n-gram, verified; groups by following links until nothing new is reached.
OP2_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {ngram_join.NGRAM} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {ngram_join.NGRAM - 2}), lambda i: array_to_string(w[i : i + {ngram_join.NGRAM - 1}], ' ')) END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y, c = a.n AND c = b.n AS same FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE {ngram_join.THRESHOLD[1]} * c >= {ngram_join.THRESHOLD[0]} * (a.n + b.n - c)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT doc_id, least(doc_id, m) AS class_id, least(doc_id, e) AS copy_id, coalesce(k, 0) AS n_links FROM documents
LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM r GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT x AS doc_id, count(*) AS k, min(y) FILTER (WHERE same) AS e FROM l GROUP BY 1) USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": OP2_SQL,
    "op6_suffix_dedup": OP6_SQL,
    "op7_fingerprints": OP7_SQL,
    "op10_secret_scan": _secret_sql(),
    "op4_quality_rules": OP4_SQL,
}
