"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, htmltext, langid, licenses, mixing, neardup, packing, quality, topk, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every whole document; documents that are toxic aren't kept."""
    docs = table(spark, sf_dir, "documents")
    out = toxicity.grade(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return out.withColumn("kept", ~F.col("toxic"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of every document, by shingles of four words."""
    return neardup.classes(table(spark, sf_dir, "documents"), words=4)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict of every whole document."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the perspective of each of its participants."""
    out = chat.rotate(table(spark, sf_dir, "conversations"), part_turns=256)
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.withColumn("spans", spans)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for each row whose vec_id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding")))
    return topk.search(rows.select("vec_id", topk.quantised(F.col("embedding")).alias("v")), F.col("vec_id") % 50 == 0)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every whole document."""
    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return out.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = htmltext.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_shared", "n_restored")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known licences that documents, or lines of them, are."""
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_chat, op2_toxicity, op3_langid, op4_neardup, op5_mixing, op6_topk, op7_packing, op8_quality, op9_html, op10_licenses)}


_SPACE = r"\x20\x09-\x0D"

_CHAT = r"""
WITH n AS (SELECT conv_id, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, coalesce(text, '')) - 1 AS r FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, role, r, CAST(r // 256 AS BIGINT) AS part, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS text,
  regexp_replace(regexp_replace(role, '[\x00-\x1F\x7F\x{85}\x{2028}\x{2029}]+', ' ', 'g'), '<(\\*)\|', '<\\\1|', 'g') AS name FROM n),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE conv_id IS NOT NULL AND role IS NOT NULL AND role <> 'system'),
s AS (SELECT conv_id, perspective, part, r, text, coalesce(role = perspective, false) AS own,
  '<|im_start|>' || CASE WHEN role IS NULL THEN 'user' WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN name ELSE 'user name=' || name END || chr(10) AS head
  FROM t JOIN p USING (conv_id)),
m AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS s,
  coalesce(sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, perspective, part ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM s)
SELECT conv_id, perspective, part, string_agg(s, '' ORDER BY r) AS text,
  coalesce(string_agg(CASE WHEN own THEN CAST(CAST(place AS BIGINT) + length(head) AS VARCHAR) || '-' || CAST(CAST(place AS BIGINT) + length(s) - 1 AS VARCHAR) END, ',' ORDER BY r), '') AS spans,
  count(*) AS n_turns, count(CASE WHEN own THEN 1 END) AS n_own
FROM m GROUP BY conv_id, perspective, part
"""

_MIX = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM d GROUP BY source),
r AS (SELECT *, 2.0::DOUBLE * source_size AS bound, 2.0::DOUBLE * source_size / w AS ratio FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(bound) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
a AS (SELECT source, source_size, least(bound, coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1) * w, bound)) AS target FROM l),
c AS (SELECT d.doc_id, d.size, a.source_size, a.target, CASE WHEN a.source_size > 0 THEN floor(a.target)::BIGINT // a.source_size ELSE 0 END AS epochs,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - ahead)) AS BIGINT) AS taken FROM c
"""

_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


def _quality_sql() -> str:
    rules = {"symbols": "n_symbols / word_chars", "dup_lines": "n_dup_lines / n_lines", "repeats": "n_repeat_words / n_words", "long_words": "word_chars / n_words"}
    sets = ", ".join(f"({j}, {', '.join(f'{c!r}::DOUBLE' for c in x.values())})" for j, x in enumerate(quality.cutoff_sets()))
    values = ", ".join(f"CASE WHEN {x.split(' / ')[1]} > 0 THEN {x.replace(' / ', '::DOUBLE / ')}::DOUBLE ELSE 0 END AS v_{k}" for k, x in rules.items())
    hit = " OR ".join(f"v_{k} > c_{k}" for k in rules)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(lang, '?') AS stratum FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^{_SPACE}]+') AS w FROM d),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, CAST(sum(least(3, i - p)) AS BIGINT) AS n FROM (SELECT rid, i, lag(i, 1, -100) OVER (PARTITION BY rid ORDER BY i) AS p FROM rep) GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS l FROM d),
f AS (SELECT d.rid, doc_id, t, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[{_SPACE}]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM d JOIN w USING (rid) JOIN lines USING (rid) LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed, {values} FROM f),
sets(j, {", ".join(f"c_{k}" for k in rules)}) AS (VALUES {sets}),
good AS (SELECT DISTINCT stratum, md5(t) AS t, {", ".join(f"v_{k}" for k in rules)} FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality = 1)),
n AS (SELECT stratum, count(*) AS n, count(*) OVER () AS strata FROM good GROUP BY stratum),
pmf AS (SELECT stratum, n, strata, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({quality.ALPHA!r}) + (n - k) * ln(1 - {quality.ALPHA!r})) AS p FROM (SELECT stratum, n, strata, unnest(range(0, CAST(floor(n * {quality.ALPHA!r}) AS BIGINT) + 1)) AS k FROM n)),
cdf AS (SELECT *, sum(p) OVER (PARTITION BY stratum ORDER BY k) AS c FROM pmf),
most AS (SELECT stratum, max(CASE WHEN c <= {quality.DELTA!r} / strata THEN k ELSE -1 END) AS k FROM cdf GROUP BY stratum),
errors AS (SELECT stratum, j, count(CASE WHEN {hit} THEN 1 END) AS e FROM good JOIN sets ON true GROUP BY stratum, j),
safe AS (SELECT stratum, max(j) AS j FROM errors JOIN most USING (stratum) WHERE e <= k GROUP BY stratum),
cut AS (SELECT * FROM safe JOIN sets USING (j))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({hit}, false) AS kept FROM b LEFT JOIN cut USING (stratum)
"""


def _license_sql() -> str:
    plain = "trim(regexp_replace(lower(x), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
    for a, b in licenses.SPELLINGS:
        plain = f"replace({plain}, '{a}', '{b}')"
    form = f"lambda x: CASE WHEN regexp_matches(lower(x), '{licenses.COPYRIGHT_LINE}') THEN '' ELSE {plain} END"
    lines = lambda text: f"list_transform(string_split({text}, chr(10)), {form})"
    titles = ", ".join(f"'{t}'" for t in ["", *licenses._titles()])
    whole = f"array_to_string(list_filter(l, lambda x: x NOT IN ({titles})), ' ')"
    known = ", ".join("('{}', '{}')".format(name, t.replace("'", "''").replace("\n", "' || chr(10) || '")) for name, t in licenses.known_texts())
    digests = ", ".join(f"('{name}', '{d}')" for name, (_, d) in licenses.DIGESTS.items())
    return f"""
WITH k AS (SELECT DISTINCT license, sha256({whole}) AS digest FROM (SELECT license, {lines("t")} AS l FROM (VALUES {known}) AS x(license, t)) UNION SELECT * FROM (VALUES {digests}) AS y(license, digest)),
d AS (SELECT doc_id, {lines("coalesce(text, '')")} AS l FROM documents),
u AS (SELECT doc_id, 'text' AS unit, CAST(NULL AS BIGINT) AS line, {whole} AS c FROM d UNION ALL SELECT doc_id, 'line', CAST(i - 1 AS BIGINT), l[i] FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d))
SELECT doc_id, unit, line, license, digest FROM (SELECT *, sha256(c) AS digest FROM u) JOIN k USING (digest)
"""


ORACLE_SQL: dict[str, str] = {"op1_chat": _CHAT, "op5_mixing": _MIX, "op6_topk": _TOPK, "op8_quality": _quality_sql(), "op10_licenses": _license_sql()}
