"""The registered queries of the operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, divergence, hard_negatives, hnsw, html_extraction, license_scan, line_dedup, minhash, packing, quality_gam, quality_rules, token_counts
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", heavy=True).select("doc_id", "text")
    out = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    sha = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", "n_items", sha, "contaminated")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", heavy=True).select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns; a row without a level (no call, or one on a cycle) has -1."""
    return chat_format.formatted(table(spark, sf_dir, "conversations")).withColumn("level", F.coalesce("level", F.lit(-1).cast("long")))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", heavy=True).select("page_id", "url", "html")
    return html_extraction.extracted(pages, html_extraction.train(pages))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents", heavy=True).select("doc_id", "text"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", heavy=True).select("doc_id", "source", "text")
    out = line_dedup.without_boilerplate(docs, host="source")
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", heavy=True).select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", heavy=True).select("doc_id", "text")
    return quality_gam.scored(docs, quality_gam.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", heavy=True).select("doc_id", "text")
    return quality_rules.with_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents", heavy=True), size=4, threshold=80)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    rows = hard_negatives.quantised(table(spark, sf_dir, "embeddings"), label=label)
    return hard_negatives.mined(rows, F.expr("vec_id % 100 = 0"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents", heavy=True), min_df=3, top=200)


def op13_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.search(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 100 = 0"), k=10)


_ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_ALNUM.format(_ASCII_LOWER.format('text'))}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_ALNUM.format(_ASCII_LOWER.format('text'))} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, array_to_string(w[s + 1 : s + 13], ' ') AS g, least(len(w), 13) AS n
        FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 12, 1))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, p, n, array_to_string(w[p + 1 : p + n], ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS p FROM d, sizes)),
hits AS (SELECT doc_id, p, n, item_id FROM grams JOIN win USING (g, n)),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP3_SQL = f"""
WITH k AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c0 AS (SELECT conv_id, turn, text AS prompt, '{{"prompt":' || to_json(text) || ',"words":' || len({_SPACED.format('text')}) || '}}' AS arguments FROM k WHERE role = 'user'),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY arguments) AS n FROM c0),
r AS (SELECT conv_id, turn - 1 AS turn, text AS content, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS n FROM k WHERE role = 'assistant'),
isle AS (SELECT conv_id, turn, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS isle FROM (SELECT DISTINCT conv_id, turn FROM c)),
lev AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2, isle ORDER BY turn) - 1 AS level FROM isle),
cl AS (SELECT c.*, level FROM c JOIN lev USING (conv_id, turn)),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS id_turn, coalesce(c.turn, r.turn + 1) AS turn, coalesce(c.n, r.n) AS n, c.arguments, c.prompt, r.content,
             CAST(level AS BIGINT) AS level, c.turn IS NOT NULL AS is_call, c.turn IS NOT NULL AND r.turn IS NOT NULL AS linked
      FROM cl c FULL OUTER JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn AND c.n = r.n),
v AS (SELECT conv_id, turn, 'call-' || conv_id || '-' || id_turn || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS call_id, level, linked, arguments, content,
             is_call AND length(prompt) BETWEEN 1 AND 4000 AND len({_SPACED.format('prompt')}) BETWEEN 1 AND 2000 AS valid, CASE WHEN is_call THEN 'reply' END AS name FROM j),
o AS (SELECT conv_id, turn, 'turn-' || conv_id || '-' || turn || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS call_id, CAST(NULL AS BIGINT) AS level, false AS linked,
             CAST(NULL AS VARCHAR) AS arguments, text AS content, false AS valid, role AS name
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text, role NULLS FIRST) AS n FROM k WHERE coalesce(role NOT IN ('user', 'assistant'), true)))
SELECT conv_id, turn, call_id, coalesce(level, -1) AS level, valid, linked,
       '{{"arguments":' || coalesce(arguments, 'null') || ',"content":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || ',"id":"' || call_id
       || '","level":' || coalesce(CAST(level AS VARCHAR), 'null') || ',"linked":' || linked || ',"name":' || coalesce('"' || name || '"', 'null') || ',"valid":' || valid || '}}' AS json
FROM (SELECT * FROM v UNION ALL BY NAME SELECT * FROM o)
"""


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_sql() -> str:
    known = license_scan.known_sentences()
    table_rows = ", ".join(f"({_sql(p)}, {_sql(k)})" for p, k in known.items())
    held = ", ".join(f"CASE WHEN line LIKE {_sql(license_scan.rule_pattern(r))} THEN {_sql(n)} END" for n, r in license_scan.rules())
    weaker = " AND ".join(f"NOT (x = {_sql(n)} AND list_has_any(held, [{', '.join(map(_sql, more))}]))" for n, more in license_scan.MORE_SPECIFIC.items())
    most = max(len(p.split()) for p in known)
    return rf"""
WITH known(sentence, sid) AS (VALUES {table_rows}),
low AS (SELECT doc_id, regexp_replace(replace({_ASCII_LOWER.format("coalesce(text, '')")}, chr(1), ' '), '{license_scan.MARK}', chr(1) || chr(10), 'g') AS t FROM documents),
cut AS (SELECT doc_id, string_split(regexp_replace(t, '{license_scan.PLAIN}', ' ', 'g'), chr(10)) AS raw FROM low),
lists AS (SELECT doc_id, list_transform(raw, lambda x: trim(x, ' ' || chr(1))) AS s, list_transform(raw, lambda x: x[-1] = chr(1)) AS ended FROM cut),
place AS (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS place, unnest(ended) AS ended FROM lists),
upto AS (SELECT doc_id, s, place, coalesce(min(place) FILTER (ended) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), len(s)) AS last FROM place),
spans AS (SELECT doc_id, place, array_to_string(s[place : k], ' ') AS sentence FROM (SELECT *, unnest(range(place, least(last, place + {most}) + 1)) AS k FROM upto WHERE s[place] <> '')),
found AS (SELECT DISTINCT doc_id, place, sid FROM spans JOIN known USING (sentence)),
ids AS (SELECT doc_id, list(sid ORDER BY place, sid) AS ids FROM found GROUP BY 1),
d AS (SELECT doc_id, coalesce(ids, []) AS ids, ',' || array_to_string(coalesce(ids, []), ',,') || ',' AS line FROM documents LEFT JOIN ids USING (doc_id)),
h AS (SELECT doc_id, ids, list_sort(list_distinct(list_filter([{held}], lambda x: x IS NOT NULL))) AS held FROM d)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids, array_to_string(list_filter(held, lambda x: {weaker}), ',') AS licenses FROM h
"""


OP5_SQL = _license_sql()

OP6_SQL = r"""
WITH l AS (SELECT doc_id, source, k, line, trim(line, E' \t\r\x0b\x0c') AS t FROM (
             SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)),
pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY 1),
bad AS (SELECT source, t FROM (SELECT source, t, count(DISTINCT doc_id) AS n FROM l WHERE t <> '' GROUP BY 1, 2) JOIN pages USING (source)
        WHERE n >= 5 AND n > 0.05 * pages),
marked AS (SELECT l.*, bad.t IS NOT NULL AS goes FROM l LEFT JOIN bad ON l.source = bad.source AND l.t = bad.t),
sums AS (SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN goes THEN 1 ELSE 0 END) AS n_dropped,
                coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT goes), '') AS text FROM marked GROUP BY 1)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM sums
"""

_FAILS = quality_rules.fails(30).replace("octet_length(", "strlen(").replace("regexp_like(", "regexp_matches(")
OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, {_SPACED.format('text')} AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS raw FROM d),
g AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 0))) AS p FROM w)),
twice AS (SELECT doc_id, g FROM g GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS k FROM g JOIN twice USING (doc_id, g)) GROUP BY 1),
lines AS (SELECT doc_id, trim(unnest(raw), E' \\t\\r\\x0b\\x0c') AS l FROM w),
held AS (SELECT doc_id, sum(length(l)) AS n, sum(CASE WHEN {_FAILS} THEN length(l) ELSE 0 END) AS lost FROM lines GROUP BY 1),
base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(len(raw) - len(list_distinct(raw)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
         FROM w LEFT JOIN rep USING (doc_id))
SELECT base.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(lost, 0) <= 0.3 * coalesce(n, 0) AS kept
FROM base LEFT JOIN held USING (doc_id)
"""

OP10_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPACED.format(_ASCII_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p + 1 : p + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 3, 1))) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN n USING (doc_id)
"""

_VALID = "FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
OP11_SQL = f"""
WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v {_VALID} AND label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""

_SHARE = "1 + (1000000000 * CAST({0} + 1 AS HUGEINT)) // CAST({1} + n_terms AS HUGEINT)"
OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, k, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT k) >= 3),
sized AS (SELECT lang, count(*) AS n_terms, sum(n) AS n_all FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY 1, 2, 3),
full_c AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, kept.n AS whole
           FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
shares AS (SELECT f.lang, f.source, term, n, {_SHARE.format('n', 'sum(n) OVER (PARTITION BY f.lang, f.source)')} AS p, {_SHARE.format('whole', 'n_all')} AS q
           FROM full_c f JOIN sized ON f.lang = sized.lang),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 200
"""

#: The exact neighbours: equal to what the graphs find where these miss none, as on tables of one shard.
OP13_SQL = f"""
WITH r AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v {_VALID} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, sqrt(list_reduce(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])), lambda x, y: x + y)) AS score
      FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_decontamination": op1_decontamination,
        "op2_packing": op2_packing,
        "op3_chat_format": op3_chat_format,
        "op4_html_extraction": op4_html_extraction,
        "op5_license_scan": op5_license_scan,
        "op6_line_dedup": op6_line_dedup,
        "op7_token_counts": op7_token_counts,
        "op8_quality_gam": op8_quality_gam,
        "op9_quality_rules": op9_quality_rules,
        "op10_minhash": op10_minhash,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_source_divergence": op12_source_divergence,
        "op13_hnsw": op13_hnsw,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": OP1_SQL,
        "op3_chat_format": OP3_SQL,
        "op5_license_scan": OP5_SQL,
        "op6_line_dedup": OP6_SQL,
        "op9_quality_rules": OP9_SQL,
        "op10_minhash": OP10_SQL,
        "op11_hard_negatives": OP11_SQL,
        "op12_source_divergence": OP12_SQL,
        "op13_hnsw": OP13_SQL,
    }
