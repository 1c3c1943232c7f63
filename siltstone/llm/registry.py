"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, collocations, exact_dedup, fill_middle, jaccard, line_dedup, mixing, packing, pattern_packing, pii, quality, token_counts, url_filter
from .common import table

#: The rules of the URL query: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 20 is a query, with its whole text, against all documents."""
    docs = table(spark, sf_dir, "documents")
    queries = docs.where(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return bm25.bm25_topk(docs, queries)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_pattern_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_packing.pack_by_patterns(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


OPERATORS = (
    op1_token_counts,
    op2_bm25_topk,
    op3_mix_sources,
    op4_ngram_jaccard,
    op5_quality,
    op6_exact_dedup,
    op7_pii,
    op8_url_filter,
    op9_line_dedup,
    op10_pack,
    op11_collocations,
    op12_fill_middle,
    op13_pattern_pack,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


OP2_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS term FROM documents),
tf AS (
  SELECT doc_id, term, count(*)::DOUBLE AS tf FROM words GROUP BY doc_id, term),
sizes AS (
  SELECT doc_id, sum(tf) AS words FROM tf GROUP BY doc_id),
total AS (
  SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(words) FROM sizes) / (SELECT count(*) FROM documents)::DOUBLE AS mean_words),
rarity AS (
  SELECT term, round(10000.0::DOUBLE * ln(1.0::DOUBLE + (any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE))) AS rarity FROM tf, total GROUP BY term),
weights AS (
  SELECT tf.doc_id, term, round(10000.0::DOUBLE * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * words / mean_words)))) AS weight
  FROM tf JOIN sizes ON tf.doc_id = sizes.doc_id, total),
scored AS (
  SELECT q.doc_id AS query_id, w.doc_id, sum(CAST(r.rarity AS BIGINT) * CAST(w.weight AS BIGINT)) AS points
  FROM (SELECT DISTINCT doc_id, term FROM tf WHERE doc_id % 20 = 0) q JOIN weights w ON q.term = w.term JOIN rarity r ON r.term = q.term
  GROUP BY q.doc_id, w.doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, doc_id) AS rank FROM scored WHERE points > 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(points AS DOUBLE) / 1e8::DOUBLE AS score FROM ranked WHERE rank <= 10
"""

OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS most
  FROM totals),
ranked AS (
  SELECT *, most / weight AS ratio,
         sum(most) OVER by_ratio - most AS before, sum(weight) OVER () - sum(weight) OVER by_ratio + weight AS remaining,
         sum(source_size) OVER () * 1.5::DOUBLE AS share
  FROM weighted WINDOW by_ratio AS (ORDER BY most / weight, place ROWS UNBOUNDED PRECEDING)),
levels AS (
  SELECT *, max(CASE WHEN (share - before) / remaining <= ratio THEN (share - before) / remaining END) OVER () AS level FROM ranked),
targets AS (
  SELECT source, source_size, coalesce(least(most, weight * level), most) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS BIGINT) AS earlier
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - earlier)) END AS BIGINT) AS taken
FROM placed
"""

OP4_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                 ELSE list_distinct([array_to_string(words[i:i + 3], ' ') FOR i IN range(1, len(words) - 2)]) END AS shingles
  FROM split),
posted AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS common
  FROM posted a JOIN posted b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM shared WHERE 100 * common >= 85 * (n + m - common)),
steps AS (
  SELECT x AS doc_id, y AS other FROM links UNION ALL SELECT y, x FROM links),
reached AS (
  SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, s.other FROM reached r JOIN steps s ON r.other = s.doc_id)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, c.component_id
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) c ON s.doc_id = c.doc_id
"""

OP6_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST) AS place,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST) AS keep_id
  FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, text_sha256 FROM g
"""

OP8_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
rules(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (
  SELECT p.*, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS place
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE place = 1
"""

OP9_SQL = r"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, text IS NULL AS no_text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
numbered AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS place FROM split),
lines AS (
  SELECT doc_id, place, length(line) - length(replace(line, ' ', '')) + 1 AS n, regexp_replace(line, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS form
  FROM numbered WHERE trim(line, ' ') <> ''),
leaved AS (
  SELECT *, CAST(n AS VARCHAR) || ':' || array_to_string(string_split(form, ' ')[1:4], ' ') AS leaf FROM lines WHERE n >= 3),
forms AS (
  SELECT leaf, form, n, count(DISTINCT doc_id) AS docs, min((doc_id, place)) AS first, max(doc_id) AS last_doc, min(doc_id) AS first_doc
  FROM leaved GROUP BY leaf, form, n),
mixed AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY leaf) AS in_leaf FROM forms) WHERE in_leaf > 1),
tokens AS (
  SELECT leaf, form, n, docs, unnest(string_split(form, ' ')) AS token, generate_subscripts(string_split(form, ' '), 1) AS spot FROM mixed),
counted AS (
  SELECT leaf, spot, token, sum(docs) AS docs FROM tokens GROUP BY leaf, spot, token),
template AS (
  SELECT leaf, spot, token FROM (
    SELECT *, row_number() OVER (PARTITION BY leaf, spot ORDER BY docs DESC, token DESC) AS place FROM counted) WHERE place = 1 AND docs >= 2),
instances AS (
  SELECT t.leaf, t.form FROM tokens t JOIN template m ON t.leaf = m.leaf AND t.spot = m.spot AND t.token = m.token
  GROUP BY t.leaf, t.form HAVING count(*) >= min(t.n) * 0.7::DOUBLE),
placed AS (
  SELECT f.*, CASE WHEN i.form IS NULL THEN f.form END AS own FROM forms f LEFT JOIN instances i ON f.leaf = i.leaf AND f.form = i.form),
recurring AS (
  SELECT leaf, form, min(first) OVER w AS first, min(first_doc) OVER w <> max(last_doc) OVER w AS recurs
  FROM placed WINDOW w AS (PARTITION BY leaf, own)),
dropped AS (
  SELECT l.doc_id, l.place FROM leaved l JOIN recurring r ON l.leaf = r.leaf AND l.form = r.form
  WHERE r.recurs AND (l.doc_id, l.place) <> r.first),
places AS (
  SELECT doc_id, list(place) AS places FROM dropped GROUP BY doc_id)
SELECT s.doc_id, CASE WHEN s.no_text THEN 0 ELSE CAST(len(s.lines) AS BIGINT) END AS n_lines, CAST(coalesce(len(p.places), 0) AS BIGINT) AS n_dropped,
       sha256(CASE WHEN p.places IS NULL THEN s.text
              ELSE array_to_string([x FOR x, i IN s.lines IF NOT list_contains(p.places, i - 1)], chr(10)) END) AS text_sha256
FROM split s LEFT JOIN places p ON s.doc_id = p.doc_id
"""


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
grams AS (
  SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
  FROM split, (VALUES (1), (2), (3), (4)) AS sizes_of(k)),
f AS (
  SELECT lang, CAST(k AS BIGINT) AS k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30),
cuts AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * c.a // (x.f + y.f) AS BIGINT) AS score, c.cut
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
              JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
spans AS (
  SELECT lang, f, k, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS size FROM f WHERE k > 2),
inside AS (
  SELECT lang, f, unnest([array_to_string(w[i:i + size - 1], ' ') FOR i IN range(1, k - size + 2)]) AS phrase FROM spans),
longest AS (
  SELECT lang, phrase, max(f) AS f FROM inside GROUP BY lang, phrase),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank
  FROM lowest s LEFT JOIN longest o ON o.lang = s.lang AND o.phrase = s.phrase
  WHERE o.f IS NULL OR 100::HUGEINT * o.f < 80::HUGEINT * s.a)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, sizes.n, r.score FROM ranked r JOIN sizes ON sizes.lang = r.lang WHERE r.rank <= 2000
"""

OP12_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
split AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units,
         [CAST('0x' || substr(h, i, 8) AS BIGINT) FOR i IN [1, 9, 17, 25]] AS h
  FROM drawn),
cut AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
              WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM split),
parts AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
         coalesce(array_to_string(units[b + 1:], ''), '') AS suffix
  FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM parts
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_bm25_topk": OP2_SQL, "op3_mix_sources": OP3_SQL, "op4_ngram_jaccard": OP4_SQL, "op6_exact_dedup": OP6_SQL, "op8_url_filter": OP8_SQL, "op9_line_dedup": OP9_SQL, "op11_collocations": OP11_SQL, "op12_fill_middle": OP12_SQL}
