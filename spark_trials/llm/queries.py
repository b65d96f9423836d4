"""The registered queries of the corpus operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spark_trials.llm import ann, curve_packing, licenses, mixing, packing, quality, simhash, spelling, substring_dedup, telephony, toxicity, url_filter, vector_codes
from spark_trials.llm.common import table

URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return made.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.telephony(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_packing.pack_along_curve(table(spark, sf_dir, "documents"), tokenizer_path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_mixing, op3_simhash, op4_toxicity, op5_packing, op6_substring_dedup, op7_ann, op8_license_scan, op9_quality, op10_telephony,
        op11_spelling, op12_vector_codes, op13_curve_packing,
    )
}

def _vector_codes_sql(rounds: int = 2) -> str:
    """The rounds of op12 as one query: every part against every entry, for vectors of 64 components."""
    gap = " + ".join(f"(x.{c} - b.{c}) * (x.{c} - b.{c})" for c in "abcd")
    steps = []
    for k in range(rounds + 1):
        steps.append(f"near{k} AS (SELECT x.r, x.p, min(({gap})::HUGEINT * 64 + b.e) AS m FROM parts x JOIN book{k} b ON x.p = b.p GROUP BY x.r, x.p)")
        if k < rounds:
            floors = ", ".join(f"(sum({c}) - ((sum({c}) % count(*) + count(*)) % count(*))) // count(*) AS {c}" for c in "abcd")
            steps.append(f"moved{k} AS (SELECT n.p, n.m % 64 AS e, {floors} FROM near{k} n JOIN parts x ON x.r = n.r AND x.p = n.p GROUP BY 1, 2)")
            kept = ", ".join(f"coalesce(m.{c}, b.{c})::BIGINT AS {c}" for c in "abcd")
            steps.append(f"book{k + 1} AS (SELECT b.p, b.e, {kept} FROM book{k} b LEFT JOIN moved{k} m ON m.p = b.p AND m.e = b.e)")
    chained = ",\n".join(steps)
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
         list_transform(embedding, lambda v: floor(256 * v::DOUBLE)::BIGINT) AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), parts AS (
  SELECT r, p, w[4 * p + 1] AS a, w[4 * p + 2] AS b, w[4 * p + 3] AS c, w[4 * p + 4] AS d FROM kept, range(16) AS t(p)
), book0 AS (
  SELECT p, r - 1 AS e, a, b, c, d FROM parts WHERE r <= 64
),
{chained},
coded AS (
  SELECT r, string_agg(printf('%02x', (m % 64)::INTEGER), '' ORDER BY p) AS code, sum(m // 64)::BIGINT AS error FROM near{rounds} GROUP BY r
), digest AS (
  SELECT sha256(string_agg(concat_ws(',', a, b, c, d), ',' ORDER BY p, e)) AS hex FROM book{rounds}
)
SELECT k.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, d.hex AS codebooks_sha256
FROM kept k JOIN coded c ON c.r = k.r CROSS JOIN digest d
"""


#: Ops 1, 11 (whose crc32 goes bit by bit) and 12 are plain enough for SQL; the others are tested against brute force.
ORACLE_SQL = {
    "op1_url_filter": """
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), split AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut
), parts AS (
  SELECT page_id,
         coalesce(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path
  FROM split
), rules(rule_host, rule_path, says) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), met AS (
  SELECT p.page_id, r.rule_host || r.rule_path AS rule, r.says,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host || r.rule_path) DESC) AS place
  FROM parts p JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.says, 'allow') AS verdict
FROM parts p LEFT JOIN met m ON m.page_id = p.page_id AND m.place = 1
""",
    "op11_spelling": r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents) WHERE length(r) >= 6 GROUP BY 1, 2
), coded AS (
  SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
         lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS bytes FROM runs
), bits AS (
  SELECT run, n, flatten(list_transform(bytes, lambda b: list_transform(range(8), lambda k: CAST((b >> k) & 1 AS BIGINT)))) AS bits FROM coded
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bits),
         lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END), CAST(4294967295 AS BIGINT)) AS h FROM bits
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
  ) WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5
), less AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM words, LATERAL (SELECT unnest(range(length(word))) AS i)
), pairs AS (
  SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS most, min(near) FILTER (WHERE n = top) AS near FROM (SELECT *, max(n) OVER (PARTITION BY word) AS top FROM pairs) GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= 5 * w.n THEN b.near END AS form, CASE WHEN b.most >= 5 * w.n THEN b.most END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), chain AS (
  SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
), ends AS (
  SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL
)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e USING (word)
""",
    "op12_vector_codes": _vector_codes_sql(),
}
