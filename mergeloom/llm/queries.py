"""The queries of the training-data operators and the SQL that some are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.llm.common import bucket_of_id, small_batches
from mergeloom.llm.exact_dedup import exact_dedup
from mergeloom.llm.filter_audit import filter_audit
from mergeloom.llm.grid_order import embedding_components
from mergeloom.llm.language import identify_language, labelled_rows, learn_languages
from mergeloom.llm.license_texts import TEMPLATES
from mergeloom.llm.licenses import PHRASES, license_scan
from mergeloom.llm.near_dedup import minhash_components
from mergeloom.llm.packing import best_fit_packing
from mergeloom.llm.periodic_runs import periodic_runs
from mergeloom.llm.piece_scan import decode_documents, encode_documents
from mergeloom.llm.pseudo_likelihood import learn_model, score_documents
from mergeloom.llm.repeated_passages import remove_repeated
from mergeloom.llm.token_counts import document_token_counts
from mergeloom.llm.toxicity import learn_toxicity, score_toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return document_token_counts(documents(spark, sf_dir), rank_file=public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), F.coalesce(bucket_of_id("doc_id", 4) == 2, F.lit(False))
    model = learn_languages(labelled_rows(docs, ~held_out))
    return identify_language(docs, model).withColumn("held_out", held_out)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(documents(spark, sf_dir), shingle_words=3, percent=85)


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), F.coalesce(bucket_of_id("doc_id", 5) == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    return score_toxicity(docs, learn_toxicity(docs, labels)).withColumn("held_out", held_out)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan(documents(spark, sf_dir)).drop("spans")
    return scanned.withColumn("score", F.round("score", 9))  # sums of logarithms differ in the last digits


def op8_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every text the number and CRC-32 of its ids, and length and CRC-32 of what they decode to."""
    import public_tokenizers

    file = public_tokenizers.path("piece_bpe_32k.model")
    rows = encode_documents(documents(spark, sf_dir), model_file=file)
    rows = rows.select("doc_id", F.size("ids").alias("n_tokens"), F.crc32(F.array_join("ids", ",").cast("binary")).alias("ids_crc32"), "ids")
    decoded = decode_documents(rows, model_file=file, keep=("doc_id", "n_tokens", "ids_crc32"))
    return decoded.select("doc_id", "n_tokens", "ids_crc32", F.length("decoded").alias("n_chars"), F.crc32(F.encode("decoded", "UTF-8")).alias("decoded_crc32"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(documents(spark, sf_dir), tokenizer_file=public_tokenizers.path("word_bpe_49k.json"))


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_documents(docs, *learn_model(docs))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    marks = labels.select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return filter_audit(documents(spark, sf_dir), marks, ["good", "toxic"])


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the texts, by the checksum of doc_id, become periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.expr("h div 10").alias("g"))
    words = rows.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    words = words.withColumn("a", F.expr("if(size(w) > 0, g % size(w), null)")).withColumn("p", F.expr("1 + (size(w) - a) div (3 + g % 8)"))
    text = F.expr("if(a is null, text, array_join(transform(w, (x, i) -> if(i >= a, w[cast(a + (i - a) % p as int)], x)), ' '))")
    return words.select("doc_id", text.alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(documents(spark, sf_dir)))
    top = F.expr("reduce(runs, get(runs, 0), (best, r) -> if(r.length * best.period > best.length * r.period, r, best))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    rows = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), top.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "top.*", F.expr("1000 * top.length div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated(documents(spark, sf_dir))
    removed = F.expr("reduce(spans, 0L, (n, s) -> n + s.length)")
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""


OP4_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM w
), n AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM s), e AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM s), links AS MATERIALIZED (
  SELECT a, b FROM (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS c FROM e l JOIN e r ON l.x = r.x AND l.doc_id <> r.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT reach.d, links.b FROM reach JOIN links ON links.a = reach.m),
c AS (SELECT d AS doc_id, min(m) AS component_id FROM reach GROUP BY d)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""


_TEMPLATES = ", ".join(f"({k}, '{t.label}', '{t.text}', '{t.key}')" for k, t in enumerate(TEMPLATES))
_PHRASES = ", ".join(f"('{label}', '{phrase}')" for phrase, label in PHRASES.items())
OP7_SQL = rf"""
WITH t AS (SELECT k, label, string_split(text, ' ') AS own, string_split(key, ' ') AS key FROM (VALUES {_TEMPLATES}) v(k, label, text, key)),
kp AS MATERIALIZED (SELECT *, list_filter(range(0, len(own)), lambda p: own[p + 1:p + len(key)] = key)[1] AS kat FROM t),
w AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), place AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM w),
df AS (SELECT word, count(DISTINCT doc_id) AS n FROM place GROUP BY word),
idf AS (SELECT word, ln(((SELECT count(*) FROM documents) + 1) / (coalesce(n, 0) + 1)::DOUBLE) + 1e-6 AS x FROM (SELECT DISTINCT unnest(own) AS word FROM kp) LEFT JOIN df USING (word)),
posted AS (
  SELECT k, p, word, x FROM (SELECT k, unnest(own) AS word, unnest(range(0, len(own))) AS p FROM kp) JOIN idf USING (word)
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY x DESC, p) <= 16
), posting AS MATERIALIZED (
  SELECT k, p, word, x / total AS x, CASE WHEN p BETWEEN kat AND kat + len(key) - 1 THEN 0 ELSE 2 + greatest(kat - p, p - kat - len(key) + 1) // 8 END AS off
  FROM posted JOIN (SELECT k, list_sum(list(x ORDER BY p)) AS total FROM posted GROUP BY k) USING (k) JOIN kp USING (k)
), span AS (
  SELECT doc_id, k, label, i - kat AS d FROM place JOIN kp ON word = key[1]
), found AS (
  SELECT doc_id, label, least(1, list_sum(list(CASE WHEN d + p + off >= 0 AND list_contains(w[greatest(0, d + p - off) + 1:d + p + off + 1], word) THEN x ELSE 0 END ORDER BY p))) AS score
  FROM (SELECT * FROM span JOIN kp USING (k, label) JOIN w USING (doc_id) WHERE w[d + kat + 1:d + kat + len(key)] = key) JOIN posting USING (k) GROUP BY doc_id, k, label, d HAVING score >= 0.6
), base AS (
  SELECT doc_id, label, i FROM place JOIN (SELECT label, string_split(phrase, ' ') AS ph FROM (VALUES {_PHRASES}) v(label, phrase)) ON word = ph[1] JOIN w USING (doc_id) WHERE w[i + 1:i + len(ph)] = ph
), b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM base GROUP BY doc_id),
f AS (SELECT doc_id, list(DISTINCT label) AS labels, max(score) AS score FROM found GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(labels, [])))), ',') AS labels,
       round(greatest(coalesce(score, 0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END)::DOUBLE, 9) AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN f USING (doc_id)
"""


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS n, vec_id AS m FROM embeddings UNION SELECT reach.n, links.b FROM reach JOIN links ON links.a = reach.m
), c AS (SELECT n AS vec_id, min(m) AS component_id FROM reach GROUP BY n), k AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)
"""


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text), f AS MATERIALIZED (
  SELECT part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(least < d.doc_id, false)] AS f,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) AS toxic
  FROM d JOIN firsts USING (text)
), one AS (SELECT unnest([1, 2, 3, 4, 5]) AS k), orders AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM one a, one b, one c, one d, one e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), steps AS MATERIALIZED (
  SELECT array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') AS filter_order, k AS step, o[k] AS own, o[:k - 1] AS earlier, o[k + 1:] AS later FROM orders, one
), x AS (
  SELECT part, filter_order, step, own, f[own] AS fails, len(list_filter(earlier, lambda g: f[g])) = 0 AS alive, len(list_filter(earlier || later, lambda g: f[g])) = 0 AS others, good, toxic FROM f, steps
), s AS (
  SELECT part, filter_order, step, own, count(*) FILTER (alive AND NOT fails) AS kept, count(*) FILTER (alive AND fails) AS removed, count(*) FILTER (NOT alive AND fails) AS redundant,
    count(*) FILTER (fails AND others) AS unique_fails, count(*) FILTER (alive AND fails AND good) AS good_lost, count(*) FILTER (alive AND fails AND toxic) AS toxic_lost
  FROM x GROUP BY ALL
)
SELECT * EXCLUDE own, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM s
"""


OP12_SQL = r"""
WITH table_ AS (
  SELECT list(c ORDER BY k) AS t FROM (
    SELECT k, list_reduce([k] || range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(0, 256)) AS k))
), raw AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM documents, table_
), spot AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN h // 10 % len(w) END AS a, h // 10 AS g FROM raw), plan AS (
  SELECT *, 1 + (len(w) - a) // (3 + g % 8) AS p FROM spot
), d AS MATERIALIZED (
  SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, len(w)), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) END AS w FROM plan
), word AS MATERIALIZED (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS i FROM d), five AS MATERIALIZED (
  SELECT doc_id, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS g FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), alike AS (
  SELECT a.doc_id, b.i - a.i AS q, a.i FROM five a JOIN five b ON a.doc_id = b.doc_id AND a.g = b.g AND a.i < b.i
), island AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM alike), stretch AS MATERIALIZED (
  SELECT doc_id, q, min(i) AS s, count(*) + 4 + q AS n FROM island GROUP BY doc_id, q, k HAVING count(*) + 4 + q >= greatest(6, 4 * q)
), run AS MATERIALIZED (
  SELECT * FROM stretch a WHERE NOT EXISTS (SELECT 1 FROM stretch b WHERE b.doc_id = a.doc_id AND b.q < a.q AND b.s <= a.s AND b.s + b.n >= a.s + a.n)
), gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM run), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
), best AS (
  SELECT * FROM run a WHERE NOT EXISTS (SELECT 1 FROM run b WHERE a.doc_id = b.doc_id AND (b.n * a.q > a.n * b.q OR b.n * a.q = a.n * b.q AND (b.s, b.q) < (a.s, a.q)))
), lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS text FROM run GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, n AS length, q AS period, 1000 * n // q AS exponent_milli, sha256(coalesce(l.text, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM d LEFT JOIN lines l USING (doc_id) LEFT JOIN kept k USING (doc_id) LEFT JOIN best USING (doc_id)
"""


OP13_SQL = """
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), part AS (
  SELECT r, 1000 * k AS base, substr(h, 2000 * k + 1, 2398) AS h FROM (SELECT r, h, unnest(range(0, (n + 999) // 1000)) AS k FROM d)
), spot AS (SELECT r, base, h, unnest(range(0, least(1000, len(h) // 2 - 199))) AS i FROM part), string AS MATERIALIZED (
  SELECT r, base + i AS i, md5_number(substr(h, 2 * i + 1, 400)) AS m FROM spot
), twice AS (SELECT m FROM string GROUP BY m HAVING count(*) > 1), starts AS (
  SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap FROM string SEMI JOIN twice USING (m)
), grouped AS (SELECT r, i, count(*) FILTER (gap IS NULL OR gap > 200) OVER (PARTITION BY r ORDER BY i) AS k FROM starts), span AS MATERIALIZED (
  SELECT r, min(i) AS s, max(i) + 200 AS e FROM grouped GROUP BY r, k
), edge AS (SELECT r, s, e FROM span UNION ALL SELECT r, n, n FROM d), piece AS (
  SELECT r, s, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s, e), 0) AS before FROM edge
), kept AS (SELECT r, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY before) AS h FROM piece JOIN d USING (r) GROUP BY r),
k AS (SELECT r, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans FROM span GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256 FROM d JOIN kept USING (r) LEFT JOIN k USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_language_id": op2_language_id,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_minhash_near_dedup": op4_minhash_near_dedup,
        "op5_embedding_near_dedup": op5_embedding_near_dedup,
        "op6_toxicity": op6_toxicity,
        "op7_license_scan": op7_license_scan,
        "op8_sentencepiece_scan": op8_sentencepiece_scan,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_pseudo_likelihood": op10_pseudo_likelihood,
        "op11_filter_audit": op11_filter_audit,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_suffix_dedup": op13_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": OP3_SQL,
        "op4_minhash_near_dedup": OP4_SQL,
        "op5_embedding_near_dedup": OP5_SQL,
        "op7_license_scan": OP7_SQL,
        "op11_filter_audit": OP11_SQL,
        "op12_periodic_runs": OP12_SQL,
        "op13_suffix_dedup": OP13_SQL,
    }
