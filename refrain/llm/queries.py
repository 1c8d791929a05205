"""The queries of these operators, over whole tables, and their DuckDB twins where SQL can express them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fingerprint, language_id, language_model, line_dedup, minhash, packing, token_counts, toxicity, warc
from ._shared import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(token_counts.token_counts(table(spark, sf_dir, "documents")), F.col("n_tokens"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, similarity=0.85)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archive")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.index(spark, path)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    prototypes = language_id.profiles(docs.where(~held))
    return language_id.identify(docs.select("doc_id", "text"), prototypes).select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_packing, op2_token_counts, op3_minhash, op4_fingerprints, op5_line_dedup, op6_language_model, op7_decontamination, op8_toxicity, op9_warc, op10_language_id)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_lower = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_WORDS = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_base32 = " || ".join(f"to_base(('0x' || substr(h, {1 + 5 * i}, 5))::BIGINT, 32, 4)" for i in range(8))

ORACLES: dict[str, str] = {
    "op3_minhash": f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_lower}, '{_WORDS}') AS w FROM documents),
 s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
 n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
 links AS MATERIALIZED (SELECT u, v FROM pairs JOIN n na ON na.doc_id = u JOIN n nb ON nb.doc_id = v WHERE 100 * c >= 85 * (na.n + nb.n - c)),
 sym AS MATERIALIZED (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
 reach(u, v) AS (SELECT DISTINCT u, u FROM sym UNION SELECT r.u, e.v FROM reach r JOIN sym e ON e.u = r.v),
 comp AS (SELECT u, min(v) AS c FROM reach GROUP BY u)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.u = d.doc_id""",
    "op5_line_dedup": f"""WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
 l AS MATERIALIZED (SELECT *, len(regexp_extract_all(line, '{_WORDS}')) AS words, CAST(sum(CASE WHEN regexp_matches(line, '{_WORDS}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS idx FROM raw),
 q AS MATERIALIZED (SELECT doc_id, list(md5(line) ORDER BY idx) AS h, list(words ORDER BY idx) AS c FROM l WHERE words > 0 GROUP BY doc_id),
 st AS (SELECT doc_id, h, c, unnest(range(1, len(h) + 1)) AS a FROM q),
 win AS MATERIALIZED (SELECT doc_id, a, a + n - 1 AS b, md5(array_to_string(h[a:a + n - 1], '')) AS k, list_sum(c[a:a + n - 1]) AS words FROM (SELECT *, unnest(range(1, least(len(h) - a + 1, 50) + 1)) AS n FROM st)),
 first AS (SELECT k, min((doc_id, a)) AS f FROM win GROUP BY k),
 gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS idx FROM win JOIN first USING (k) WHERE words >= 50 AND (doc_id, a) > f),
 kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS t FROM l WHERE (doc_id, idx) NOT IN (SELECT (doc_id, idx) FROM gone) GROUP BY doc_id),
 g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
 SELECT doc_id, coalesce(len(q.h), 0) AS n_lines, coalesce(g.n, 0) AS n_deleted, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM documents LEFT JOIN q USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op7_decontamination": f"""WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_lower}, '{_ALNUM}') AS w FROM documents),
 b AS (SELECT item_id, regexp_extract_all({_lower}, '{_ALNUM}') AS w FROM benchmark WHERE item_id IS NOT NULL),
 bi AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
 bw AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM bi),
 di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw)),
 hit AS MATERIALIZED (SELECT doc_id, i, di.n, item_id FROM di JOIN bw ON bw.n = di.n AND bw.k = array_to_string(w[i:i + di.n - 1], ' ')),
 pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
 it AS (SELECT doc_id, count(*) AS n, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
 SELECT doc_id, len(w) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, coalesce(it.s, sha256('')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op9_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS o, sha1(coalesce(html, '')) AS h FROM pages)
 SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, translate({_base32}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest, CASE WHEN page_id <> o THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> o THEN o END AS refers_to FROM p""",
}
