"""The registered queries of the subpackage, and the SQL of those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import chunk_dedup, exact_topk, hard_negatives, language_model, lexical, license_scan, licenses, mixing, near_dedup, packing, quality, suffix_dedup, toxicity, warc
from .work import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), with_ids=False).drop("piece")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fitted(docs, quality.ratings(table(spark, sf_dir, "labels")), quality.GRADES)
    tails = [F.col("tails")[k - 1].alias(f"p_at_least_{k}") for k in range(1, quality.GRADES)]
    keep = (F.col("tails")[0] >= quality.KEEP_SHARE).alias("keep")
    return quality.graded(docs, model).select("doc_id", "expected_grade", *tails, keep)


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk.top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors, 5)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = vectors.withColumn("label", moved)
    return hard_negatives.hard_negatives(vectors.filter(F.col("vec_id") % 50 == 0), vectors)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fitted(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    score = F.col("toxicity")
    return toxicity.scored(docs.select("doc_id", "text"), model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), score.alias("score"),
        F.when(score >= toxicity.PREDICT_AT, 1).otherwise(0).alias("predicted"),
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_k(lexical.Index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), 10)


FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    body = f"lower(chr(10) || coalesce({text}, ''))"
    body = f"regexp_replace({body}, {_quoted(license_scan.COPYRIGHT_LINE)}, '', 'g')"
    body = f"regexp_replace({body}, {_quoted(license_scan.LIST_MARK)}, chr(10), 'g')"
    words = f"' ' || trim(regexp_replace({body}, {_quoted(license_scan.NOT_WORD)}, '  ', 'g')) || ' '"
    for spelling, stands in license_scan.EQUIVALENT.items():
        words = f"replace({words}, {_quoted(license_scan.spaced(spelling))}, {_quoted(license_scan.spaced(stands))})"
    return f"nullif(trim(replace({words}, '  ', ' ')), '')"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_mixing": op2_mixing,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_license_scan": op4_license_scan,
    "op5_quality": op5_quality,
    "op6_exact_topk": op6_exact_topk,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_warc": op8_warc,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_near_dedup": op10_near_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_toxicity": op12_toxicity,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES: dict[str, str] = {
    "op2_mixing": f"""
        WITH sizes AS (SELECT source, sum(length(coalesce(text, ''))) AS size FROM documents GROUP BY source),
        rates AS (
            SELECT source, sqrt(size) / sum(sqrt(size)) OVER () * sum(size) OVER () / size AS rate,
                   greatest(1, ceil(rate / {mixing.STEP}))::INT AS parts, rate / parts AS mean
            FROM sizes WHERE size > 0),
        chances AS (
            SELECT source, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
            FROM rates, generate_series(0, 200) g(k)),
        drawn AS (
            SELECT d.doc_id, d.source, part,
                   ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || part), 1, 12))::BIGINT / 16.0::DOUBLE ** 12 AS u
            FROM (SELECT DISTINCT doc_id, source FROM documents) d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source, generate_series(1, r.parts) p(part)),
        counts AS (
            SELECT doc_id, w.source, count(*) AS n FROM drawn w JOIN chances c ON w.source IS NOT DISTINCT FROM c.source
            WHERE cdf <= u GROUP BY ALL)
        SELECT d.*, copy::INT AS copy, md5('{mixing.SEED}+:' || coalesce(d.doc_id::VARCHAR, '') || ':' || copy) AS shuffle_key
        FROM documents d JOIN counts n ON d.doc_id IS NOT DISTINCT FROM n.doc_id AND d.source IS NOT DISTINCT FROM n.source, generate_series(1, n.n) c(copy)""",
    "op4_license_scan": f"""
        WITH known AS (
            SELECT sha256({_canonical_sql("t")}) AS digest, min(id) AS license_id
            FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in licenses.KNOWN.items())}) v(id, t) GROUP BY 1),
        own AS (SELECT doc_id, sha256({_canonical_sql("text")}) AS text_digest FROM documents)
        SELECT doc_id, text_digest, license_id FROM own LEFT JOIN known ON text_digest = digest""",
    "op6_exact_topk": """
        WITH parts AS (
            SELECT vec_id, generate_subscripts(embedding, 1) AS place, unnest(embedding)::DOUBLE AS x, len(embedding) AS width
            FROM embeddings),
        fine AS (
            SELECT vec_id FROM parts GROUP BY vec_id
            HAVING count(x) = max(width) AND bool_and(coalesce(isfinite(x), false))),
        q AS (SELECT p.vec_id, place, floor(256 * x)::BIGINT AS v, width FROM parts p JOIN fine USING (vec_id)),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id, sum(a.v * b.v)::BIGINT AS score
            FROM q a JOIN q b ON a.place = b.place AND a.width = b.width AND a.vec_id <> b.vec_id
            WHERE a.vec_id % 50 = 0 GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to
        FROM m""",
    "op9_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256({FOLDED}) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY {FOLDED})""",
    "op13_lexical_search": rf"""
        WITH words AS (
            SELECT doc_id, unnest(string_split_regex({FOLDED}, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        tfs AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term <> '' GROUP BY ALL),
        sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id),
        total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sizes),
        asked AS (
            SELECT DISTINCT item_id, unnest(string_split_regex({FOLDED}, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        weights AS (
            SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
            FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), total),
        found AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
            FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), total GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM found WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op11_hard_negatives": """
        WITH own AS (SELECT vec_id, embedding, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM embeddings),
        parts AS (
            SELECT vec_id, label, generate_subscripts(embedding, 1) AS place, unnest(embedding)::DOUBLE AS x, len(embedding) AS width
            FROM own WHERE label IS NOT NULL),
        fine AS (
            SELECT vec_id FROM parts GROUP BY vec_id
            HAVING count(x) = max(width) AND bool_and(coalesce(isfinite(x), false))),
        q AS (SELECT p.vec_id, label, place, floor(256 * x)::BIGINT AS v, width FROM parts p JOIN fine USING (vec_id)),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, sum(a.v * b.v)::BIGINT AS score
            FROM q a JOIN q b ON a.place = b.place AND a.width = b.width AND a.vec_id <> b.vec_id
            WHERE a.vec_id % 50 = 0 GROUP BY ALL),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (
            SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
                   row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
            FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
             AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
}
