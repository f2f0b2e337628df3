"""Further queries: validation of inputs, projections, storage forms, text helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions import url as ur
from millrace.plans import sqltext as q
from millrace.sources import table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


@query("fl21_submitted_urls", f"SELECT source_document_id, {q.is_web(q.trimmed('source_url'))} AND length(source_url) <= 2048 AS valid FROM source_documents WHERE source_url IS NOT NULL")
def fl21(spark, sf):
    df = table(spark, sf, "source_documents", "source_document_id", "source_url").where("source_url IS NOT NULL")
    return df.select("source_document_id", (ur.is_web(tx.trimmed(F.col("source_url"))) & (F.length("source_url") <= ur.LONGEST)).alias("valid"))


@query("fl23_idempotency_keys", "SELECT record_id, coalesce(regexp_matches(deduplication_key, '^[\\x21-\\x7E]{1,255}$'), false) AS valid FROM signals")
def fl23(spark, sf):
    return table(spark, sf, "signals", "record_id", "deduplication_key").select("record_id", F.coalesce(F.col("deduplication_key").rlike(r"^[\x21-\x7E]{1,255}$"), F.lit(False)).alias("valid"))


@query("fl12_evidence_in_signal", "SELECT record_id, contains(signal_text, evidence) AS grounded, instr(signal_text, evidence) - 1 AS starts_at FROM signals WHERE evidence IS NOT NULL AND signal_text IS NOT NULL")
def fl12(spark, sf):
    """Whether the quote stands in the signal, and where (from 0; -1 where it does not)."""
    df = table(spark, sf, "signals", "record_id", "signal_text", "evidence").where("evidence IS NOT NULL AND signal_text IS NOT NULL")
    at = F.expr("instr(signal_text, evidence)")
    return df.select("record_id", F.contains("signal_text", "evidence").alias("grounded"), (at - 1).cast("bigint").alias("starts_at"))


@query("fl15_score_ranges", "SELECT record_id, coalesce(confidence_score BETWEEN 0 AND 1, false) AS confidence_ok, credibility_score IS NULL OR credibility_score BETWEEN 0 AND 1 AS credibility_ok FROM signals")
def fl15(spark, sf):
    c = F.col("credibility_score")
    return table(spark, sf, "signals", "record_id", "confidence_score", "credibility_score").select("record_id", F.coalesce(F.col("confidence_score").between(0, 1), F.lit(False)).alias("confidence_ok"), (c.isNull() | c.between(0, 1)).alias("credibility_ok"))


@query("fs9_first_non_empty", f"SELECT result_id, coalesce(nullif({q.squeezed('title')}, ''), nullif({q.squeezed(q.host('final_url'))}, '')) AS title FROM extraction_results")
def fs9(spark, sf):
    """The title, or the host where it is null or blank."""
    filled = lambda c: F.nullif(tx.squeezed(c), F.lit(""))
    return table(spark, sf, "extraction_results", "result_id", "title", "final_url").select("result_id", F.coalesce(filled(F.col("title")), filled(ur.host(F.col("final_url")))).alias("title"))


@query("fs12_attribute_escape", "SELECT result_id, replace(replace(replace(replace(title, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;') AS escaped, '<head><base href=\"' || replace(replace(replace(replace(final_url, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;') || '\"></head>' AS head FROM extraction_results WHERE title IS NOT NULL")
def fs12(spark, sf):
    """Text inside attributes, and a page's head with the address its links start from."""
    rows = table(spark, sf, "extraction_results", "result_id", "title", "final_url").where("title IS NOT NULL")
    return rows.select("result_id", tx.attribute_escaped(F.col("title")).alias("escaped"), tx.with_base(F.lit("<head></head>"), F.col("final_url")).alias("head"))


@query("fs16_listed_words", "SELECT job_id, array_to_string(list_filter(list_transform(regexp_split_to_array(query_text, '\\r?\\n|,'), lambda v: " + q.trimmed("v") + "), lambda v: v <> ''), '|') AS parts FROM research_jobs WHERE query_text IS NOT NULL")
def fs16(spark, sf):
    return table(spark, sf, "research_jobs", "job_id", "query_text").where("query_text IS NOT NULL").select("job_id", F.array_join(tx.listed(F.col("query_text")), "|").alias("parts"))


@query("sc9_body_cap", "SELECT result_id, octet_length(encode(text)) AS bytes, octet_length(encode(text)) > 2000000 AS too_large FROM extraction_results WHERE text IS NOT NULL")
def sc9(spark, sf):
    size = F.octet_length("text").cast("bigint")
    return table(spark, sf, "extraction_results", "result_id", "text").where("text IS NOT NULL").select("result_id", size.alias("bytes"), (size > 2_000_000).alias("too_large"))


@query("pj7_flat_evidence", "SELECT job_id, deduplication_key, array_to_string(list_sort(list_distinct(list(evidence))), ' | ') AS evidence, count(*) AS records FROM signals WHERE job_id IS NOT NULL AND deduplication_key IS NOT NULL AND evidence IS NOT NULL GROUP BY ALL")
def pj7(spark, sf):
    df = table(spark, sf, "signals", "job_id", "deduplication_key", "evidence").where("job_id IS NOT NULL AND deduplication_key IS NOT NULL AND evidence IS NOT NULL")
    return df.groupBy("job_id", "deduplication_key").agg(F.array_join(F.sort_array(F.collect_set("evidence")), " | ").alias("evidence"), F.count(F.lit(1)).alias("records"))


@query(
    "pj13_source_metadata",
    """SELECT record_id, CASE WHEN record_id % 3 <> 1 AND credibility_score BETWEEN 0 AND 1 THEN credibility_score END AS credibility, CASE WHEN record_id % 3 = 0 THEN strftime(published_at AT TIME ZONE 'UTC', '%Y-%m-%d') END AS published FROM signals""",
)
def pj13(spark, sf):
    """Date and credibility out of metadata in JSON: scores out of range and dates that are none are dropped (every third record has a broken score, another third a broken date)."""
    third = F.col("record_id") % 3
    date = F.when(third == 0, F.date_format("published_at", "yyyy-MM-dd")).otherwise("last spring")
    score = F.when(third == 1, F.lit(7.5)).otherwise(F.col("credibility_score"))
    metadata = F.to_json(F.struct(date.alias("publishedAt"), score.alias("credibilityScore")))
    v = F.try_parse_json(metadata)
    got = F.try_variant_get(v, "$.credibilityScore", "double")
    published = F.try_to_timestamp(F.try_variant_get(v, "$.publishedAt", "string"), F.lit("yyyy-MM-dd"))
    rows = table(spark, sf, "signals", "record_id", "credibility_score", "published_at")
    return rows.select("record_id", F.when(got.between(0, 1), got).alias("credibility"), F.date_format(published, "yyyy-MM-dd").alias("published"))


@query("js2_compact_metadata", "SELECT result_id, to_json(map_from_entries(list_filter([('mode', fetch_mode), ('status', http_status::VARCHAR), ('title', title)], lambda e: e[2] IS NOT NULL))) AS metadata FROM extraction_results")
def js2(spark, sf):
    """A metadata map without null entries."""
    entries = F.create_map(F.lit("mode"), F.col("fetch_mode"), F.lit("status"), F.col("http_status").cast("string"), F.lit("title"), F.col("title"))
    return table(spark, sf, "extraction_results", "result_id", "title", "fetch_mode", "http_status").select("result_id", F.to_json(F.map_filter(entries, lambda k, v: v.isNotNull())).alias("metadata"))


@query("rk8_truncated_values", "SELECT source_document_id, left(source_url || coalesce(title, ''), 100) AS error_code, md5(left(raw_content, 10000)) AS error_message FROM source_documents")
def rk8(spark, sf):
    """Values cut to the width of an error's code and message (100 and 10,000): the truncation is the feature."""
    code = F.left(F.concat("source_url", F.coalesce("title", F.lit(""))), F.lit(100))
    return table(spark, sf, "source_documents", "source_document_id", "source_url", "title", "raw_content").select("source_document_id", code.alias("error_code"), F.md5(F.left("raw_content", F.lit(10_000))).alias("error_message"))


@query("ag17_distinct_urls", f"SELECT job_id, count(DISTINCT {q.canonical('source_url')}) AS urls, count(*) AS rows FROM source_documents GROUP BY job_id")
def ag17(spark, sf):
    """Different canonical addresses of each job."""
    df = table(spark, sf, "source_documents", "job_id", "source_url").withColumn("u", ur.canonical(F.col("source_url")))
    counted = df.groupBy("job_id", "u").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("job_id").agg(F.count("u").alias("urls"), F.sum("n").alias("rows"))


@query("ag10_filtered_counts", "SELECT job_id, count(*) AS total, count(*) FILTER (WHERE fetch_status = 'FAILED') AS failed, count(*) FILTER (WHERE raw_content IS NOT NULL) AS with_content FROM source_documents GROUP BY job_id")
def ag10(spark, sf):
    df = table(spark, sf, "source_documents", "job_id", "fetch_status", F.col("raw_content").isNotNull().alias("has"))
    return df.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("fetch_status") == "FAILED").alias("failed"), F.count_if("has").alias("with_content"))


@query("ag15_longest_result", "SELECT source_document_id, arg_max(result_id, length(text) * 1000000000 - result_id) AS result_id FROM extraction_results WHERE text IS NOT NULL GROUP BY source_document_id")
def ag15(spark, sf):
    """The longest text of each page, the smaller id among equals."""
    df = table(spark, sf, "extraction_results", "result_id", "source_document_id", "text").where("text IS NOT NULL")
    return df.groupBy("source_document_id").agg(F.max(F.struct(F.length("text").alias("n"), (-F.col("result_id")).alias("r"))).alias("b")).select("source_document_id", (-F.col("b.r")).alias("result_id"))


@query(
    "sk2_idempotent_jobs",
    """WITH f AS (SELECT job_id, sha256(lower(trim(query_text))) AS key, sha256(array_to_string(requested_sources, chr(31))) AS fingerprint, created_at FROM research_jobs WHERE query_text IS NOT NULL)
       SELECT job_id, CASE WHEN rn = 1 THEN 'CREATED' WHEN fingerprint = first_fingerprint THEN 'REUSED' ELSE 'CONFLICT' END AS outcome
       FROM (SELECT *, row_number() OVER w AS rn, first_value(fingerprint) OVER w AS first_fingerprint FROM f WINDOW w AS (PARTITION BY key ORDER BY created_at, job_id))""",
)
def sk2(spark, sf):
    """Requests under one key: the first creates, an equal one reuses it, another one conflicts."""
    df = table(spark, sf, "research_jobs", "job_id", "query_text", "requested_sources", "created_at").where("query_text IS NOT NULL")
    keyed = df.select("job_id", "created_at", F.sha2(F.lower(F.trim("query_text")), 256).alias("key"), F.sha2(F.array_join("requested_sources", "\u001f"), 256).alias("fingerprint"))
    first = keyed.groupBy("key").agg(F.min(F.struct("created_at", "job_id", "fingerprint")).alias("f")).select("key", F.col("f.job_id").alias("first_job"), F.col("f.fingerprint").alias("first_fingerprint"))
    outcome = F.when(F.col("job_id") == F.col("first_job"), "CREATED").when(F.col("fingerprint") == F.col("first_fingerprint"), "REUSED").otherwise("CONFLICT")
    return keyed.join(first, "key").select("job_id", outcome.alias("outcome"))


# signs of two UTF-16 units are written as two signs of the private area, which the texts do not hold
SQL["fs10_bounded_chunks"] = r"""
    WITH RECURSIVE base AS (
        SELECT input_id, regexp_replace(source_text, '[\x{10000}-\x{10FFFF}]', chr(57344) || chr(57345), 'g') AS t, max_chunk_characters AS m, max_chunks AS n FROM extraction_inputs i JOIN chunking_configurations c ON i.config_id = c.config_id),
    steps AS (
        SELECT input_id, t, m, n, 0 AS "at", 0 AS k, NULL::VARCHAR AS chunk, FALSE AS over FROM base WHERE t IS NOT NULL AND regexp_matches(t, '\S')
        UNION ALL
        SELECT input_id, t, m, n, stop + length(regexp_extract(substr(t, stop + 1), '^[\r\n]*')), k + (piece <> '')::INT, nullif(piece, ''), k >= n FROM (
            SELECT *, regexp_replace(substr(t, "at" + 1, stop - "at"), '^[\s\x{00A0}\x{FEFF}\x{2028}\x{2029}\x{3000}\x{2000}-\x{200A}\x1c-\x1f\x{85}]+|[\s\x{00A0}\x{FEFF}\x{2028}\x{2029}\x{3000}\x{2000}-\x{200A}\x1c-\x1f\x{85}]+$', '', 'g') AS piece FROM (
                SELECT *, CASE WHEN hard < length(t) AND line > "at" + m // 2 THEN line ELSE hard END AS stop FROM (
                    SELECT *, hard - instr(reverse(substr(t, "at" + 1, hard - "at" + 1)), chr(10)) + 1 + CASE WHEN instr(reverse(substr(t, "at" + 1, hard - "at" + 1)), chr(10)) = 0 THEN -1000000000 ELSE 0 END AS line FROM (
                        SELECT *, least(length(t), "at" + m) - CASE WHEN substr(t, least(length(t), "at" + m) + 1, 1) = chr(57345) THEN 1 ELSE 0 END AS hard FROM steps WHERE "at" < length(t) AND NOT over))))),
    ended AS (SELECT input_id, bool_or(over) AS over, count(chunk) AS chunks FROM steps GROUP BY input_id)
    SELECT b.input_id, CASE WHEN b.t IS NULL OR e.over THEN NULL ELSE coalesce(e.chunks, 0)::INT END AS chunk_count, (s.k - 1)::INT AS chunk_index, length(s.chunk)::INT AS chars
    FROM base b LEFT JOIN ended e ON b.input_id = e.input_id LEFT JOIN steps s ON b.input_id = s.input_id AND s.chunk IS NOT NULL AND NOT e.over
"""
