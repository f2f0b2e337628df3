"""Queries over jobs and events: status, progress, checks, metrics, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import rules
from millrace.functions import text as tx
from millrace.plans import sqltext as q
from millrace.sources import table
from millrace.streaming import events as st

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


def jobs(spark, sf, *columns):
    return table(spark, sf, "research_jobs", "job_id", *columns)


def sources(spark, sf, *columns):
    return table(spark, sf, "source_documents", "source_document_id", "job_id", *columns)


def events(spark, sf, *columns):
    return table(spark, sf, "job_events", *(columns or ("job_event_id", "job_id", "event_type", "payload", "created_at", "ingested_at")))


EVENTS = "(SELECT DISTINCT * FROM job_events)"
_ATTEMPT = "try_cast(json_extract_string(CASE WHEN json_valid(payload) THEN payload END, '$.attempt') AS INT)"
_DURATION = "try_cast(json_extract_string(CASE WHEN json_valid(payload) THEN payload END, '$.durationMs') AS BIGINT)"


def parsed(spark, sf):
    """Events without repeated deliveries, their payload read; broken payloads give nulls."""
    body = F.from_json("payload", "attempt INT, durationMs BIGINT")
    valid = F.try_parse_json("payload").isNotNull()
    rows = events(spark, sf).distinct().withColumn("body", F.when(valid, body))
    return rows.select("job_event_id", "job_id", "event_type", "created_at", "ingested_at", F.col("body.attempt").alias("attempt"), F.col("body.durationMs").alias("duration_ms"), valid.alias("valid"))


@query("sc2_job_by_id", "SELECT job_id, status, total_sources FROM research_jobs WHERE job_id = 2")
def sc2(spark, sf):
    return jobs(spark, sf, "status", "total_sources").where("job_id = 2")


@query(
    "sc3_job_status",
    """WITH f AS (SELECT job_id, source_document_id, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, source_document_id) AS rn, count(*) OVER (PARTITION BY job_id) AS failed
                  FROM source_documents WHERE processing_status = 'FAILED')
       SELECT j.job_id, j.status, coalesce(max(f.failed), 0) AS failed, count(f.source_document_id) FILTER (WHERE rn <= 20) AS shown FROM research_jobs j LEFT JOIN f ON j.job_id = f.job_id GROUP BY j.job_id, j.status""",
)
def sc3(spark, sf):
    """Status of each job with its failures; of these the latest 20 are shown."""
    window = Window.partitionBy("job_id").orderBy(F.desc("created_at"), "source_document_id")
    failed = sources(spark, sf, "processing_status", "created_at").where("processing_status = 'FAILED'").withColumn("rn", F.row_number().over(window))
    counted = failed.groupBy("job_id").agg(F.count(F.lit(1)).alias("failed"), F.count_if(F.col("rn") <= 20).alias("shown"))
    return jobs(spark, sf, "status").join(counted, "job_id", "left").select("job_id", "status", F.coalesce("failed", F.lit(0)).alias("failed"), F.coalesce("shown", F.lit(0)).alias("shown"))


@query(
    "sc6_latest_events",
    f"SELECT job_id, job_event_id, event_type, rn FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, job_event_id) AS rn FROM {EVENTS}) WHERE rn <= 100",
)
def sc6(spark, sf):
    """The latest 100 events of each job, the default page."""
    window = Window.partitionBy("job_id").orderBy(F.desc("created_at"), "job_event_id")
    return events(spark, sf).distinct().withColumn("rn", F.row_number().over(window).cast("bigint")).where("rn <= 100").select("job_id", "job_event_id", "event_type", "rn")


@query("sk1_total_sources", "SELECT job_id, len(requested_sources)::INT AS requested, len(list_distinct(requested_sources))::INT AS different FROM research_jobs")
def sk1(spark, sf):
    return jobs(spark, sf, "requested_sources").select("job_id", F.size("requested_sources").alias("requested"), F.size(F.array_distinct("requested_sources")).alias("different"))


@query("sk13_source_messages", "SELECT job_id, source_document_id, 'fetch-' || source_document_id || '-' || CASE WHEN processing_status = 'FAILED' THEN 2 ELSE 1 END AS message_id FROM source_documents")
def sk13(spark, sf):
    """One message a source: its id is made of the source and its attempt, the second one for a source that failed."""
    attempt = F.when(F.col("processing_status") == "FAILED", 2).otherwise(1).cast("string")
    return sources(spark, sf, "processing_status").select("job_id", "source_document_id", F.concat(F.lit("fetch-"), F.col("source_document_id").cast("string"), F.lit("-"), attempt).alias("message_id"))


_PROGRESS = """SELECT j.job_id, count(d.source_document_id) AS total, count(*) FILTER (WHERE d.processing_status = 'SUCCEEDED') AS succeeded, count(*) FILTER (WHERE d.processing_status = 'FAILED') AS failed
    FROM research_jobs j LEFT JOIN source_documents d ON j.job_id = d.job_id GROUP BY j.job_id"""


@query(
    "ag8_progress",
    f"SELECT *, CASE WHEN NOT (total > 0 AND succeeded + failed = total) THEN 'RUNNING' WHEN succeeded = total THEN 'COMPLETED' WHEN failed = total THEN 'FAILED' ELSE 'PARTIAL' END AS status FROM ({_PROGRESS})",
)
def ag8(spark, sf):
    """Progress recomputed from the sources."""
    counted = sources(spark, sf, "processing_status").groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("processing_status") == "SUCCEEDED").alias("succeeded"), F.count_if(F.col("processing_status") == "FAILED").alias("failed")
    )
    rows = jobs(spark, sf).join(counted, "job_id", "left").na.fill(0, ["total", "succeeded", "failed"])
    return rows.withColumn("status", rules.progress_status(F.col("total"), F.col("succeeded"), F.col("failed")))


@query("fl34_progress_bounds", "SELECT job_id FROM research_jobs WHERE coalesce(successful_sources, 0) + coalesce(failed_sources, 0) > coalesce(total_sources, 0)")
def fl34(spark, sf):
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return jobs(spark, sf, "successful_sources", "failed_sources", "total_sources").where(zero("successful_sources") + zero("failed_sources") > zero("total_sources")).select("job_id")


@query(
    "fl26_table_checks",
    f"""SELECT job_id, rule FROM (SELECT job_id, unnest([CASE WHEN {q.trimmed("coalesce(query_text, '')")} = '' THEN 'blank_query' END, CASE WHEN total_sources < 0 OR successful_sources < 0 OR failed_sources < 0 THEN 'negative_count' END,
        CASE WHEN total_sources IS NULL OR successful_sources IS NULL OR failed_sources IS NULL THEN 'null_count' END, CASE WHEN completed_at < created_at THEN 'order' END,
        CASE WHEN total_sources <> len(requested_sources) THEN 'cardinality' END]) AS rule FROM research_jobs) WHERE rule IS NOT NULL""",
)
def fl26(spark, sf):
    """Constraint checks of the job table, as violations."""
    c = F.col
    counts = ("total_sources", "successful_sources", "failed_sources")
    any_of = lambda f: f(counts[0]) | f(counts[1]) | f(counts[2])
    checks = {
        "blank_query": tx.trimmed(F.coalesce("query_text", F.lit(""))) == "", "negative_count": any_of(lambda n: c(n) < 0), "null_count": any_of(lambda n: c(n).isNull()),
        "order": c("completed_at") < c("created_at"), "cardinality": c("total_sources") != F.size("requested_sources"),
    }
    rule = F.explode(F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in checks.items()])))
    return jobs(spark, sf, "query_text", *counts, "completed_at", "created_at", "requested_sources").select("job_id", rule.alias("rule"))


_UNITS = "length(query_text) + length(regexp_replace(query_text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))"


@query("fl17_job_input", f"SELECT job_id, coalesce({_UNITS} BETWEEN 1 AND 10000, false) AND len(requested_sources) BETWEEN 1 AND 100 AND len(list_distinct(requested_sources)) = len(requested_sources) AS valid FROM research_jobs")
def fl17(spark, sf):
    """Inputs within their bounds, lengths in UTF-16 units."""
    n = F.size("requested_sources")
    valid = F.coalesce(tx.utf16_length(F.col("query_text")).between(1, 10_000), F.lit(False)) & n.between(1, 100) & (F.size(F.array_distinct("requested_sources")) == n)
    return jobs(spark, sf, "query_text", "requested_sources").select("job_id", valid.alias("valid"))


@query("hs5_request_fingerprint", "SELECT job_id, sha256(to_json({'query': query_text, 'sources': requested_sources})) AS fingerprint, sha256(query_text) AS key_hash FROM research_jobs")
def hs5(spark, sf):
    """Fingerprint of a request over its canonical JSON, keys in a fixed order, and the hash of its key."""
    body = F.to_json(F.struct(F.col("query_text").alias("query"), F.col("requested_sources").alias("sources")), {"ignoreNullFields": "false"})
    return jobs(spark, sf, "query_text", "requested_sources").select("job_id", F.sha2(body, 256).alias("fingerprint"), F.sha2("query_text", 256).alias("key_hash"))


@query("jn7_retry_sources", "SELECT source_document_id, job_id FROM source_documents WHERE processing_status = 'FAILED' AND job_id IN (SELECT job_id FROM research_jobs WHERE status IN ('PARTIAL', 'FAILED'))")
def jn7(spark, sf):
    retried = jobs(spark, sf, "status").where(F.col("status").isin("PARTIAL", "FAILED")).select("job_id")
    return sources(spark, sf, "processing_status").where("processing_status = 'FAILED'").join(retried, "job_id", "left_semi").select("source_document_id", "job_id")


@query("sr9_elapsed", "SELECT job_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || ((s // 60) % 60) || 'm' END AS elapsed FROM (SELECT job_id, greatest(0, epoch_ms(completed_at) - epoch_ms(created_at)) // 1000 AS s FROM research_jobs WHERE completed_at IS NOT NULL)")
def sr9(spark, sf):
    ms = F.greatest(F.lit(0), F.unix_millis("completed_at") - F.unix_millis("created_at"))
    return jobs(spark, sf, "completed_at", "created_at").where("completed_at IS NOT NULL").select("job_id", rules.duration_text(ms).alias("elapsed"))


@query("js4_payload_checks", f"SELECT job_event_id, payload IS NOT NULL AND json_valid(payload) AS valid, {_ATTEMPT} AS attempt, {_DURATION} AS duration_ms FROM {EVENTS}")
def js4(spark, sf):
    return parsed(spark, sf).select("job_event_id", "valid", "attempt", "duration_ms")


@query("sc17_dead_letters", f"SELECT job_event_id, event_type FROM {EVENTS} WHERE payload IS NULL OR NOT json_valid(payload)")
def sc17(spark, sf):
    return parsed(spark, sf).where("NOT valid").select("job_event_id", "event_type")


@query("sm7_events_once", "SELECT DISTINCT job_event_id, job_id, event_type FROM job_events")
def sm7(spark, sf):
    return events(spark, sf, "job_event_id", "job_id", "event_type").distinct()


@query("fl32_stale_events", f"SELECT job_event_id, attempt < newest AS stale FROM (SELECT job_event_id, {_ATTEMPT} AS attempt, max({_ATTEMPT}) OVER (PARTITION BY job_id, event_type) AS newest FROM {EVENTS}) WHERE attempt IS NOT NULL")
def fl32(spark, sf):
    """Generation fence: events of an earlier attempt than the newest of their job and stage are stale."""
    rows = parsed(spark, sf).where("attempt IS NOT NULL")
    newest = rows.groupBy("job_id", "event_type").agg(F.max("attempt").alias("newest"))
    return rows.join(newest, ["job_id", "event_type"]).select("job_event_id", (F.col("attempt") < F.col("newest")).alias("stale"))


@query("sm5_failure_route", f"SELECT job_event_id, CASE WHEN attempt >= 3 THEN 'DEAD_LETTER' ELSE 'RETRY' END AS route, CASE WHEN attempt < 3 THEN 1000 * CAST(pow(2, attempt - 1) AS BIGINT) END AS delay_ms FROM (SELECT job_event_id, {_ATTEMPT} AS attempt FROM {EVENTS} WHERE event_type = 'SOURCE_FAILED') WHERE attempt IS NOT NULL")
def sm5(spark, sf):
    """Failures: again after a doubling delay, or to the dead letters at the third attempt."""
    rows = parsed(spark, sf).where("event_type = 'SOURCE_FAILED' AND attempt IS NOT NULL")
    last = F.col("attempt") >= 3
    delay = F.when(~last, F.lit(1000).cast("bigint") * F.pow(F.lit(2), F.col("attempt") - 1).cast("bigint"))
    return rows.select("job_event_id", F.when(last, "DEAD_LETTER").otherwise("RETRY").alias("route"), delay.alias("delay_ms"))


_TYPES = ("JOB_CREATED", "SOURCE_FETCHED", "SOURCE_EXTRACTED", "RECORDS_PROCESSED", "SOURCE_FAILED", "JOB_COMPLETED")


@query("ag18_event_depths", f"SELECT job_id, {', '.join(f'count(*) FILTER (WHERE event_type = {chr(39)}{t}{chr(39)}) AS {t.lower()}' for t in _TYPES)} FROM {EVENTS} GROUP BY job_id")
def ag18(spark, sf):
    return events(spark, sf).distinct().groupBy("job_id").agg(*[F.count_if(F.col("event_type") == t).alias(t.lower()) for t in _TYPES])


@query("ag19_counters", f"SELECT event_type, count(*) AS n, count({_DURATION}) AS timed, sum({_DURATION})::BIGINT AS total_ms, max({_DURATION}) AS longest_ms FROM {EVENTS} GROUP BY event_type")
def ag19(spark, sf):
    return parsed(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("duration_ms").alias("timed"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("longest_ms"))


_BOUNDS = (100, 500, 1_000, 2_500, 5_000, 10_000, 15_000, 20_000, 30_000, 60_000)


@query("ag20_duration_histogram", f"SELECT event_type, {', '.join(f'count(*) FILTER (WHERE d <= {b}) AS le_{b}' for b in _BOUNDS)}, count(d) AS le_inf FROM (SELECT event_type, {_DURATION} AS d FROM {EVENTS}) GROUP BY event_type")
def ag20(spark, sf):
    """Cumulative histogram of the durations by stage."""
    return parsed(spark, sf).groupBy("event_type").agg(*[F.count_if(F.col("duration_ms") <= b).alias(f"le_{b}") for b in _BOUNDS], F.count("duration_ms").alias("le_inf"))


@query("ag21_event_rate", f"SELECT event_type, time_bucket(INTERVAL 5 MINUTE, created_at) AS bucket, count(*) AS n, count(*) / 300.0 AS per_second FROM {EVENTS} WHERE created_at IS NOT NULL GROUP BY ALL")
def ag21(spark, sf):
    """Events per second in windows of five minutes."""
    rows = events(spark, sf).distinct().where("created_at IS NOT NULL").groupBy("event_type", F.window("created_at", "5 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("event_type", F.col("w.start").alias("bucket"), "n", (F.col("n") / 300.0).alias("per_second"))


@query("ag22_failures_by_domain", "SELECT domain, http_status, fetch_status, count(*) AS n FROM source_documents WHERE processing_status = 'FAILED' GROUP BY ALL")
def ag22(spark, sf):
    return sources(spark, sf, "domain", "http_status", "fetch_status", "processing_status").where("processing_status = 'FAILED'").groupBy("domain", "http_status", "fetch_status").agg(F.count(F.lit(1)).alias("n"))


@query("ag23_status_map", "SELECT CASE fetch_status WHEN 'SUCCEEDED' THEN 'SUCCEEDED' WHEN 'FAILED' THEN 'FAILED' WHEN 'BLOCKED' THEN 'FAILED' WHEN 'SKIPPED' THEN 'FAILED' ELSE 'PENDING' END AS mapped, count(*) AS n FROM source_documents GROUP BY ALL")
def ag23(spark, sf):
    mapped = F.when(F.col("fetch_status") == "SUCCEEDED", "SUCCEEDED").when(F.col("fetch_status").isin("FAILED", "BLOCKED", "SKIPPED"), "FAILED").otherwise("PENDING")
    return sources(spark, sf, "fetch_status").groupBy(mapped.alias("mapped")).agg(F.count(F.lit(1)).alias("n"))


@query("sm9_heartbeats", f"SELECT job_id, max(created_at) AS last_seen, max(created_at) >= (SELECT max(created_at) FROM job_events) - INTERVAL 30 DAY AS alive FROM {EVENTS} GROUP BY job_id")
def sm9(spark, sf):
    """Last sign of life of each job, alive within 30 days of the newest event."""
    rows = events(spark, sf, "job_id", "created_at")
    last = rows.groupBy("job_id").agg(F.max("created_at").alias("last_seen"))
    newest = rows.agg(F.max("created_at")).scalar()
    return last.select("job_id", "last_seen", (F.col("last_seen") >= newest - F.expr("INTERVAL 30 DAYS")).alias("alive"))


_LIMIT, _WINDOW_MS = 10, 60_000


@query("sm11_rate_limit", f"SELECT job_event_id, rn <= {_LIMIT} AS allowed FROM (SELECT job_event_id, row_number() OVER (PARTITION BY epoch_ms(created_at) // {_WINDOW_MS} ORDER BY created_at, job_event_id) AS rn FROM {EVENTS} WHERE event_type = 'JOB_CREATED' AND created_at IS NOT NULL)")
def sm11(spark, sf):
    """The first ten creations of each minute are allowed; a window is as short as its minute."""
    rows = events(spark, sf).distinct().where("event_type = 'JOB_CREATED' AND created_at IS NOT NULL").withColumn("w", F.floor(F.unix_millis("created_at") / _WINDOW_MS))
    window = Window.partitionBy("w").orderBy("created_at", "job_event_id")
    return rows.select("job_event_id", (F.row_number().over(window) <= _LIMIT).alias("allowed"))


@query("sm8_stream_once", "SELECT DISTINCT job_event_id, job_id, event_type FROM job_events WHERE created_at IS NOT NULL")
def sm8(spark, sf):
    """The events read as a stream, repeated deliveries dropped by key: the same rows as the batch form."""
    return st.replay(spark, sf, st.once, "events_once").select("job_event_id", "job_id", "event_type")


@query("sm1_stream_counts", f"SELECT job_id, event_type, count(*) AS n FROM {EVENTS} GROUP BY ALL")
def sm1(spark, sf):
    """Event counts per job and stage kept by a stream's micro-batches."""
    return st.replay(spark, sf, st.counts, "event_counts", mode="complete").select("job_id", "event_type", "n")
