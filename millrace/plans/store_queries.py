"""Queries over what is written: state changes, guarded writes, retries, progress, events, messages, constraint checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import rules
from millrace.functions import text as tx
from millrace.functions import url as ur
from millrace.plans import sqltext as q
from millrace.plans.job_queries import _DURATION, EVENTS, events, jobs, parsed, sources
from millrace.sources import table

QUERIES: dict = {}
SQL: dict = {}
#: Attempts of each queue, in the order of the pipeline.
ATTEMPTS = {"research-orchestration": 3, "source-fetch": 4, "content-extraction": 3, "record-processing": 3, "dead-letter": 1}
#: What a source still has to go through.
OPEN = ("PENDING", "FETCHING", "EXTRACTING")
DELAY_MS = 500


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


def listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def fetched(spark, sf, *columns):
    """One result of each source: the first that came."""
    rows = table(spark, sf, "extraction_results", "result_id", "source_document_id", *columns).where("source_document_id IS NOT NULL")
    best = F.min_by(F.struct("result_id", *columns), "result_id")
    return rows.groupBy("source_document_id").agg(best.alias("r")).select("source_document_id", *[F.col(f"r.{c}").alias(f"new_{c}") for c in ("result_id", *columns)])


_FETCHED = "(SELECT source_document_id, min(result_id) AS new_result_id, arg_min(text, result_id) AS new_text, arg_min(http_status, result_id) AS new_status FROM extraction_results WHERE source_document_id IS NOT NULL GROUP BY source_document_id)"


@query("sc5_source_by_id", "SELECT source_document_id, job_id, normalized_url, processing_status FROM source_documents WHERE source_document_id = 5")
def sc5(spark, sf):
    return sources(spark, sf, "normalized_url", "processing_status").where("source_document_id = 5")


@query("sk4_marked_fetching", "SELECT source_document_id, CASE WHEN source_document_id IN (SELECT source_document_id FROM extraction_results) THEN 'FETCHING' ELSE fetch_status END AS fetch_status FROM source_documents")
def sk4(spark, sf):
    """The sources that have a result under way are marked, whatever their state was."""
    marked = table(spark, sf, "extraction_results", "source_document_id").distinct().withColumn("marked", F.lit(True))
    return sources(spark, sf, "fetch_status").join(marked, "source_document_id", "left").select("source_document_id", F.when(F.col("marked"), "FETCHING").otherwise(F.col("fetch_status")).alias("fetch_status"))


@query(
    "sk5_success_write",
    f"""SELECT d.source_document_id, CASE WHEN f.new_result_id IS NOT NULL THEN 'SUCCEEDED' ELSE fetch_status END AS fetch_status, sha256(coalesce(f.new_text, d.raw_content)) AS content_hash
        FROM source_documents d LEFT JOIN {_FETCHED} f ON d.source_document_id = f.source_document_id""",
)
def sk5(spark, sf):
    """What a success writes: state, content and its hash; the other sources stay as they are."""
    rows = sources(spark, sf, "fetch_status", "raw_content").join(fetched(spark, sf, "text"), "source_document_id", "left")
    status = F.when(F.col("new_result_id").isNotNull(), "SUCCEEDED").otherwise(F.col("fetch_status"))
    return rows.select("source_document_id", status.alias("fetch_status"), F.sha2(F.coalesce("new_text", "raw_content"), 256).alias("content_hash"))


@query(
    "sk6_failure_write",
    """SELECT source_document_id, CASE WHEN bad THEN 'FAILED' ELSE fetch_status END AS fetch_status, NOT bad AND raw_content IS NOT NULL AS has_content, CASE WHEN NOT bad THEN content_hash END AS content_hash
       FROM (SELECT *, coalesce(http_status NOT BETWEEN 200 AND 299, false) AS bad FROM source_documents)""",
)
def sk6(spark, sf):
    """What a failure writes: content and hash are emptied."""
    bad = F.coalesce(~F.col("http_status").between(200, 299), F.lit(False))
    rows = sources(spark, sf, "fetch_status", F.col("raw_content").isNotNull().alias("has"), "content_hash", "http_status")
    return rows.select("source_document_id", F.when(bad, "FAILED").otherwise(F.col("fetch_status")).alias("fetch_status"), (~bad & F.col("has")).alias("has_content"), F.when(~bad, F.col("content_hash")).alias("content_hash"))


@query(
    "sk10_appended_events",
    f"SELECT job_id, event_type, count(*) AS n FROM (SELECT job_id, event_type FROM {EVENTS} UNION ALL SELECT job_id, 'SOURCE_FETCHED' FROM extraction_results r JOIN source_documents d ON r.source_document_id = d.source_document_id) GROUP BY ALL",
)
def sk10(spark, sf):
    """Stored events and one new event for each result, by job and type."""
    new = table(spark, sf, "extraction_results", "source_document_id").join(sources(spark, sf), "source_document_id").select("job_id", F.lit("SOURCE_FETCHED").alias("event_type"))
    return events(spark, sf).distinct().select("job_id", "event_type").unionByName(new).groupBy("job_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sk11_guarded_success",
    f"""SELECT f.source_document_id, f.new_result_id AS result_id, coalesce(d.processing_status = 'EXTRACTING' AND f.new_status BETWEEN 200 AND 299, false) AS written
        FROM {_FETCHED} f LEFT JOIN source_documents d ON f.source_document_id = d.source_document_id""",
)
def sk11(spark, sf):
    """A result is written where its source waits for it, and nowhere else."""
    rows = fetched(spark, sf, "http_status").join(sources(spark, sf, "processing_status"), "source_document_id", "left")
    written = F.coalesce((F.col("processing_status") == "EXTRACTING") & F.col("new_http_status").between(200, 299), F.lit(False))
    return rows.select("source_document_id", F.col("new_result_id").alias("result_id"), written.alias("written"))


def stage_id(prefix: str, source: str, attempt: str):
    return F.concat_ws("-", F.lit(prefix), F.col(source).cast("string"), F.col(attempt).cast("string"))


@query(
    "hs6_message_ids",
    """WITH s AS (SELECT source_document_id, job_id, CASE WHEN processing_status = 'FAILED' THEN 2 ELSE 1 END AS attempt FROM source_documents)
       SELECT source_document_id, 'fetch-' || source_document_id || '-' || attempt AS fetch_id, 'extract-' || source_document_id || '-' || attempt AS extract_id, 'process-' || source_document_id || '-' || attempt AS process_id,
              CASE WHEN attempt = 1 THEN 'orchestrate-' || job_id ELSE 'retry-' || job_id || '-' || source_document_id END AS job_message, 'dead-source-fetch-fetch-' || source_document_id || '-' || attempt AS dead_id FROM s""",
)
def hs6(spark, sf):
    """The deterministic ids of a source's messages: a failed source is on its second attempt, under a retry."""
    rows = sources(spark, sf, "processing_status").withColumn("attempt", F.when(F.col("processing_status") == "FAILED", 2).otherwise(1))
    job, source = F.col("job_id").cast("string"), F.col("source_document_id").cast("string")
    message = F.when(F.col("attempt") == 1, F.concat(F.lit("orchestrate-"), job)).otherwise(F.concat(F.lit("retry-"), job, F.lit("-"), source))
    ids = {name: stage_id(prefix, "source_document_id", "attempt").alias(name) for name, prefix in (("fetch_id", "fetch"), ("extract_id", "extract"), ("process_id", "process"), ("dead_id", "dead-source-fetch-fetch"))}
    return rows.select("source_document_id", message.alias("job_message"), *ids.values())


@query(
    "sk12_queue_messages",
    """SELECT 'orchestrate-' || job_id AS message_id, 'research-orchestration' AS queue, to_json({'researchJobId': job_id, 'sources': len(requested_sources)}) AS payload FROM research_jobs""",
)
def sk12(spark, sf):
    """One message a job on the first queue."""
    payload = F.to_json(F.struct(F.col("job_id").alias("researchJobId"), F.size("requested_sources").alias("sources")))
    return jobs(spark, sf, "requested_sources").select(F.concat(F.lit("orchestrate-"), F.col("job_id").cast("string")).alias("message_id"), F.lit("research-orchestration").alias("queue"), payload.alias("payload"))


_LAST_ATTEMPT = "try_cast(json_extract_string(CASE WHEN json_valid(payload) THEN payload END, '$.attempt') AS INT)"


@query(
    "sk14_dead_letters",
    f"""SELECT 'dead-source-fetch-' || job_event_id AS message_id, job_id, to_json({{'queueName': 'source-fetch', 'jobId': job_event_id, 'researchJobId': job_id, 'attemptsMade': attempt}}) AS payload
        FROM (SELECT job_event_id, job_id, {_LAST_ATTEMPT} AS attempt FROM {EVENTS} WHERE event_type = 'SOURCE_FAILED') WHERE attempt >= 3 AND job_id IS NOT NULL""",
)
def sk14(spark, sf):
    """Failures of the last attempt as messages of the dead-letter queue."""
    rows = parsed(spark, sf).where("event_type = 'SOURCE_FAILED' AND attempt >= 3 AND job_id IS NOT NULL")
    payload = F.to_json(F.struct(F.lit("source-fetch").alias("queueName"), F.col("job_event_id").alias("jobId"), F.col("job_id").alias("researchJobId"), F.col("attempt").alias("attemptsMade")))
    return rows.select(F.concat(F.lit("dead-source-fetch-"), F.col("job_event_id").cast("string")).alias("message_id"), "job_id", payload.alias("payload"))


@query(
    "fl1_work_selection",
    f"SELECT job_id, source_document_id, row_number() OVER (PARTITION BY job_id ORDER BY created_at, source_document_id) AS place FROM source_documents WHERE processing_status IN ({listed(OPEN)})",
)
def fl1(spark, sf):
    """The open sources of each job, the oldest first."""
    window = Window.partitionBy("job_id").orderBy("created_at", "source_document_id")
    return sources(spark, sf, "processing_status", "created_at").where(F.col("processing_status").isin(*OPEN)).select("job_id", "source_document_id", F.row_number().over(window).cast("bigint").alias("place"))


@query(
    "jn6_listed_sources",
    f"SELECT source_document_id, job_id FROM source_documents WHERE processing_status IN ({listed(OPEN)}) AND normalized_url IN (SELECT unnest(requested_sources) FROM research_jobs)",
)
def jn6(spark, sf):
    """The open sources that some job lists."""
    wanted = jobs(spark, sf, "requested_sources").select(F.explode("requested_sources").alias("normalized_url")).distinct()
    return sources(spark, sf, "processing_status", "normalized_url").where(F.col("processing_status").isin(*OPEN)).join(wanted, "normalized_url", "left_semi").select("source_document_id", "job_id")


_CHANGED = "source_document_id IN (SELECT source_document_id FROM extraction_results) AND processing_status = 'EXTRACTING'"


@query("fl2_guarded_transition", f"SELECT source_document_id, CASE WHEN {_CHANGED} THEN 'PROCESSING' ELSE processing_status END AS processing_status, coalesce({_CHANGED}, false) AS changed FROM source_documents")
def fl2(spark, sf):
    """Sources whose result has come go from extracting to processing; any other state stays."""
    come = table(spark, sf, "extraction_results", "source_document_id").distinct().withColumn("come", F.lit(True))
    changed = F.coalesce(F.col("come") & (F.col("processing_status") == "EXTRACTING"), F.lit(False))
    rows = sources(spark, sf, "processing_status").join(come, "source_document_id", "left")
    return rows.select("source_document_id", F.when(changed, "PROCESSING").otherwise(F.col("processing_status")).alias("processing_status"), changed.alias("changed"))


@query("jn12_transition_events", f"SELECT job_id, source_document_id, 'source.status_changed' AS event_type FROM source_documents WHERE {_CHANGED}")
def jn12(spark, sf):
    """An event, with its job looked up, for each source that changed and for no other."""
    return fl2(spark, sf).where("changed").join(sources(spark, sf), "source_document_id").select("job_id", "source_document_id", F.lit("source.status_changed").alias("event_type"))


@query(
    "sm2_stage_actions",
    """SELECT source_document_id, CASE processing_status WHEN 'PENDING' THEN 'FETCH' WHEN 'FETCHING' THEN 'FETCH' WHEN 'EXTRACTING' THEN 'ENQUEUE_EXTRACTION' ELSE 'NONE' END AS fetch_stage,
              CASE processing_status WHEN 'EXTRACTING' THEN 'EXTRACT' WHEN 'PROCESSING' THEN 'ENQUEUE_PROCESSING' ELSE 'NONE' END AS content_stage, CASE processing_status WHEN 'PROCESSING' THEN 'PROCESS' ELSE 'NONE' END AS record_stage
       FROM source_documents""",
)
def sm2(spark, sf):
    """What each stage does with a source that is delivered to it (again): its work, the next message, or nothing."""
    s = F.col("processing_status")
    return sources(spark, sf, "processing_status").select(
        "source_document_id", F.when(s.isin("PENDING", "FETCHING"), "FETCH").when(s == "EXTRACTING", "ENQUEUE_EXTRACTION").otherwise("NONE").alias("fetch_stage"),
        F.when(s == "EXTRACTING", "EXTRACT").when(s == "PROCESSING", "ENQUEUE_PROCESSING").otherwise("NONE").alias("content_stage"), F.when(s == "PROCESSING", "PROCESS").otherwise("NONE").alias("record_stage"),
    )


_COUNTS = "SELECT job_id, count(*) AS total, count(*) FILTER (WHERE processing_status = 'SUCCEEDED') AS succeeded, count(*) FILTER (WHERE processing_status = 'FAILED') AS failed, max(fetched_at) AS last_fetch FROM source_documents GROUP BY job_id"


def counted(spark, sf):
    done = lambda s: F.count_if(F.col("processing_status") == s)
    return sources(spark, sf, "processing_status", "fetched_at").groupBy("job_id").agg(F.count(F.lit(1)).alias("total"), done("SUCCEEDED").alias("succeeded"), done("FAILED").alias("failed"), F.max("fetched_at").alias("last_fetch"))


_STATUS = "CASE WHEN NOT (total > 0 AND succeeded + failed = total) THEN 'RUNNING' WHEN succeeded = total THEN 'COMPLETED' WHEN failed = total THEN 'FAILED' ELSE 'PARTIAL' END"


@query(
    "ag9_persisted_progress",
    f"""SELECT j.job_id, {_STATUS} AS status, coalesce(succeeded, 0) AS successful_sources, coalesce(failed, 0) AS failed_sources, CASE WHEN {_STATUS} <> 'RUNNING' THEN last_fetch END AS completed_at,
        CASE WHEN {_STATUS} <> 'RUNNING' THEN 'research_job.completed' ELSE 'research_job.progress_recalculated' END AS event_type
        FROM research_jobs j LEFT JOIN ({_COUNTS}) c ON j.job_id = c.job_id""",
)
def ag9(spark, sf):
    """Progress recomputed from the sources as the job rows store it; a job that has ended gets the time of its last fetch."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = jobs(spark, sf).join(counted(spark, sf), "job_id", "left")
    status = rules.progress_status(zero("total"), zero("succeeded"), zero("failed"))
    ended = status != "RUNNING"
    return rows.select(
        "job_id", status.alias("status"), zero("succeeded").alias("successful_sources"), zero("failed").alias("failed_sources"), F.when(ended, F.col("last_fetch")).alias("completed_at"),
        F.when(ended, "research_job.completed").otherwise("research_job.progress_recalculated").alias("event_type"),
    )


@query(
    "sm17_retried_sources",
    """SELECT source_document_id, CASE WHEN f THEN 'PENDING' ELSE fetch_status END AS fetch_status, CASE WHEN f THEN 'PENDING' ELSE processing_status END AS processing_status, CASE WHEN f THEN 2 ELSE 1 END AS attempt,
              CASE WHEN NOT f THEN http_status END AS http_status, CASE WHEN NOT f THEN content_hash END AS content_hash, CASE WHEN NOT f THEN fetched_at END AS fetched_at
       FROM (SELECT *, coalesce(processing_status = 'FAILED', false) AS f FROM source_documents)""",
)
def sm17(spark, sf):
    """A retry puts the failed sources back to their beginning, one attempt further; the others stay."""
    failed = F.coalesce(F.col("processing_status") == "FAILED", F.lit(False))
    keep = lambda c: F.when(~failed, F.col(c)).alias(c)
    rows = sources(spark, sf, "fetch_status", "processing_status", "http_status", "content_hash", "fetched_at")
    state = [F.when(failed, "PENDING").otherwise(F.col(c)).alias(c) for c in ("fetch_status", "processing_status")]
    return rows.select("source_document_id", *state, F.when(failed, 2).otherwise(1).alias("attempt"), keep("http_status"), keep("content_hash"), keep("fetched_at"))


@query(
    "sm17_retried_jobs",
    f"""SELECT j.job_id, CASE WHEN c.failed > 0 THEN 'QUEUED' ELSE j.status END AS status, greatest(0, coalesce(j.failed_sources, 0) - coalesce(c.failed, 0)) AS failed_sources,
        CASE WHEN coalesce(c.failed, 0) = 0 THEN j.completed_at END AS completed_at FROM research_jobs j LEFT JOIN ({_COUNTS}) c ON j.job_id = c.job_id""",
)
def sm17_jobs(spark, sf):
    """The jobs of retried sources are queued again, their failures taken back."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = jobs(spark, sf, "status", "failed_sources", "completed_at").join(counted(spark, sf).select("job_id", "failed"), "job_id", "left")
    again = zero("failed") > 0
    return rows.select("job_id", F.when(again, "QUEUED").otherwise(F.col("status")).alias("status"), F.greatest(F.lit(0), zero("failed_sources") - zero("failed")).cast("bigint").alias("failed_sources"), F.when(~again, F.col("completed_at")).alias("completed_at"))


@query(
    "sm18_kept_on_retry",
    "SELECT d.source_document_id, count(s.record_id) AS records FROM source_documents d LEFT JOIN signals s ON d.source_document_id = s.source_document_id AND d.job_id = s.job_id WHERE d.processing_status = 'FAILED' GROUP BY d.source_document_id",
)
def sm18(spark, sf):
    """Records that the retried sources keep: a reset does not delete them."""
    failed = sources(spark, sf, "processing_status").where("processing_status = 'FAILED'").select("source_document_id", "job_id")
    kept = table(spark, sf, "signals", "record_id", "source_document_id", "job_id")
    return failed.join(kept, ["source_document_id", "job_id"], "left").groupBy("source_document_id").agg(F.count("record_id").alias("records"))


@query(
    "sm16_completed_sources",
    f"""WITH done AS (SELECT source_document_id, job_id FROM source_documents WHERE {_CHANGED}), c AS ({_COUNTS}), n AS (SELECT job_id, count(*) AS n FROM done GROUP BY job_id)
        SELECT job_id, total, succeeded, failed, {_STATUS} AS status FROM (SELECT c.job_id, total, succeeded + coalesce(n.n, 0) AS succeeded, failed FROM c LEFT JOIN n ON c.job_id = n.job_id)""",
)
def sm16(spark, sf):
    """Progress of the jobs once the sources whose results have come are completed."""
    done = jn12(spark, sf).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    rows = counted(spark, sf).join(done, "job_id", "left").select("job_id", "total", (F.col("succeeded") + F.coalesce("n", F.lit(0))).alias("succeeded"), "failed")
    return rows.withColumn("status", rules.progress_status(F.col("total"), F.col("succeeded"), F.col("failed")))


@query(
    "rk3_latest_failures",
    "SELECT job_id, rn, source_document_id, http_status FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, source_document_id) AS rn FROM source_documents WHERE processing_status = 'FAILED') WHERE rn <= 20",
)
def rk3(spark, sf):
    """The latest 20 failures of each job, the feature of its status view."""
    window = Window.partitionBy("job_id").orderBy(F.desc("created_at"), "source_document_id")
    rows = sources(spark, sf, "processing_status", "http_status", "created_at").where("processing_status = 'FAILED'").withColumn("rn", F.row_number().over(window).cast("bigint"))
    return rows.where("rn <= 20").select("job_id", "rn", "source_document_id", "http_status")


@query(
    "pj2_status_rows",
    f"""SELECT j.job_id, to_json({{'totalSources': total_sources, 'successfulSources': successful_sources, 'failedSources': failed_sources}}) AS progress, coalesce(c.failed, 0) AS failures,
        strftime(completed_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%gZ') AS completed_at FROM research_jobs j LEFT JOIN ({_COUNTS}) c ON j.job_id = c.job_id""",
)
def pj2(spark, sf):
    """Status rows with nested progress and ISO times."""
    rows = jobs(spark, sf, "total_sources", "successful_sources", "failed_sources", "completed_at").join(counted(spark, sf).select("job_id", "failed"), "job_id", "left")
    progress = F.struct(F.col("total_sources").alias("totalSources"), F.col("successful_sources").alias("successfulSources"), F.col("failed_sources").alias("failedSources"))
    return rows.select("job_id", F.to_json(progress, {"ignoreNullFields": "false"}).alias("progress"), F.coalesce("failed", F.lit(0)).alias("failures"), tx.iso_time(F.col("completed_at")).alias("completed_at"))


@query(
    "sm14_fetch_starts",
    f"""SELECT source_document_id, make_timestamp(((max(a - (n - 1) * {DELAY_MS * 1000}) OVER (PARTITION BY domain ORDER BY n)) + (n - 1) * {DELAY_MS * 1000})::BIGINT) AS starts_at
        FROM (SELECT source_document_id, domain, epoch_us(created_at) AS a, row_number() OVER (PARTITION BY domain ORDER BY created_at, source_document_id) AS n FROM source_documents WHERE domain IS NOT NULL AND created_at IS NOT NULL)""",
)
def sm14(spark, sf):
    """When each source's fetch may start, half a second after the one before on its domain.

    The start is the greater of arrival and last start plus delay; with the delay taken off each
    place, that recurrence is a running maximum.
    """
    delay = DELAY_MS * 1000
    order = Window.partitionBy("domain").orderBy("created_at", "source_document_id")
    rows = sources(spark, sf, "domain", "created_at").where("domain IS NOT NULL AND created_at IS NOT NULL").withColumn("n", F.row_number().over(order).cast("bigint") - 1)
    slack = F.max(F.unix_micros("created_at") - F.col("n") * delay).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select("source_document_id", F.timestamp_micros(slack + F.col("n") * delay).alias("starts_at"))


_QUEUES = ", ".join(f"('{k}', {v})" for k, v in ATTEMPTS.items())


@query(
    "sm6_retry_schedule",
    f"SELECT q.queue, n AS attempt, 1000 * CAST(pow(2, n - 1) AS BIGINT) AS delay_ms, n = q.attempts AS last FROM (VALUES {_QUEUES}) AS q(queue, attempts), unnest(range(1, q.attempts + 1)) AS t(n)",
)
def sm6(spark, sf):
    """Attempts of each queue and the doubling delay after each."""
    rows = spark.createDataFrame(list(ATTEMPTS.items()), "queue string, attempts bigint").withColumn("attempt", F.explode(F.sequence(F.lit(1).cast("bigint"), "attempts")))
    return rows.select("queue", "attempt", (F.lit(1000).cast("bigint") * F.pow(F.lit(2), F.col("attempt") - 1).cast("bigint")).alias("delay_ms"), (F.col("attempt") == F.col("attempts")).alias("last"))


@query(
    "sm6_retained_events",
    f"""SELECT job_event_id, event_type FROM (SELECT job_event_id, event_type, created_at, row_number() OVER (PARTITION BY event_type ORDER BY created_at DESC, job_event_id) AS n, max(created_at) OVER () AS newest FROM {EVENTS} WHERE created_at IS NOT NULL)
        WHERE n <= CASE WHEN event_type = 'SOURCE_FAILED' THEN 20000 ELSE 10000 END AND created_at >= newest - CASE WHEN event_type = 'SOURCE_FAILED' THEN INTERVAL 7 DAY ELSE INTERVAL 1 DAY END""",
)
def sm6_retained(spark, sf):
    """Retention: completed messages a day and 10,000, failed ones a week and 20,000, counted from the newest event."""
    rows = events(spark, sf).distinct().where("created_at IS NOT NULL")
    newest = rows.agg(F.max("created_at")).scalar()
    failed = F.col("event_type") == "SOURCE_FAILED"
    young = F.col("created_at") >= F.when(failed, newest - F.expr("INTERVAL 7 DAYS")).otherwise(newest - F.expr("INTERVAL 1 DAY"))
    order = Window.partitionBy("event_type").orderBy(F.desc("created_at"), "job_event_id")
    # the young ones are the newest of their type, so ranking them alone ranks them among all
    kept = rows.where(young).withColumn("n", F.row_number().over(order))
    return kept.where(F.col("n") <= F.when(failed, 20_000).otherwise(10_000)).select("job_event_id", "event_type")


_JSON = "CASE WHEN json_valid(payload) THEN payload END"


@query(
    "fl26_more_checks",
    f"""SELECT 'source_documents' AS part, source_document_id AS id, 'content_hash' AS rule FROM source_documents WHERE content_hash IS NOT NULL AND NOT regexp_matches(content_hash, '^[a-f0-9]{{64}}$')
        UNION ALL SELECT 'source_documents', source_document_id, 'http_status' FROM source_documents WHERE http_status IS NOT NULL AND http_status NOT BETWEEN 100 AND 599
        UNION ALL SELECT 'signals', record_id, 'evidence' FROM signals WHERE evidence IS NULL OR {q.trimmed('evidence')} = ''
        UNION ALL SELECT 'signals', record_id, 'confidence_score' FROM signals WHERE NOT coalesce(confidence_score BETWEEN 0 AND 1, false)
        UNION ALL SELECT 'research_jobs', job_id, 'bounded' FROM research_jobs WHERE successful_sources + failed_sources > total_sources
        UNION ALL SELECT 'job_events', job_event_id, 'payload_object' FROM {EVENTS} WHERE coalesce(json_type({_JSON}), 'NULL') <> 'OBJECT'""",
)
def fl26_more(spark, sf):
    """The constraints of the other tables, as violations."""
    def broken(df, part: str, key: str, checks: dict):
        rule = F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()])))
        return df.select(F.lit(part).alias("part"), F.col(key).alias("id"), rule.alias("rule"))

    c = F.col
    documents = broken(sources(spark, sf, "content_hash", "http_status"), "source_documents", "source_document_id", {"content_hash": ~c("content_hash").rlike("^[a-f0-9]{64}$"), "http_status": ~c("http_status").between(100, 599)})
    records = broken(
        table(spark, sf, "signals", "record_id", "evidence", "confidence_score"), "signals", "record_id",
        {"evidence": tx.trimmed(F.coalesce("evidence", F.lit(""))) == "", "confidence_score": ~F.coalesce(c("confidence_score").between(0, 1), F.lit(False))},
    )
    bounded = broken(jobs(spark, sf, "total_sources", "successful_sources", "failed_sources"), "research_jobs", "job_id", {"bounded": c("successful_sources") + c("failed_sources") > c("total_sources")})
    kind = F.schema_of_variant(F.try_parse_json("payload"))
    payloads = broken(events(spark, sf).distinct(), "job_events", "job_event_id", {"payload_object": ~F.coalesce(kind.startswith("OBJECT"), F.lit(False))})
    return documents.unionByName(records).unionByName(bounded).unionByName(payloads)


@query("fl27_key_pairs", "SELECT job_id, (key IS NULL) = (fingerprint IS NULL) AS valid FROM (SELECT job_id, CASE WHEN completed_at IS NOT NULL THEN sha256(query_text) END AS key, sha256(query_text) AS fingerprint FROM research_jobs)")
def fl27(spark, sf):
    """Key and fingerprint are both there or both absent (the key: of the completed jobs)."""
    rows = jobs(spark, sf, "query_text", "completed_at").select("job_id", F.when(F.col("completed_at").isNotNull(), F.sha2("query_text", 256)).alias("key"), F.sha2("query_text", 256).alias("fingerprint"))
    return rows.select("job_id", (F.col("key").isNull() == F.col("fingerprint").isNull()).alias("valid"))


@query("sr10_percent", "SELECT job_id, CASE WHEN coalesce(total_sources, 0) = 0 THEN 0 ELSE CAST(floor((coalesce(successful_sources, 0) + coalesce(failed_sources, 0)) * 100.0 / total_sources + 0.5) AS BIGINT) END AS percent FROM research_jobs")
def sr10(spark, sf):
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = F.floor((zero("successful_sources") + zero("failed_sources")) * 100.0 / F.col("total_sources") + 0.5)
    return jobs(spark, sf, "total_sources", "successful_sources", "failed_sources").select("job_id", F.when(zero("total_sources") == 0, F.lit(0).cast("bigint")).otherwise(share).alias("percent"))


_QUEUE_BOUNDS = (10, 50, 100, 500, 1_000, 5_000, 15_000, 30_000, 60_000, 120_000, 300_000)
_API_BOUNDS = (5, 10, 25, 50, 100, 250, 500, 1_000, 2_500, 5_000)


@query(
    "ag20_queue_histogram",
    f"SELECT event_type, {', '.join(f'count(*) FILTER (WHERE d <= {b}) AS le_{b}' for b in _QUEUE_BOUNDS)}, count(d) AS le_inf, sum(d)::BIGINT AS total_ms FROM (SELECT event_type, {_DURATION} AS d FROM {EVENTS}) GROUP BY event_type",
)
def ag20_queue(spark, sf):
    """The queue's cumulative histogram of durations, with sum and count."""
    return parsed(spark, sf).groupBy("event_type").agg(*[F.count_if(F.col("duration_ms") <= b).alias(f"le_{b}") for b in _QUEUE_BOUNDS], F.count("duration_ms").alias("le_inf"), F.sum("duration_ms").alias("total_ms"))


@query(
    "ag20_fetch_histogram",
    f"SELECT fetch_mode, http_status, {', '.join(f'count(*) FILTER (WHERE fetch_duration_ms <= {b}) AS le_{b}' for b in _API_BOUNDS)}, count(fetch_duration_ms) AS le_inf, sum(fetch_duration_ms)::BIGINT AS total_ms FROM extraction_results GROUP BY ALL",
)
def ag20_fetch(spark, sf):
    """The requests' cumulative histogram by mode and status, with sum and count."""
    rows = table(spark, sf, "extraction_results", "fetch_mode", "http_status", "fetch_duration_ms")
    return rows.groupBy("fetch_mode", "http_status").agg(*[F.count_if(F.col("fetch_duration_ms") <= b).alias(f"le_{b}") for b in _API_BOUNDS], F.count("fetch_duration_ms").alias("le_inf"), F.sum("fetch_duration_ms").alias("total_ms"))


@query("ag21_hourly_increase", f"SELECT event_type, time_bucket(INTERVAL 1 HOUR, created_at) AS bucket, sum({_DURATION})::BIGINT AS increase, count(*) AS n FROM {EVENTS} WHERE created_at IS NOT NULL GROUP BY ALL")
def ag21_increase(spark, sf):
    """Increase of the busy time and the events in each hour."""
    rows = parsed(spark, sf).where("created_at IS NOT NULL").groupBy("event_type", F.window("created_at", "1 hour").alias("w")).agg(F.sum("duration_ms").alias("increase"), F.count(F.lit(1)).alias("n"))
    return rows.select("event_type", F.col("w.start").alias("bucket"), "increase", "n")


@query("ag21_depth_gauge", "SELECT processing_status, fetch_status, count(*) AS depth FROM source_documents GROUP BY ALL")
def ag21_gauge(spark, sf):
    """Sources by state, as a gauge's sum by two labels."""
    return sources(spark, sf, "processing_status", "fetch_status").groupBy("processing_status", "fetch_status").agg(F.count(F.lit(1)).alias("depth"))


@query("ag11_usage_sums", f"SELECT job_id, event_type, sum({_DURATION})::BIGINT AS total_ms, sum({_LAST_ATTEMPT})::BIGINT AS attempts FROM {EVENTS} GROUP BY ALL")
def ag11(spark, sf):
    """Usage sums that pass over what is absent, and are absent where everything is."""
    return parsed(spark, sf).groupBy("job_id", "event_type").agg(F.sum("duration_ms").alias("total_ms"), F.sum("attempt").alias("attempts"))


@query(
    "ag25_processed_payloads",
    f"""SELECT job_id, to_json({{'records': n, 'keys': k, 'sources': s}}) AS payload FROM (SELECT job_id, count(*) AS n, count(DISTINCT deduplication_key) AS k, count(DISTINCT source_document_id) AS s FROM signals WHERE job_id IS NOT NULL GROUP BY job_id)""",
)
def ag25(spark, sf):
    """The payload of each job's event on processed records."""
    once = table(spark, sf, "signals", "job_id", "deduplication_key", "source_document_id").where("job_id IS NOT NULL")
    rows = once.groupBy("job_id").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("deduplication_key").alias("keys"), F.count_distinct("source_document_id").alias("sources"))
    return rows.select("job_id", F.to_json(F.struct("records", "keys", "sources")).alias("payload"))


_RULES = (("/stellen", False), ("/careers/1", False), ("/careers", True), ("/openings/private", False))


def _path(x: str) -> str:
    return f"coalesce(nullif({q.part(q.trimmed(x), 5)}, ''), '/')"


@query(
    "sc10_robots_gate",
    f"""WITH r(prefix, allow) AS (VALUES {', '.join(f"('{p}', {str(a).lower()})" for p, a in _RULES)}), d AS (SELECT source_document_id, {_path('source_url')} AS path FROM source_documents WHERE source_url IS NOT NULL)
        SELECT d.source_document_id, coalesce(arg_max(r.allow, length(r.prefix)), true) AS allowed FROM d LEFT JOIN r ON starts_with(d.path, r.prefix) GROUP BY d.source_document_id""",
)
def sc10(spark, sf):
    """Whether a robots file with these rules allows each address: the longest matching rule decides, none allows."""
    path = F.coalesce(F.nullif(ur.part(tx.trimmed(F.col("source_url")), 5), F.lit("")), F.lit("/"))
    hits = F.array_compact(F.array(*[F.when(F.col("path").startswith(p), F.struct(F.lit(len(p)).alias("n"), F.lit(a).alias("allow"))) for p, a in _RULES]))
    rows = table(spark, sf, "source_documents", "source_document_id", "source_url").where("source_url IS NOT NULL").select("source_document_id", path.alias("path"))
    return rows.select("source_document_id", F.coalesce(F.array_max(hits)["allow"], F.lit(True)).alias("allowed"))


_STATES = "CASE WHEN processing_status IN ('PENDING', 'FETCHING') THEN 'waiting' WHEN processing_status IN ('EXTRACTING', 'PROCESSING') THEN 'active' WHEN processing_status = 'FAILED' THEN 'failed' ELSE 'done' END"


@query("ag18_queue_depths", f"SELECT 'source-fetch' AS queue, {_STATES} AS state, count(*) AS depth FROM source_documents GROUP BY ALL")
def ag18_depths(spark, sf):
    """Depth of the queue by the state of its messages."""
    s = F.col("processing_status")
    state = F.when(s.isin("PENDING", "FETCHING"), "waiting").when(s.isin("EXTRACTING", "PROCESSING"), "active").when(s == "FAILED", "failed").otherwise("done")
    return sources(spark, sf, "processing_status").groupBy(F.lit("source-fetch").alias("queue"), state.alias("state")).agg(F.count(F.lit(1)).alias("depth"))


_CODE = "CASE WHEN http_status IS NULL THEN 'none' WHEN http_status BETWEEN 200 AND 299 THEN 'none' WHEN http_status = 408 THEN 'REQUEST_TIMEOUT' WHEN http_status = 429 THEN 'RATE_LIMITED' WHEN http_status >= 500 THEN 'HTTP_SERVER_ERROR' WHEN http_status IN (401, 403) THEN 'ACCESS_RESTRICTED' ELSE 'HTTP_CLIENT_ERROR' END"


@query(
    "ag19_labelled_counters",
    f"""SELECT 'fetch' AS counter, fetch_status AS status, {_CODE} AS code, count(*) AS n FROM source_documents GROUP BY ALL
        UNION ALL SELECT 'jobs', status, 'none', count(*) FROM research_jobs GROUP BY ALL
        UNION ALL SELECT 'retries', 'retry', 'source-fetch', count(*) FROM {EVENTS} WHERE event_type = 'SOURCE_FAILED' AND {_LAST_ATTEMPT} < 3""",
)
def ag19_labelled(spark, sf):
    """The counters by their labels: fetches, jobs, retries."""
    code = F.coalesce(rules.http_outcome(F.col("http_status"))["code"], F.lit("none"))
    fetches = sources(spark, sf, "fetch_status", "http_status").groupBy(F.lit("fetch").alias("counter"), F.col("fetch_status").alias("status"), code.alias("code")).agg(F.count(F.lit(1)).alias("n"))
    finished = jobs(spark, sf, "status").groupBy(F.lit("jobs").alias("counter"), "status", F.lit("none").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    again = parsed(spark, sf).where("event_type = 'SOURCE_FAILED' AND attempt < 3").agg(F.count(F.lit(1)).alias("n"))
    return fetches.unionByName(finished).unionByName(again.select(F.lit("retries").alias("counter"), F.lit("retry").alias("status"), F.lit("source-fetch").alias("code"), "n"))


@query(
    "sk2_created_rows",
    """SELECT job_id, 'job' AS kind, query_text AS value FROM research_jobs UNION ALL SELECT job_id, 'source', u FROM (SELECT job_id, unnest(list_distinct(requested_sources)) AS u FROM research_jobs) UNION ALL SELECT job_id, 'event', 'research_job.created' FROM research_jobs""",
)
def sk2_rows(spark, sf):
    """What one request writes: the job, its sources, its event."""
    rows = jobs(spark, sf, "query_text", "requested_sources")
    own = rows.select("job_id", F.lit("job").alias("kind"), F.col("query_text").alias("value"))
    children = rows.select("job_id", F.lit("source").alias("kind"), F.explode(F.array_distinct("requested_sources")).alias("value"))
    return own.unionByName(children).unionByName(rows.select("job_id", F.lit("event").alias("kind"), F.lit("research_job.created").alias("value")))


@query(
    "fl33_reused_keys",
    """WITH f AS (SELECT job_id, lower(trim(query_text)) AS key, sha256(to_json({'query': query_text, 'sources': requested_sources})) AS fingerprint, created_at FROM research_jobs WHERE query_text IS NOT NULL),
       g AS (SELECT key, arg_min(fingerprint, (created_at, job_id)) AS kept, count(*) AS n FROM f GROUP BY key)
       SELECT job_id, n AS requests, fingerprint = kept AS same FROM f JOIN g USING (key)""",
)
def fl33(spark, sf):
    """Whether a request under a key that was used before is the request it was used for."""
    body = F.to_json(F.struct(F.col("query_text").alias("query"), F.col("requested_sources").alias("sources")))
    rows = jobs(spark, sf, "query_text", "requested_sources", "created_at").where("query_text IS NOT NULL").select("job_id", "created_at", F.lower(F.trim("query_text")).alias("key"), F.sha2(body, 256).alias("fingerprint"))
    kept = rows.groupBy("key").agg(F.min_by("fingerprint", F.struct("created_at", "job_id")).alias("kept"), F.count(F.lit(1)).alias("requests"))
    return rows.join(kept, "key").select("job_id", "requests", (F.col("fingerprint") == F.col("kept")).alias("same"))


@query("fl35_terminal_sources", "SELECT source_document_id, processing_status IN ('SUCCEEDED', 'FAILED') AS terminal FROM source_documents")
def fl35(spark, sf):
    return sources(spark, sf, "processing_status").select("source_document_id", F.col("processing_status").isin("SUCCEEDED", "FAILED").alias("terminal"))


_PERMANENT = "retryable = false OR attempt >= attempts"
_FAILURES = f"""SELECT e.job_event_id, {_LAST_ATTEMPT} AS attempt, e.event_type, CASE e.job_event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS retryable,
    CASE e.job_event_id % 4 WHEN 0 THEN 'source-fetch' WHEN 1 THEN 'content-extraction' WHEN 2 THEN 'record-processing' ELSE 'research-orchestration' END AS queue FROM {EVENTS} e WHERE e.event_type = 'SOURCE_FAILED'"""


@query(
    "sm5_failure_policy",
    f"""SELECT job_event_id, queue, coalesce({_PERMANENT}, false) AS permanent, CASE WHEN NOT coalesce({_PERMANENT}, false) THEN 1000 * CAST(pow(2, attempt - 1) AS BIGINT) END AS delay_ms
        FROM ({_FAILURES}) JOIN (VALUES {_QUEUES}) AS q(queue, attempts) USING (queue) WHERE attempt IS NOT NULL""",
)
def sm5_policy(spark, sf):
    """A failure is final where its error may not be retried or its queue's attempts are used up; the others wait twice as long each time."""
    number = F.col("job_event_id")
    queue = F.when(number % 4 == 0, "source-fetch").when(number % 4 == 1, "content-extraction").when(number % 4 == 2, "record-processing").otherwise("research-orchestration")
    retryable = F.when(number % 3 == 1, True).when(number % 3 == 2, False)
    attempts = spark.createDataFrame(list(ATTEMPTS.items()), "queue string, attempts bigint")
    rows = parsed(spark, sf).where("event_type = 'SOURCE_FAILED' AND attempt IS NOT NULL").select("job_event_id", "attempt", queue.alias("queue"), retryable.alias("retryable")).join(F.broadcast(attempts), "queue")
    final = F.coalesce((F.col("retryable") == F.lit(False)) | (F.col("attempt") >= F.col("attempts")), F.lit(False))
    return rows.select("job_event_id", "queue", final.alias("permanent"), F.when(~final, F.lit(1000).cast("bigint") * F.pow(F.lit(2), F.col("attempt") - 1).cast("bigint")).alias("delay_ms"))


@query(
    "sc17_checked_payloads",
    f"""SELECT job_event_id, event_type, CASE WHEN payload IS NULL OR NOT json_valid(payload) THEN 'NOT_JSON' WHEN json_type({_JSON}) <> 'OBJECT' THEN 'NOT_AN_OBJECT' WHEN {_LAST_ATTEMPT} IS NULL OR {_LAST_ATTEMPT} < 1 THEN 'NO_ATTEMPT'
        WHEN {_DURATION} IS NULL OR {_DURATION} < 0 THEN 'NO_DURATION' ELSE 'OK' END AS outcome FROM {EVENTS}""",
)
def sc17_checked(spark, sf):
    """Messages against the schema of their stage: what is no message goes to the dead letters with its reason."""
    kind = F.regexp_extract(F.schema_of_variant(F.try_parse_json("payload")), r"^(\w+)", 1)
    rows = events(spark, sf).distinct().withColumn("kind", kind).join(parsed(spark, sf).select("job_event_id", "attempt", "duration_ms").distinct(), "job_event_id")
    outcome = (
        F.when(F.col("kind").isNull(), "NOT_JSON").when(F.col("kind") != "OBJECT", "NOT_AN_OBJECT").when(F.coalesce("attempt", F.lit(0)) < 1, "NO_ATTEMPT")
        .when(F.coalesce("duration_ms", F.lit(-1)) < 0, "NO_DURATION").otherwise("OK")
    )
    return rows.select("job_event_id", "event_type", outcome.alias("outcome"))


@query(
    "sc13_gated_extraction",
    rf"""WITH r(prefix, allow) AS (VALUES {', '.join(f"('{p}', {str(a).lower()})" for p, a in _RULES)}),
        g AS (SELECT e.result_id, coalesce(arg_max(r.allow, length(r.prefix)), true) AS allowed FROM extraction_results e LEFT JOIN r ON starts_with({_path('final_url')}, r.prefix) GROUP BY e.result_id)
        SELECT e.result_id, CASE WHEN NOT {q.is_web(q.trimmed('final_url'))} THEN 'INVALID_URL' WHEN NOT g.allowed THEN 'ROBOTS' WHEN http_status IS NOT NULL AND http_status NOT BETWEEN 200 AND 299 THEN 'HTTP'
        WHEN regexp_matches(text, '(?i)\b(?:{'|'.join(tx.RESTRICTED_PHRASES)})\b') THEN 'ACCESS_RESTRICTED' WHEN length(regexp_replace(coalesce(text, ''), '{q.SP}', '', 'g')) < 200 THEN 'RENDER' ELSE 'OK' END AS outcome
        FROM extraction_results e JOIN g ON e.result_id = g.result_id""",
)
def sc13_gated(spark, sf):
    """The whole chain of a fetch: address, robots, status, restriction; a page that says too little is one to render."""
    path = F.coalesce(F.nullif(ur.part(tx.trimmed(F.col("final_url")), 5), F.lit("")), F.lit("/"))
    hits = F.array_compact(F.array(*[F.when(F.col("path").startswith(p), F.struct(F.lit(len(p)).alias("n"), F.lit(a).alias("allow"))) for p, a in _RULES]))
    allowed = F.coalesce(F.array_max(hits)["allow"], F.lit(True))
    rows = table(spark, sf, "extraction_results", "result_id", "final_url", "http_status", "text").withColumn("path", path)
    outcome = (
        F.when(~ur.is_web(tx.trimmed(F.col("final_url"))), "INVALID_URL").when(~allowed, "ROBOTS").when(F.col("http_status").isNotNull() & ~F.col("http_status").between(200, 299), "HTTP")
        .when(tx.restricted(F.col("text")), "ACCESS_RESTRICTED").when(~tx.meaningful(F.coalesce("text", F.lit(""))), "RENDER").otherwise("OK")
    )
    return rows.select("result_id", outcome.alias("outcome"))


@query(
    "jn11_united_evidence",
    """SELECT job_id, deduplication_key, source_document_id, source_url, max(published_at) AS published_at, max(credibility_score) AS credibility_score,
       array_to_string(list_sort(list_distinct(list(evidence) FILTER (WHERE evidence IS NOT NULL))), ' | ') AS evidence FROM signals WHERE job_id IS NOT NULL AND deduplication_key IS NOT NULL GROUP BY ALL""",
)
def jn11_united(spark, sf):
    """The attributions of each merged record, one a source and address: newest date, greatest credibility, all different quotes (a source gives up to 50)."""
    rows = table(spark, sf, "signals", "job_id", "deduplication_key", "source_document_id", "source_url", "published_at", "credibility_score", "evidence").where("job_id IS NOT NULL AND deduplication_key IS NOT NULL")
    return rows.groupBy("job_id", "deduplication_key", "source_document_id", "source_url").agg(
        F.max("published_at").alias("published_at"), F.max("credibility_score").alias("credibility_score"), F.array_join(F.array_sort(F.collect_set("evidence")), " | ").alias("evidence")
    )
