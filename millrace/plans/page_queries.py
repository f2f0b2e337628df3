"""Queries over stored and fetched pages: readable text, checks, chunks, links, storage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import rules
from millrace.functions import text as tx
from millrace.functions import url as ur
from millrace.operators import pages as pg
from millrace.operators import stages as sg
from millrace.operators import vectors as vc
from millrace.plans import sqltext as q
from millrace.sources import spread, table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


def documents(spark, sf, *columns):
    return table(spark, sf, "source_documents", "source_document_id", *columns)


def results(spark, sf, *columns):
    return table(spark, sf, "extraction_results", "result_id", *columns)


@query("ag14_readable_text", f"SELECT source_document_id, sha256({q.readable('raw_content')}) AS digest, length({q.readable('raw_content')}) AS chars FROM source_documents WHERE raw_content IS NOT NULL")
def ag14(spark, sf):
    """Readable text of each page, as digest and length."""
    lines = tx.readable(F.col("raw_content"))
    return spread(documents(spark, sf, "raw_content").where("raw_content IS NOT NULL")).withColumn("t", lines).select("source_document_id", F.sha2("t", 256).alias("digest"), F.length("t").cast("bigint").alias("chars"))


@query("fl3_meaningful_content", f"SELECT source_document_id, length(regexp_replace(raw_content, '{q.SP}', '', 'g')) >= 200 AS meaningful FROM source_documents WHERE raw_content IS NOT NULL")
def fl3(spark, sf):
    return documents(spark, sf, "raw_content").where("raw_content IS NOT NULL").select("source_document_id", tx.meaningful(F.col("raw_content")).alias("meaningful"))


@query("fl4_restricted_pages", rf"SELECT result_id, regexp_matches(text, '(?i)\b(?:{'|'.join(tx.RESTRICTED_PHRASES)})\b') AS restricted FROM extraction_results")
def fl4(spark, sf):
    return results(spark, sf, "text").select("result_id", tx.restricted(F.col("text")).alias("restricted"))


@query("hs4_content_hash", "SELECT result_id, sha256(text) AS digest, content_hash = sha256(text) AS stored_agrees FROM extraction_results WHERE text IS NOT NULL")
def hs4(spark, sf):
    digest = F.sha2("text", 256)
    return results(spark, sf, "text", "content_hash").where("text IS NOT NULL").select("result_id", digest.alias("digest"), (F.col("content_hash") == digest).alias("stored_agrees"))


@query(
    "sc13_extraction_checks",
    rf"""SELECT result_id, CASE WHEN NOT {q.is_web(q.trimmed('final_url'))} THEN 'INVALID_URL' WHEN http_status IS NOT NULL AND http_status NOT BETWEEN 200 AND 299 THEN 'HTTP'
        WHEN regexp_matches(text, '(?i)\b(?:{'|'.join(tx.RESTRICTED_PHRASES)})\b') THEN 'ACCESS_RESTRICTED' WHEN length(regexp_replace(coalesce(text, ''), '{q.SP}', '', 'g')) < 200 THEN 'INSUFFICIENT' ELSE 'OK' END AS outcome
        FROM extraction_results""",
)
def sc13(spark, sf):
    """The chain of checks of a fetched page; the first that fails is its outcome."""
    outcome = (
        F.when(~ur.is_web(tx.trimmed(F.col("final_url"))), "INVALID_URL").when(F.col("http_status").isNotNull() & ~F.col("http_status").between(200, 299), "HTTP")
        .when(tx.restricted(F.col("text")), "ACCESS_RESTRICTED").when(~tx.meaningful(F.coalesce("text", F.lit(""))), "INSUFFICIENT").otherwise("OK")
    )
    return results(spark, sf, "final_url", "http_status", "text").select("result_id", outcome.alias("outcome"))


@query(
    "fl28_http_outcome",
    """SELECT source_document_id, CASE WHEN http_status = 408 THEN 'REQUEST_TIMEOUT' WHEN http_status = 429 THEN 'RATE_LIMITED' WHEN http_status >= 500 THEN 'HTTP_SERVER_ERROR'
       WHEN http_status IN (401, 403) THEN 'ACCESS_RESTRICTED' ELSE 'HTTP_CLIENT_ERROR' END AS code, http_status IN (408, 429) OR http_status >= 500 AS retryable, http_status IN (401, 403) AS blocked
       FROM source_documents WHERE http_status IS NOT NULL AND http_status NOT BETWEEN 200 AND 299""",
)
def fl28(spark, sf):
    out = documents(spark, sf, "http_status").withColumn("o", rules.http_outcome(F.col("http_status"))).where("o IS NOT NULL")
    return out.select("source_document_id", "o.code", "o.retryable", "o.blocked")


@query("sc11_robots_outcome", "SELECT http_status, CASE WHEN http_status BETWEEN 200 AND 299 THEN 'USE' WHEN http_status BETWEEN 400 AND 499 AND http_status NOT IN (408, 429) THEN 'ALLOW_ALL' ELSE 'RETRY' END AS outcome, count(*) AS n FROM source_documents WHERE http_status IS NOT NULL GROUP BY ALL")
def sc11(spark, sf):
    return documents(spark, sf, "http_status").where("http_status IS NOT NULL").groupBy("http_status", rules.robots_outcome(F.col("http_status")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


_TRIMMED = q.trimmed("source_url")
_HOST = q.host(_TRIMMED)
_V4 = rf"regexp_matches({_HOST}, '^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){{4}}$')"
_OCTET = [f"try_cast(split_part({_HOST}, '.', {n}) AS INT)" for n in (1, 2)]
_PRIVATE = (
    f"({_HOST} = 'localhost' OR {_HOST} LIKE '%.localhost' OR {_HOST} = '0.0.0.0' OR {_HOST} IN ({', '.join(f'{chr(39)}{h}{chr(39)}' for h in ur.METADATA_HOSTS)}) OR ({_V4} AND ({_OCTET[0]} IN (0, 10, 127) OR ({_OCTET[0]} = 169 AND {_OCTET[1]} = 254) "
    f"OR ({_OCTET[0]} = 172 AND {_OCTET[1]} BETWEEN 16 AND 31) OR ({_OCTET[0]} = 192 AND {_OCTET[1]} = 168) OR ({_OCTET[0]} = 100 AND {_OCTET[1]} BETWEEN 64 AND 127) OR {_OCTET[0]} >= 224)))"
)


@query("ur3_source_url_policy", f"SELECT source_document_id, CASE WHEN length(source_url) <= 2048 AND NOT coalesce({_PRIVATE}, false) THEN {q.canonical('source_url', drop_tracking=False)} END AS url FROM source_documents")
def ur3(spark, sf):
    """Canonical addresses that may be fetched: public hosts, of a bounded length; tracking parameters stay."""
    return documents(spark, sf, "source_url").select("source_document_id", ur.fetchable(F.col("source_url")).alias("url"))


@query(
    "ur4_public_url",
    f"""SELECT source_document_id, CASE WHEN NOT {q.is_web(_TRIMMED)} THEN 'INVALID_URL' WHEN length(source_url) > 2048 THEN 'TOO_LONG' WHEN coalesce({_PRIVATE}, false) THEN 'PRIVATE_HOST' ELSE 'OK' END AS outcome, {_HOST} AS host
        FROM (SELECT source_document_id, source_url FROM source_documents UNION ALL SELECT -source_document_id, 'http://127.0.0.' || source_document_id % 300 || '/x' FROM source_documents)""",
)
def ur4(spark, sf):
    """Why an address is refused or not; every source once more with a host of the machine itself (under the negative id)."""
    rows = documents(spark, sf, "source_url")
    own = rows.select((-F.col("source_document_id")).alias("source_document_id"), F.concat(F.lit("http://127.0.0."), (F.col("source_document_id") % 300).cast("string"), F.lit("/x")).alias("source_url"))
    address = tx.trimmed(F.col("source_url"))
    outcome = F.when(~ur.is_web(address), "INVALID_URL").when(F.length("source_url") > ur.LONGEST, "TOO_LONG").when(ur.private_host(ur.host(address)), "PRIVATE_HOST").otherwise("OK")
    return rows.unionByName(own).select("source_document_id", outcome.alias("outcome"), ur.host(address).alias("host"))


_ADDRESSES = "VALUES ('10.1.2.3'), ('8.8.8.8'), ('172.16.0.1'), ('172.32.0.1'), ('192.168.1.1'), ('169.254.169.254'), ('100.64.0.1'), ('224.0.0.1'), ('localhost'), ('a.localhost'), ('example.org'), ('::1'), ('fd00::1'), ('fe80::1'), ('2001:db8::1'), ('metadata.google.internal'), ('0.0.0.0'), ('256.1.1.1'), ('::ffff:10.0.0.1'), ('::FFFF:8.8.8.8')"


@query(
    "fl6_private_hosts",
    f"""WITH r AS (SELECT DISTINCT domain AS raw FROM source_documents UNION ALL SELECT * FROM ({_ADDRESSES}) AS v(raw)), h AS (SELECT raw, regexp_replace(lower(raw), '^::ffff:([0-9]+\\.)', '\\1') AS host FROM r),
        o AS (SELECT raw, host, regexp_matches(host, '^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\\.|$)){{4}}$') AS v4, try_cast(split_part(host, '.', 1) AS INT) AS a, try_cast(split_part(host, '.', 2) AS INT) AS b FROM h)
        SELECT raw AS host, coalesce(host = 'localhost' OR host LIKE '%.localhost' OR host = '0.0.0.0' OR host IN ('metadata.google.internal', 'metadata.aws.internal', 'instance-data.ec2.internal')
               OR (v4 AND (a IN (0, 10, 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127) OR a >= 224))
               OR (contains(host, ':') AND (host IN ('::', '::1') OR regexp_matches(host, '^(?:f[cd]|fe[89ab])'))), false) AS private FROM o""",
)
def fl6(spark, sf):
    hosts = documents(spark, sf, F.col("domain").alias("host")).select("host").distinct().unionByName(spark.sql(f"SELECT col1 AS host FROM {_ADDRESSES}"))
    return hosts.select("host", ur.private_host(F.col("host")).alias("private"))


@query(
    "rk9_outbound_links",
    f"""SELECT result_id, len(list_filter(outbound_links, lambda l: {q.is_web('l')}))::INT AS links, list_aggregate(list_filter(outbound_links, lambda l: {q.is_web('l')}), 'min') AS first_link FROM extraction_results""",
)
def rk9(spark, sf):
    """Valid links of each page: at most 100 different ones are kept, which is the feature."""
    links = F.filter(F.transform("outbound_links", lambda l: ur.absolute_link(l, F.col("final_url"))), lambda l: l.isNotNull())
    kept = F.slice(F.array_distinct(links), 1, pg.MOST_LINKS)
    return results(spark, sf, "outbound_links", "final_url").select("result_id", F.size(kept).alias("links"), F.array_min(kept).alias("first_link"))


@query("fs10_bounded_chunks")
def fs10(spark, sf):
    """Chunks for the model as the pipeline cuts them, with the length of each in UTF-16 units; null when there are too many."""
    limits = table(spark, sf, "chunking_configurations", "config_id", "max_chunk_characters", "max_chunks")
    inputs = table(spark, sf, "extraction_inputs", "input_id", "config_id", "source_text").join(limits, "config_id")
    chunked = inputs.select("input_id", pg.chunk_column(F.col("source_text"), F.col("max_chunk_characters"), F.col("max_chunks")).alias("chunks"))
    return chunked.select("input_id", F.size("chunks").alias("chunk_count"), F.posexplode_outer("chunks").alias("chunk_index", "chunk")).select("input_id", "chunk_count", "chunk_index", tx.utf16_length(F.col("chunk")).alias("chars"))


_RAW = "coalesce(raw_content, '')"


@query("fl36_empty_content", f"SELECT source_document_id, {q.trimmed(_RAW)} = '' AS empty FROM source_documents")
def fl36(spark, sf):
    return documents(spark, sf, "raw_content").select("source_document_id", (tx.trimmed(F.coalesce("raw_content", F.lit(""))) == "").alias("empty"))


@query("ht1_parsed_pages")
def ht1(spark, sf):
    """HTML round trip: each fetched page marked up with nested lists, links, metadata, hidden and dropped parts, parsed, and its readable text compared with the plain path."""
    text = lambda c: tx.attribute_escaped(c)
    line = F.expr(
        """array_join(transform(split(text, '\\n'), (l, i) -> concat(CASE i % 4 WHEN 0 THEN '<p>' WHEN 1 THEN '<ul><li>' WHEN 2 THEN '<blockquote>' ELSE '<table><tr><td>' END, replace(replace(replace(l, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
           CASE i % 4 WHEN 0 THEN '</p>' WHEN 1 THEN '</li></ul>' WHEN 2 THEN '</blockquote>' ELSE '</td></tr></table>' END)), '\\n')"""
    )
    head = F.concat(F.lit("<html lang='en'><head><meta property='og:title' content=\""), text(F.coalesce("title", F.lit(""))), F.lit("\"><title>other</title><meta name='author' content='A. Uthor'></head><body><nav><ul><li><a href='/menu'>menu</a></ul></nav>"))
    body = F.concat(F.lit("<main>"), line, F.lit("<a href='/next#top'></a><a href='/next'></a><a href='mailto:x@y'></a><div hidden><p>hidden <a href='/hidden'>x</a></p></div><aside><p>aside</p></aside></main>"))
    html = F.concat(head, body, F.lit("<div class='cookie-note'><p>cookies</p></div><footer><p>foot</p></footer><script>var p = '<p>no</p>'</script></body></html>"))
    source = spread(results(spark, sf, "title", "text", "final_url").where("text IS NOT NULL"))
    parsed = pg.parsed(source.withColumn("html", html), "result_id", "html", "final_url")
    return parsed.select("result_id", "title", F.sha2("text", 256).alias("digest"), F.size("links").alias("links"), F.col("metadata")["language"].alias("language"), F.col("metadata")["author"].alias("author"), "access_restricted")


SQL["ht1_parsed_pages"] = rf"""
    SELECT result_id, coalesce(nullif({q.squeezed("coalesce(title, '')")}, ''), 'other') AS title, sha256({q.readable('text')}) AS digest, 1 AS links, 'en' AS language, 'A. Uthor' AS author,
           regexp_matches(text, '(?i)\b(?:{'|'.join(tx.RESTRICTED_PHRASES)})\b') AS access_restricted FROM extraction_results WHERE text IS NOT NULL
"""


@query(
    "sk3_first_of_url",
    "SELECT job_id, normalized_url, source_document_id FROM source_documents WHERE normalized_url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_id, normalized_url ORDER BY created_at, source_document_id) = 1",
)
def sk3(spark, sf):
    """Create or get: the first stored document of each job and address stays."""
    first = F.min(F.struct("created_at", "source_document_id"))
    rows = documents(spark, sf, "job_id", "normalized_url", "created_at").where("normalized_url IS NOT NULL")
    return rows.groupBy("job_id", "normalized_url").agg(first.alias("f")).select("job_id", "normalized_url", "f.source_document_id")


@query("jn9_insert_if_absent", "SELECT result_id FROM extraction_results r WHERE final_url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM source_documents d WHERE d.normalized_url = r.final_url)")
def jn9(spark, sf):
    stored = documents(spark, sf, F.col("normalized_url").alias("final_url")).select("final_url")
    return results(spark, sf, "final_url").where("final_url IS NOT NULL").join(stored, "final_url", "left_anti").select("result_id")


@query(
    "jn8_parent_checks",
    """SELECT s.record_id, CASE WHEN j.job_id IS NULL THEN 'JOB_NOT_FOUND' WHEN d.source_document_id IS NULL THEN 'SOURCE_NOT_FOUND' WHEN d.job_id <> s.job_id THEN 'SOURCE_OF_OTHER_JOB' ELSE 'OK' END AS outcome
       FROM signals s LEFT JOIN research_jobs j ON s.job_id = j.job_id LEFT JOIN source_documents d ON s.source_document_id = d.source_document_id""",
)
def jn8(spark, sf):
    jobs = table(spark, sf, "research_jobs", "job_id", F.lit(True).alias("job_there"))
    sources = documents(spark, sf, F.col("job_id").alias("source_job"))
    outcome = F.when(F.col("job_there").isNull(), "JOB_NOT_FOUND").when(F.col("source_job").isNull(), "SOURCE_NOT_FOUND").when(F.col("source_job") != F.col("job_id"), "SOURCE_OF_OTHER_JOB").otherwise("OK")
    rows = table(spark, sf, "signals", "record_id", "job_id", "source_document_id")
    return rows.join(jobs, "job_id", "left").join(sources, "source_document_id", "left").select("record_id", outcome.alias("outcome"))


@query("jn10_cascade_delete", "SELECT record_id FROM signals WHERE job_id NOT IN (SELECT job_id FROM research_jobs WHERE status = 'FAILED')")
def jn10(spark, sf):
    gone = table(spark, sf, "research_jobs", "job_id", "status").where("status = 'FAILED'").select("job_id")
    return table(spark, sf, "signals", "record_id", "job_id").where("job_id IS NOT NULL").join(gone, "job_id", "left_anti").select("record_id")


@query(
    "jn5_similar_vectors",
    """SELECT a.vec_id AS query_id, b.vec_id AS vec_id, floor(list_cosine_similarity(a.embedding, b.embedding)::DOUBLE * 1e4 + 0.5) / 1e4 AS similarity
       FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.embedding, b.embedding)::DOUBLE >= 0.4""",
)
def jn5(spark, sf):
    """Vectors at least 0.4 alike: the queries are the ids divisible by 50, met block by block with all rows."""
    rows = table(spark, sf, "embeddings", F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").alias("vector"))
    near = vc.similar(rows, rows.where("id % 50 = 0"), 0.4)
    return near.select("query_id", F.col("id").alias("vec_id"), (F.floor(F.col("similarity") * 1e4 + 0.5) / 1e4).alias("similarity"))


@query("wn2_latest_per_domain", "SELECT domain, source_document_id, rn FROM (SELECT domain, source_document_id, row_number() OVER (PARTITION BY domain ORDER BY fetched_at DESC NULLS LAST, source_document_id) AS rn FROM source_documents) WHERE rn <= 3")
def wn2(spark, sf):
    window = Window.partitionBy("domain").orderBy(F.desc_nulls_last("fetched_at"), "source_document_id")
    return documents(spark, sf, "domain", "fetched_at").withColumn("rn", F.row_number().over(window).cast("bigint")).where("rn <= 3").select("domain", "source_document_id", "rn")


@query(
    "uf4_staged_pages",
    rf"""SELECT result_id, sha256({q.readable('text')}) AS digest FROM extraction_results
         WHERE text IS NOT NULL AND length(regexp_replace(text, '{q.SP}', '', 'g')) + length(regexp_replace(text, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')) >= 300 AND NOT regexp_matches(text, '(?i)\b(?:{'|'.join(tx.RESTRICTED_PHRASES)})\b')""",
)
def uf4(spark, sf):
    """The content stage as a plug-in, between a stage that picks columns and one that picks the result."""
    return sg.run(results(spark, sf, "text"), sg.reading("text", least=300), lambda df: df.select("result_id", "digest"))
