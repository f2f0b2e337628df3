"""Queries over the model stage and over JSON: prompts, completions and their validation, contracts, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions import url as ur
from millrace.operators import model as md
from millrace.plans import sqltext as q
from millrace.plans.job_queries import EVENTS, events
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


SIGNALS = ("record_id", "job_id", "source_document_id", "company", "website", "role", "location", "signal_text", "source_url", "evidence", "confidence_score")

#: The scripted completions: what a model would have answered for each signal's page, broken in turn in the ways a model breaks it.
_CONTENT = """CASE record_id % 7 WHEN 0 THEN left(j, 40) WHEN 1 THEN replace(j, '"confidenceScore":', '"confidence":') WHEN 2 THEN replace(j, '"records"', '"items"') WHEN 3 THEN '[]' ELSE j END"""


def answered(spark, sf):
    """(id, source_url, chunk, content): one completion for each signal; the chunk is the signal's own text."""
    rows = table(spark, sf, "signals", *SIGNALS).where("signal_text IS NOT NULL AND company IS NOT NULL AND source_url IS NOT NULL")
    record = F.struct("company", "website", "role", "location", F.col("signal_text").alias("signal"), F.col("source_url").alias("sourceUrl"), "evidence", F.col("confidence_score").alias("confidenceScore"))
    body = F.to_json(F.struct(F.array(record).alias("records")), {"ignoreNullFields": "false"})
    return rows.withColumn("j", body).select(F.col("record_id").alias("id"), "source_url", F.col("signal_text").alias("chunk"), F.expr(_CONTENT).alias("content"))


_LOW = "lower(signal_text)"
_GROUND = ", ".join(
    f"CASE WHEN {c} IS NOT NULL AND NOT contains({_LOW}, lower({c})) THEN 'records.0.{c} must occur in the source chunk' END" for c in ("company", "role", "location")
)
_SHAPE = ", ".join(
    [
        f"CASE WHEN {c} IS NULL THEN {missing} WHEN {q.trimmed(c)} = '' OR length({q.trimmed(c)}) > {md.TEXTS[name]} THEN 'records.0.{name}: Invalid length' END"
        for name, c, missing in (("company", "company", "'records.0.company: Invalid type'"), ("website", "website", "NULL"))
    ]
    + [f"CASE WHEN website IS NOT NULL AND NOT {q.is_web('website')} THEN 'records.0.website: Invalid url' END"]
    + [
        f"CASE WHEN {c} IS NULL THEN {missing} WHEN {q.trimmed(c)} = '' OR length({q.trimmed(c)}) > {md.TEXTS[name]} THEN 'records.0.{name}: Invalid length' END"
        for name, c, missing in (("role", "role", "NULL"), ("location", "location", "NULL"), ("signal", "signal_text", "'records.0.signal: Invalid type'"), ("sourceUrl", "source_url", "'records.0.sourceUrl: Invalid type'"))
    ]
    + [f"CASE WHEN NOT {q.is_web('source_url')} THEN 'records.0.sourceUrl: Invalid url' END"]
    + [f"CASE WHEN evidence IS NULL THEN 'records.0.evidence: Invalid type' WHEN {q.trimmed('evidence')} = '' OR length({q.trimmed('evidence')}) > 1000 THEN 'records.0.evidence: Invalid length' END"]
)
_SCORE = "CASE WHEN record_id % 7 = 1 THEN 'records.0.confidenceScore: Required' WHEN confidence_score IS NULL THEN 'records.0.confidenceScore: Invalid type' WHEN confidence_score NOT BETWEEN 0 AND 1 THEN 'records.0.confidenceScore: Out of range' END"
_COMPLETIONS = f"""
    SELECT record_id AS id, CASE record_id % 7 WHEN 0 THEN ['Response is not valid JSON'] WHEN 2 THEN ['records: Required'] WHEN 3 THEN ['/: Expected object'] ELSE
        CASE WHEN len(shape) > 0 THEN shape ELSE list_filter([CASE WHEN NOT coalesce(contains(signal_text, evidence), true) THEN 'records.0.evidence must occur verbatim in the source chunk' END, {_GROUND},
             CASE WHEN website IS NOT NULL AND NOT contains({_LOW}, lower(website)) AND NOT contains({_LOW}, coalesce(nullif({q.host('website')}, ''), lower(website))) THEN 'records.0.website must occur in the source chunk or be null' END], lambda x: x IS NOT NULL) END END AS issues
    FROM (SELECT *, list_filter([{_SHAPE}, {_SCORE}, CASE WHEN record_id % 7 = 1 THEN 'records.0.Unrecognized keys' END], lambda x: x IS NOT NULL) AS shape FROM signals WHERE signal_text IS NOT NULL AND company IS NOT NULL AND source_url IS NOT NULL)
"""


@query("fl10_validated_completions", f"SELECT id, len(issues) = 0 AS success, array_to_string(issues, '; ') AS issues FROM ({_COMPLETIONS})")
def fl10(spark, sf):
    """Whole completions checked: JSON, schema, address, quotes and mentions; all records or none."""
    return md.validated(answered(spark, sf)).select("id", "success", F.array_join("issues", "; ").alias("issues"))


@query("js6_issue_counts", f"SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM ({_COMPLETIONS})) GROUP BY issue")
def js6(spark, sf):
    """Issues as "path: message", and how often each comes."""
    return md.validated(answered(spark, sf)).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@query("pj9_accepted_records", f"SELECT id, company, role, round(confidence_score, 6) AS confidence FROM ({_COMPLETIONS}) c JOIN signals s ON c.id = s.record_id WHERE len(issues) = 0")
def pj9(spark, sf):
    """The records of the accepted completions as typed rows."""
    rows = md.validated(answered(spark, sf)).where("success").select("id", F.explode("records").alias("r"))
    return rows.select("id", "r.company", "r.role", F.round("r.confidenceScore", 6).alias("confidence"))


@query(
    "js3_completion_envelopes",
    "SELECT record_id AS id, CASE WHEN record_id % 5 <> 0 THEN company END AS content, CASE WHEN record_id % 5 NOT IN (0, 1) THEN length(company) END AS input_tokens, CASE WHEN record_id % 5 NOT IN (0, 1) THEN length(coalesce(evidence, '')) END AS output_tokens FROM signals WHERE company IS NOT NULL",
)
def js3(spark, sf):
    """Content and usage out of response envelopes: some without a choice, some without usage."""
    rows = table(spark, sf, "signals", "record_id", "company", "evidence").where("company IS NOT NULL")
    usage = F.struct(F.length("company").alias("prompt_tokens"), F.length(F.coalesce("evidence", F.lit(""))).alias("completion_tokens"))
    choices = F.when(F.col("record_id") % 5 == 0, F.array().cast("array<struct<message:struct<content:string>>>")).otherwise(F.array(F.struct(F.struct(F.col("company").alias("content")).alias("message"))))
    response = F.to_json(F.struct(F.lit("stub").alias("model"), choices.alias("choices"), F.when(~(F.col("record_id") % 5).isin(0, 1), usage).alias("usage")))
    got = md.envelope(F.col("response"))
    return rows.withColumn("response", response).select(F.col("record_id").alias("id"), got["content"].alias("content"), got["input_tokens"].alias("input_tokens"), got["output_tokens"].alias("output_tokens"))


class Echo:
    """A provider for the queries: answers with the length of what it was asked."""

    def complete(self, messages: str) -> str:
        return f'{{"choices":[{{"message":{{"content":"{len(messages.encode("utf-16-le", "surrogatepass")) // 2}"}}}}]}}'


@query("sc14_model_stage", "SELECT record_id AS id, length(company)::VARCHAR AS content FROM signals WHERE company IS NOT NULL")
def sc14(spark, sf):
    """The model stage over a stub provider: asked once a row, its envelope parsed."""
    prompts = table(spark, sf, "signals", F.col("record_id").alias("id"), F.col("company").alias("messages")).where("messages IS NOT NULL")
    return md.completions(prompts, Echo).select("id", md.envelope(F.col("response"))["content"].alias("content"))


@query(
    "fs15_prompts",
    """SELECT input_id, sha256(to_json({'task': 'Extract supported hiring signals relevant to the research query.', 'researchQuery': query_text, 'sourceUrl': source_url,
              'sourceChunk': {'index': chunk_index, 'count': chunk_count, 'untrustedWebpageText': source_text}})) AS digest FROM extraction_inputs""",
)
def fs15(spark, sf):
    """The user message of every input, as a digest."""
    rows = table(spark, sf, "extraction_inputs", "input_id", "query_text", "source_url", "source_text", "chunk_index", "chunk_count")
    c = F.col
    return rows.select("input_id", F.sha2(md.prompt(c("query_text"), c("source_url"), c("source_text"), c("chunk_index"), c("chunk_count")), 256).alias("digest"))


@query(
    "fl29_model_http_errors",
    "SELECT source_document_id, CASE WHEN http_status IN (408, 429) OR http_status >= 500 THEN 'LLM_PROVIDER_UNAVAILABLE' ELSE 'LLM_PROVIDER_REJECTED' END AS code, http_status IN (408, 429) OR http_status >= 500 AS retryable FROM source_documents WHERE http_status IS NOT NULL AND http_status NOT BETWEEN 200 AND 299",
)
def fl29(spark, sf):
    """What a failing status of the provider means."""
    retryable = F.col("http_status").isin(408, 429) | (F.col("http_status") >= 500)
    rows = table(spark, sf, "source_documents", "source_document_id", "http_status").where("http_status IS NOT NULL AND http_status NOT BETWEEN 200 AND 299")
    return rows.select("source_document_id", F.when(retryable, "LLM_PROVIDER_UNAVAILABLE").otherwise("LLM_PROVIDER_REJECTED").alias("code"), retryable.alias("retryable"))


_ERRORS = (("AbortError", None, None, "source-fetch"), ("TypeError", None, None, "source-fetch"), ("ExtractionError", "HTTP_SERVER_ERROR", True, "source-fetch"), ("LlmExtractionError", "LLM_PROVIDER_REJECTED", False, "record-processing"), ("Error", None, None, "content-extraction"), ("RetryableError", None, True, "record-processing"))
_ERROR_ROWS = ", ".join("(" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" for v in e) + ")" for e in _ERRORS)


@query(
    "fl30_error_classes",
    f"""SELECT name, queue, CASE WHEN retryable IS NULL AND queue = 'source-fetch' THEN CASE WHEN name = 'AbortError' THEN 'REQUEST_TIMEOUT' ELSE 'NETWORK_ERROR' END ELSE coalesce(CASE WHEN retryable IS NOT NULL THEN code END, replace(upper(queue), '-', '_') || '_FAILED') END AS code,
        CASE WHEN retryable IS NULL AND queue = 'source-fetch' THEN true ELSE retryable END AS retryable FROM (VALUES {_ERROR_ROWS}) AS e(name, code, retryable, queue)""",
)
def fl30(spark, sf):
    """Errors by class: those that say whether they may be retried keep their code; unknown ones of a fetch are timeouts or network errors; the rest get their queue's code."""
    rows = spark.createDataFrame(list(_ERRORS), "name string, code string, retryable boolean, queue string")
    unknown = F.col("retryable").isNull() & (F.col("queue") == "source-fetch")
    fallback = F.concat(F.replace(F.upper("queue"), F.lit("-"), F.lit("_")), F.lit("_FAILED"))
    code = F.when(unknown, F.when(F.col("name") == "AbortError", "REQUEST_TIMEOUT").otherwise("NETWORK_ERROR")).otherwise(F.coalesce(F.when(F.col("retryable").isNotNull(), F.col("code")), fallback))
    return rows.select("name", "queue", code.alias("code"), F.when(unknown, True).otherwise(F.col("retryable")).alias("retryable"))


SUPPORTED = ("company", "website", "role", "location", "signal", "sourceUrl", "evidence")
_CONTRACTS = (("companyHiringSignal", [*SUPPORTED]), ("companyHiringSignal", [*SUPPORTED, "confidenceScore"]), ("companyHiringSignal", ["company", "role"]), ("other", [*SUPPORTED]), ("companyHiringSignal", [*SUPPORTED, "salary"]), ("companyHiringSignal", [*SUPPORTED, "company"]))
_CONTRACT_ROWS = ", ".join(f"({k}, '{t}', {f})" for k, (t, f) in enumerate(_CONTRACTS))


@query(
    "fl19_contract_issues",
    f"""SELECT id, array_to_string(list_filter([CASE WHEN type <> 'companyHiringSignal' THEN 'type' END, CASE WHEN len(list_distinct(fields)) <> len(fields) THEN 'duplicates' END,
        CASE WHEN NOT list_has_all(fields, {list(SUPPORTED)}) THEN 'missing' END, CASE WHEN NOT list_has_all({[*SUPPORTED, 'confidenceScore']}, fields) THEN 'extra' END], lambda x: x IS NOT NULL), ',') AS issues FROM (VALUES {_CONTRACT_ROWS}) AS c(id, type, fields)""",
)
def fl19(spark, sf):
    """Extraction contracts: the type, the seven fields, nothing else but the confidence, no repetition."""
    rows = spark.createDataFrame([(k, t, f) for k, (t, f) in enumerate(_CONTRACTS)], "id int, type string, fields array<string>")
    every, allowed = (F.array(*[F.lit(c) for c in cs]) for cs in (SUPPORTED, (*SUPPORTED, "confidenceScore")))
    fields = F.col("fields")
    rules = {"type": F.col("type") != "companyHiringSignal", "duplicates": F.size(F.array_distinct(fields)) != F.size(fields), "missing": F.size(F.array_except(every, fields)) > 0, "extra": F.size(F.array_except(fields, allowed)) > 0}
    return rows.select("id", F.array_join(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()])), ",").alias("issues"))


@query(
    "js1_compiled_schemas",
    f"""SELECT id, '{{"$schema":"https://json-schema.org/draft/2020-12/schema","title":"' || type || '","type":"object","properties":{{' || array_to_string(list_transform(fields, lambda f: '"' || f || '":{{}}'), ',') || '}},"required":' || to_json(fields) || ',"additionalProperties":false}}' AS schema
        FROM (VALUES {_CONTRACT_ROWS}) AS c(id, type, fields) WHERE len(list_distinct(fields)) = len(fields)""",
)
def js1(spark, sf):
    """Field lists compiled to JSON Schema."""
    rows = spark.createDataFrame([(k, t, f) for k, (t, f) in enumerate(_CONTRACTS) if len(set(f)) == len(f)], "id int, type string, fields array<string>")
    properties = F.map_from_arrays("fields", F.transform("fields", lambda _: F.from_json(F.lit("{}"), "map<string,string>")))
    body = F.struct(F.lit("https://json-schema.org/draft/2020-12/schema").alias("$schema"), F.col("type").alias("title"), F.lit("object").alias("type"), properties.alias("properties"), F.col("fields").alias("required"), F.lit(False).alias("additionalProperties"))
    return rows.select("id", F.to_json(body).alias("schema"))


@query(
    "fl20_stored_contracts",
    f"""SELECT id, array_to_string(list_sort(list_filter({list(SUPPORTED)}, lambda f: NOT list_contains(fields, f))), ',') AS missing, array_to_string(list_sort(list_filter(list_distinct(fields), lambda f: NOT list_contains({list(SUPPORTED)}, f))), ',') AS extra
        FROM (VALUES {_CONTRACT_ROWS}) AS c(id, type, fields) WHERE len(list_distinct(fields)) = len(fields)""",
)
def fl20(spark, sf):
    """The contract read back from the stored schema: what its required fields lack and what they add."""
    fields = F.from_json("schema", "required array<string>")["required"]
    every = F.array(*[F.lit(c) for c in SUPPORTED])
    sorted_text = lambda a: F.array_join(F.array_sort(a), ",")
    return js1(spark, sf).select("id", sorted_text(F.array_except(every, fields)).alias("missing"), sorted_text(F.array_except(fields, every)).alias("extra"))


_J = "CASE WHEN json_valid(payload) THEN payload END"


@query(
    "fl24_schema_issues",
    f"""SELECT job_event_id, array_to_string(list_filter([CASE WHEN NOT list_contains(k, 'attempt') THEN 'attempt: Required' END, CASE WHEN NOT list_contains(k, 'durationMs') THEN 'durationMs: Required' END,
        CASE WHEN len(list_filter(k, lambda x: x NOT IN ('attempt', 'durationMs'))) > 0 THEN '/: Unrecognized keys' END], lambda x: x IS NOT NULL), '; ') AS issues
        FROM (SELECT job_event_id, json_keys({_J}) AS k FROM {EVENTS} WHERE json_valid(payload) AND json_type({_J}) = 'OBJECT')""",
)
def fl24(spark, sf):
    """Every issue of the payloads against a schema of two required fields and no others."""
    rows = events(spark, sf).distinct().where(md.json_kind(F.try_parse_json("payload")) == "OBJECT").select("job_event_id", F.json_object_keys("payload").alias("k"))
    need = [F.when(~F.array_contains("k", c), f"{c}: Required") for c in ("attempt", "durationMs")]
    other = F.when(F.size(F.array_except("k", F.array(F.lit("attempt"), F.lit("durationMs")))) > 0, "/: Unrecognized keys")
    return rows.select("job_event_id", F.array_join(F.array_compact(F.array(*need, other)), "; ").alias("issues"))


@query("js5_payload_kinds", f"SELECT job_event_id, CASE json_type({_J}) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE CASE WHEN json_type({_J}) IS NOT NULL THEN 'number' END END AS kind FROM {EVENTS}")
def js5(spark, sf):
    """The JSON type of each payload; null for what is no JSON."""
    kind = md.json_kind(F.try_parse_json("payload"))
    name = F.when(kind == "OBJECT", "object").when(kind == "ARRAY", "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")
    return events(spark, sf).distinct().select("job_event_id", name.alias("kind"))


@query(
    "pj5_required_values",
    f"""SELECT job_event_id, CASE WHEN json_type({_J}) IS NULL OR json_type({_J}) <> 'OBJECT' THEN 'NOT_AN_OBJECT' WHEN json_type({_J}, '$.attempt') IS NULL THEN 'MISSING' WHEN json_type({_J}, '$.attempt') IN ('UBIGINT', 'BIGINT') THEN 'OK' ELSE 'WRONG_TYPE' END AS attempt
        FROM {EVENTS}""",
)
def pj5(spark, sf):
    """A required whole number out of each payload, or why there is none."""
    v = F.try_parse_json("payload")
    kind = md.json_kind(F.try_variant_get(v, "$.attempt", "variant"))
    outcome = F.when(F.coalesce(md.json_kind(v), F.lit("")) != "OBJECT", "NOT_AN_OBJECT").when(kind.isNull(), "MISSING").when(kind == "BIGINT", "OK").otherwise("WRONG_TYPE")
    return events(spark, sf).distinct().select("job_event_id", outcome.alias("attempt"))


_FIVE = ("company", "website", "role", "location", "evidence")


@query("pj4_stored_records", f"SELECT record_id, {', '.join(_FIVE)}, confidence_score FROM signals")
def pj4(spark, sf):
    """Records stored as JSON read back as typed columns."""
    rows = table(spark, sf, "signals", "record_id", *_FIVE, "confidence_score")
    stored = rows.select("record_id", F.to_json(F.struct(*_FIVE, "confidence_score")).alias("j"))
    return stored.select("record_id", F.from_json("j", ", ".join(f"{c} string" for c in _FIVE) + ", confidence_score double").alias("r")).select("record_id", "r.*")


@query("pj6_string_arrays", "SELECT job_id, true AS valid, len(requested_sources)::INT AS n, requested_sources[1] AS first FROM research_jobs UNION ALL SELECT -job_id, false, NULL, NULL FROM research_jobs")
def pj6(spark, sf):
    """Arrays inside stored JSON must hold texts alone: each job's list, and once more with a number in it (under the negative id)."""
    rows = table(spark, sf, "research_jobs", "job_id", "requested_sources")
    good = rows.select("job_id", F.to_json(F.struct("requested_sources")).alias("j"))
    bad = good.select((-F.col("job_id")).alias("job_id"), F.replace("j", F.lit(":["), F.lit(":[7,")).alias("j"))
    v = F.expr("try_variant_get(try_parse_json(j), '$.requested_sources', 'array<variant>')")
    read = good.unionByName(bad).withColumn("a", v).withColumn("valid", F.forall("a", lambda x: md.json_kind(x) == "STRING"))
    texts = F.when(F.col("valid"), F.transform("a", lambda x: F.try_variant_get(x, "$", "string")))
    return read.select("job_id", "valid", F.when(F.col("valid"), F.size(texts)).alias("n"), F.get(texts, F.lit(0)).alias("first"))


@query("pj8_projected_keys", "SELECT record_id, to_json(map_from_entries(list_filter([('company', company), ('location', location), ('role', role)], lambda e: e[2] IS NOT NULL))) AS data FROM signals")
def pj8(spark, sf):
    """A map cut down to a list of keys, without null values."""
    c = F.col
    entries = F.create_map(*[x for k in ("company", "location", "role", "website", "evidence") for x in (F.lit(k), c(k))])
    keys = F.array(F.lit("company"), F.lit("location"), F.lit("role"))
    kept = F.map_filter(entries, lambda k, v: F.array_contains(keys, k) & v.isNotNull())
    return table(spark, sf, "signals", "record_id", *_FIVE).select("record_id", F.to_json(kept).alias("data"))


@query("pj3_envelopes", "SELECT record_id, to_json({'recordType': 'companyHiringSignal', 'structuredData': {'company': company, 'website': website, 'role': role, 'location': location}, 'evidence': [{'quote': evidence}], 'deduplicationKey': deduplication_key}) AS envelope FROM signals")
def pj3(spark, sf):
    """Records in the envelope in which they are stored; contract fields without a value are null."""
    body = F.struct(F.lit("companyHiringSignal").alias("recordType"), F.struct("company", "website", "role", "location").alias("structuredData"), F.array(F.struct(F.col("evidence").alias("quote"))).alias("evidence"), F.col("deduplication_key").alias("deduplicationKey"))
    rows = table(spark, sf, "signals", "record_id", *_FIVE, "deduplication_key")
    return rows.select("record_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("envelope"))


@query("pj10_next_messages", "SELECT source_document_id, to_json({'researchJobId': job_id, 'sourceDocumentId': source_document_id, 'pipelineAttempt': 1}) AS message FROM source_documents WHERE job_id IS NOT NULL")
def pj10(spark, sf):
    """A stage's message handed on without its time limit."""
    rows = table(spark, sf, "source_documents", "source_document_id", "job_id").where("job_id IS NOT NULL")
    data = F.struct(F.col("job_id").alias("researchJobId"), F.col("source_document_id").alias("sourceDocumentId"), F.lit(1).alias("pipelineAttempt"), F.lit(60_000).alias("timeoutMs"))
    return rows.withColumn("d", data).select("source_document_id", F.to_json(F.col("d").dropFields("timeoutMs")).alias("message"))


@query(
    "pj11_attributions",
    "SELECT record_id, source_document_id, source_url, strftime(published_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%gZ') AS published_at, CASE WHEN credibility_score IS NOT NULL THEN least(1.0, greatest(0.0, credibility_score)) END AS credibility FROM signals",
)
def pj11(spark, sf):
    """The attribution of each record: its source, ISO date or null, credibility between 0 and 1 or null."""
    rows = table(spark, sf, "signals", "record_id", "source_document_id", "source_url", "published_at", "credibility_score")
    score = F.when(F.col("credibility_score").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), "credibility_score")))
    return rows.select("record_id", "source_document_id", "source_url", tx.iso_time(F.col("published_at")).alias("published_at"), score.alias("credibility"))


@query("pj14_cell_texts", "SELECT record_id, coalesce(role, '') AS role, coalesce(location, '') AS location, coalesce(job_id::VARCHAR, '') AS job FROM signals")
def pj14(spark, sf):
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return table(spark, sf, "signals", "record_id", "role", "location", "job_id").select("record_id", cell("role").alias("role"), cell("location").alias("location"), cell("job_id").alias("job"))


@query("sk16_evidence_cells", "SELECT job_id, deduplication_key, array_to_string(list_sort(list_distinct(list(evidence) FILTER (WHERE evidence IS NOT NULL))), ' | ') AS evidence FROM signals WHERE job_id IS NOT NULL AND deduplication_key IS NOT NULL GROUP BY ALL")
def sk16(spark, sf):
    """The quotes of each merged record in one cell; a record holds up to 50."""
    rows = table(spark, sf, "signals", "job_id", "deduplication_key", "evidence").where("job_id IS NOT NULL AND deduplication_key IS NOT NULL")
    return rows.groupBy("job_id", "deduplication_key").agg(F.array_join(F.array_sort(F.collect_set("evidence")), " | ").alias("evidence"))


@query("rk5_sorted_attributions", "SELECT job_id, deduplication_key, array_to_string(list_transform(list_sort(list_distinct(list({'u': source_url, 'd': source_document_id}))), lambda s: s.u || ' ' || s.d), '; ') AS sources FROM signals WHERE job_id IS NOT NULL AND deduplication_key IS NOT NULL AND source_url IS NOT NULL AND source_document_id IS NOT NULL GROUP BY ALL")
def rk5(spark, sf):
    """The different attributions of each merged record, by address and then by document; a record holds up to 100."""
    rows = table(spark, sf, "signals", "job_id", "deduplication_key", "source_url", "source_document_id").na.drop()
    own = F.array_sort(F.collect_set(F.struct(F.col("source_url").alias("u"), F.col("source_document_id").alias("d"))))
    return rows.groupBy("job_id", "deduplication_key").agg(F.array_join(F.transform(own, lambda s: F.concat(s["u"], F.lit(" "), s["d"].cast("string"))), "; ").alias("sources"))


@query(
    "fl15_group_bounds",
    """SELECT job_id, deduplication_key, count(DISTINCT evidence) BETWEEN 1 AND 50 AS evidence_ok, count(DISTINCT source_url || ' ' || source_document_id) BETWEEN 1 AND 100 AS sources_ok, coalesce(bool_and(confidence_score BETWEEN 0 AND 1), false) AS confidence_ok
       FROM signals WHERE job_id IS NOT NULL AND deduplication_key IS NOT NULL GROUP BY ALL""",
)
def fl15(spark, sf):
    """Bounds of what is stored for each merged record."""
    rows = table(spark, sf, "signals", "job_id", "deduplication_key", "evidence", "source_url", "source_document_id", "confidence_score").where("job_id IS NOT NULL AND deduplication_key IS NOT NULL")
    source = F.concat("source_url", F.lit(" "), F.col("source_document_id").cast("string"))
    out = rows.groupBy("job_id", "deduplication_key").agg(F.count_distinct("evidence").alias("e"), F.count_distinct(source).alias("s"), F.coalesce(F.bool_and(F.col("confidence_score").between(0, 1)), F.lit(False)).alias("confidence_ok"))
    return out.select("job_id", "deduplication_key", F.col("e").between(1, 50).alias("evidence_ok"), F.col("s").between(1, 100).alias("sources_ok"), "confidence_ok")


_START = "CASE WHEN instr(signal_text, left(evidence, 12)) > 0 THEN instr(signal_text, left(evidence, 12)) - 1 END"
_END = "CASE WHEN contains(signal_text, evidence) THEN instr(signal_text, evidence) - 1 + length(evidence) END"


@query(
    "fl16_evidence_offsets",
    f"""SELECT record_id, s::BIGINT AS start_offset, e::BIGINT AS end_offset, (s IS NULL AND e IS NULL) OR coalesce(e > s, false) AS range_ok, CASE WHEN e > s THEN substr(signal_text, s::INT + 1, (e - s)::INT) = evidence ELSE contains(signal_text, evidence) END AS grounded
        FROM (SELECT record_id, signal_text, evidence, {_START} AS s, {_END} AS e FROM signals WHERE evidence IS NOT NULL AND signal_text IS NOT NULL)""",
)
def fl16(spark, sf):
    """Offsets of quotes: both or neither, in order; the slice is the quote, and a quote without offsets stands in the text."""
    rows = table(spark, sf, "signals", "record_id", "signal_text", "evidence").where("evidence IS NOT NULL AND signal_text IS NOT NULL")
    rows = rows.select("record_id", "signal_text", "evidence", F.expr(_START).cast("bigint").alias("start_offset"), F.expr(_END).cast("bigint").alias("end_offset"))
    good = (F.col("start_offset").isNull() & F.col("end_offset").isNull()) | F.coalesce(F.col("end_offset") > F.col("start_offset"), F.lit(False))
    slice_ = F.expr("substr(signal_text, CAST(start_offset AS INT) + 1, CAST(end_offset - start_offset AS INT))")
    grounded = F.when(F.col("end_offset") > F.col("start_offset"), slice_ == F.col("evidence")).otherwise(F.contains("signal_text", "evidence"))
    return rows.select("record_id", "start_offset", "end_offset", good.alias("range_ok"), grounded.alias("grounded"))


@query(
    "fl13_merge_invariants",
    f"""SELECT record_id, rule FROM (SELECT s.record_id, unnest([CASE WHEN d.job_id IS DISTINCT FROM s.job_id THEN 'ownership' END, CASE WHEN d.raw_content IS NULL THEN 'content' END, CASE WHEN NOT contains(d.raw_content, s.evidence) THEN 'evidence' END,
        CASE WHEN d.source_url IS DISTINCT FROM s.source_url THEN 'source_url' END, CASE WHEN coalesce({q.matching('s.company')}, '') = '' THEN 'normalized' END]) AS rule FROM signals s LEFT JOIN source_documents d ON s.source_document_id = d.source_document_id) WHERE rule IS NOT NULL""",
)
def fl13(spark, sf):
    """What has to hold before records are merged into the store, as violations; each page's text meets its records once."""
    pages = table(spark, sf, "source_documents", "source_document_id", F.col("job_id").alias("d_job"), F.col("source_url").alias("d_url"), "raw_content")
    rows = table(spark, sf, "signals", "record_id", "job_id", "source_document_id", "source_url", "evidence", "company").join(pages, "source_document_id", "left")
    c = F.col
    rules = {
        "ownership": ~c("d_job").eqNullSafe(c("job_id")), "content": c("raw_content").isNull(), "evidence": ~F.contains("raw_content", "evidence"), "source_url": ~c("d_url").eqNullSafe(c("source_url")),
        "normalized": F.coalesce(tx.matching(c("company")), F.lit("")) == "",
    }
    return rows.select("record_id", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))).alias("rule"))


@query("sk7_inserted_records", f"""SELECT s.record_id FROM signals s JOIN source_documents d ON s.source_document_id = d.source_document_id AND s.job_id = d.job_id
    WHERE d.raw_content IS NOT NULL AND contains(s.signal_text, s.evidence) AND length({q.trimmed('s.company')}) BETWEEN 1 AND 300 AND length({q.trimmed('s.evidence')}) BETWEEN 1 AND 1000 AND s.confidence_score BETWEEN 0 AND 1""")
def sk7(spark, sf):
    """The records that are inserted: of their job's source, which has content, quoting what they were read from, within the bounds."""
    pages = table(spark, sf, "source_documents", "source_document_id", "job_id", "raw_content").where("raw_content IS NOT NULL").select("source_document_id", "job_id")
    size = lambda c: tx.utf16_length(tx.trimmed(F.col(c)))
    good = size("company").between(1, 300) & size("evidence").between(1, 1000) & F.col("confidence_score").between(0, 1)
    rows = table(spark, sf, "signals", "record_id", "job_id", "source_document_id", "company", "evidence", "signal_text", "confidence_score").where(good & F.contains("signal_text", "evidence"))
    return rows.join(pages, ["source_document_id", "job_id"], "left_semi").select("record_id")


@query(
    "fl18_request_rules",
    f"""SELECT job_id, rule FROM (SELECT job_id, unnest([CASE WHEN coalesce(length({q.trimmed('query_text')}), 0) NOT BETWEEN 1 AND 10000 THEN 'query' END, CASE WHEN len(requested_sources) NOT BETWEEN 1 AND 20 THEN 'sources' END,
        CASE WHEN len(list_distinct(requested_sources)) <> len(requested_sources) THEN 'duplicates' END, CASE WHEN len(list_filter(requested_sources, lambda u: NOT ({q.is_web('u')} AND length(u) <= 2048))) > 0 THEN 'url' END]) AS rule FROM research_jobs) WHERE rule IS NOT NULL""",
)
def fl18(spark, sf):
    """Requests with at most 20 sources: query, number, repetition and addresses, as violations."""
    s = F.col("requested_sources")
    rules = {
        "query": ~F.coalesce(tx.utf16_length(tx.trimmed(F.col("query_text"))), F.lit(0)).between(1, 10_000), "sources": ~F.size(s).between(1, 20), "duplicates": F.size(F.array_distinct(s)) != F.size(s),
        "url": F.exists(s, lambda u: ~(ur.is_web(u) & (F.length(u) <= ur.LONGEST))),
    }
    return table(spark, sf, "research_jobs", "job_id", "query_text", "requested_sources").select("job_id", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))).alias("rule"))


_RESOLVED = (("open.example", ["8.8.8.8", "1.1.1.1"]), ("mixed.example", ["8.8.8.8", "10.0.0.1"]), ("mapped.example", ["::ffff:192.168.0.9"]), ("none.example", []), ("six.example", ["2606:4700::1111"]), ("local.example", ["fe80::1"]))


@query("fl9_public_addresses", "SELECT * FROM (VALUES ('open.example', true), ('mixed.example', false), ('mapped.example', false), ('none.example', false), ('six.example', true), ('local.example', false)) AS r(host, public)")
def fl9(spark, sf):
    """A host is public where it has addresses and all of them are."""
    rows = spark.createDataFrame(list(_RESOLVED), "host string, addresses array<string>")
    return rows.select("host", ((F.size("addresses") > 0) & F.forall("addresses", lambda a: ~ur.private_host(a))).alias("public"))


_TYPES = ("Text/HTML ; charset=utf-8", "application/json", " TEXT/plain;x=1", "")


@query("fs13_media_types", "SELECT * FROM (VALUES ('Text/HTML ; charset=utf-8', 'text/html'), ('application/json', 'application/json'), (' TEXT/plain;x=1', 'text/plain'), ('', '')) AS t(header, media_type)")
def fs13(spark, sf):
    return spark.createDataFrame([(t,) for t in _TYPES], "header string").select("header", tx.media_type(F.col("header")).alias("media_type"))


@query("sr11_content_lengths", "SELECT * FROM (VALUES ('120', 120), ('0', 0), ('-1', NULL), ('1.5', NULL), ('', NULL), ('9007199254740993', NULL), ('9007199254740991', 9007199254740991), ('12a', NULL)) AS t(header, bytes)")
def sr11(spark, sf):
    """A content length is a whole number from 0 that the web's scripting language holds exactly."""
    rows = spark.createDataFrame([(t,) for t in ("120", "0", "-1", "1.5", "", "9007199254740993", "9007199254740991", "12a")], "header string")
    n = F.when(F.col("header").rlike(r"^\d+$"), F.col("header").try_cast("bigint"))
    return rows.select("header", F.when(n.between(0, 9_007_199_254_740_991), n).alias("bytes"))


@query("ur6_bare_hosts", "SELECT * FROM (VALUES ('[FE80::1]', 'fe80::1'), ('Example.ORG', 'example.org'), ('[::1]', '::1')) AS t(name, host)")
def ur6(spark, sf):
    return spark.createDataFrame([("[FE80::1]",), ("Example.ORG",), ("[::1]",)], "name string").select("name", ur.bare_host(F.col("name")).alias("host"))
