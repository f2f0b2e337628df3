"""The model stage: messages, a provider behind an interface, envelopes of completions, their validation, usage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions import url as ur

#: What a record of a completion holds, and the greatest length of each text.
TEXTS = {"company": 300, "website": 2048, "role": 500, "location": 500, "signal": 2000, "sourceUrl": 2048, "evidence": 1000}
NULLABLE = ("website", "role", "location")
FIELDS = (*TEXTS, "confidenceScore")
RECORD = "struct<" + ", ".join(f"{c}:string" for c in TEXTS) + ", confidenceScore:double>"
LONGEST_CANDIDATE = 20_000
MOST_RECORDS = 100


class Provider(Protocol):
    """Answers messages with the JSON text of a response envelope."""

    def complete(self, messages: str) -> str: ...


class Scripted:
    """Answers in the order of its script; an exhausted script is an error."""

    def __init__(self, outcomes: list[str]):
        self.outcomes = list(outcomes)

    def complete(self, messages: str) -> str:
        if not self.outcomes:
            raise LookupError("the script has no further outcome")
        return self.outcomes.pop(0)


def completions(prompts: DataFrame, make: Callable[[], Provider]) -> DataFrame:
    """(id, response) of (id, messages): one provider for each task, asked row by row, errors of the call as null responses."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for batch in batches:
            answers = []
            for messages in batch.column(1).to_pylist():
                try:
                    answers.append(provider.complete(messages))
                except (LookupError, OSError, TimeoutError):
                    answers.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string())], ["id", "response"])

    kind = prompts.schema["id"].dataType.simpleString()
    return prompts.select("id", "messages").mapInArrow(ask, f"id {kind}, response string")


def prompt(query: Column, url: Column, text: Column, index: Column, count: Column, issues: Column | None = None, candidate: Column | None = None) -> Column:
    """The user message: what is asked, or with ``issues`` the repair of a candidate that broke rules."""
    chunk = F.struct(index.alias("index"), count.alias("count"), text.alias("untrustedWebpageText")).alias("sourceChunk")
    rest = [query.alias("researchQuery"), url.alias("sourceUrl"), chunk]
    if issues is None:
        return F.to_json(F.struct(F.lit("Extract supported hiring signals relevant to the research query.").alias("task"), *rest), {"ignoreNullFields": "false"})
    task = F.lit("Repair the candidate output so it satisfies every rule and output shape. Return JSON only.").alias("task")
    return F.to_json(F.struct(task, issues.alias("validationIssues"), *rest, F.left(candidate, F.lit(LONGEST_CANDIDATE)).alias("untrustedInvalidCandidate")), {"ignoreNullFields": "false"})


def envelope(response: Column) -> dict[str, Column]:
    """Content and usage of a response; content is null where the envelope is broken or has no choice."""
    parsed = F.from_json(response, "model string, choices array<struct<message:struct<content:string>>>, usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>")
    return {
        "content": F.get(parsed["choices"], F.lit(0))["message"]["content"], "model": parsed["model"], "input_tokens": parsed["usage"]["prompt_tokens"],
        "output_tokens": parsed["usage"]["completion_tokens"], "total_tokens": parsed["usage"]["total_tokens"],
    }


def json_kind(variant: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, ... of a variant; null for no value."""
    return F.regexp_extract(F.schema_of_variant(variant), r"^(\w+)", 1)


def shape_issues(record: Column) -> Column:
    """Issues of one record (a variant) against the schema, as an array of texts without their place."""
    out = []
    for name, most in TEXTS.items():
        value = F.try_variant_get(record, f"$.{name}", "string")
        kind = json_kind(F.try_variant_get(record, f"$.{name}", "variant"))
        missing = kind.isNull()
        null = kind == "VOID"
        wrong = ~missing & (kind != "STRING") & (F.lit(True) if name not in NULLABLE else ~null)
        size = tx.utf16_length(tx.trimmed(value))
        out.append(F.when(missing, f"{name}: Required").when(wrong, f"{name}: Invalid type").when((kind == "STRING") & ~size.between(1, most), f"{name}: Invalid length"))
        if name in ("website", "sourceUrl"):
            out.append(F.when((kind == "STRING") & ~ur.is_web(value), f"{name}: Invalid url"))
    score = F.try_variant_get(record, "$.confidenceScore", "double")
    kind = json_kind(F.try_variant_get(record, "$.confidenceScore", "variant"))
    number = kind.isin("BIGINT", "DOUBLE", "DECIMAL")
    out.append(F.when(kind.isNull(), "confidenceScore: Required").when(~number, "confidenceScore: Invalid type").when(~score.between(0, 1), "confidenceScore: Out of range"))
    return F.array_compact(F.array(*out))


def validated(completions: DataFrame) -> DataFrame:
    """(id, success, records, issues) of (id, content, source_url, chunk): all records of a completion, or its issues.

    In the order of the checks: the text is JSON; an object with an array of up to 100 records and nothing else; each
    record has the fields, types and bounds of the schema; each record speaks of the given address, quotes the chunk word
    for word and names only what the chunk names.
    """
    parsed = completions.withColumn("v", F.try_parse_json("content")).withColumn("kind", json_kind(F.col("v")))
    extra = F.array_except(F.expr("json_object_keys(to_json(v))"), F.array(F.lit("records")))
    parsed = parsed.withColumn("list", F.expr("try_variant_get(v, '$.records', 'array<variant>')")).withColumn("extra", F.coalesce(extra, F.array().cast("array<string>")))
    rows = parsed.withColumn(
        "broken",
        F.when(F.col("v").isNull(), "Response is not valid JSON").when(F.col("kind") != "OBJECT", "/: Expected object").when(F.col("list").isNull(), "records: Required")
        .when(F.size("extra") > 0, "/: Unrecognized keys").when(F.size("list") > MOST_RECORDS, "records: Too many"),
    )
    each = rows.where("broken IS NULL").select("id", "source_url", "chunk", F.posexplode("list").alias("k", "x"))
    typed = each.withColumn("r", F.from_json(F.to_json("x"), RECORD)).withColumn("unknown", F.array_except(F.expr("json_object_keys(to_json(x))"), F.array(*[F.lit(c) for c in FIELDS])))
    shape = F.concat(shape_issues(F.col("x")), F.when(F.size("unknown") > 0, F.array(F.lit("Unrecognized keys"))).otherwise(F.array().cast("array<string>")))
    typed = typed.withColumn("shape", shape).withColumn("low", F.lower("chunk"))
    absent = lambda c: F.col(f"r.{c}").isNotNull() & ~F.contains("low", F.lower(F.col(f"r.{c}")))
    site = F.coalesce(F.nullif(ur.host(F.col("r.website")), F.lit("")), F.lower("r.website"))
    grounding = F.array_compact(
        F.array(
            F.when(F.col("r.sourceUrl") != F.col("source_url"), "sourceUrl must equal the supplied URL"), F.when(~F.contains("chunk", F.col("r.evidence")), "evidence must occur verbatim in the source chunk"),
            *[F.when(absent(c), f"{c} must occur in the source chunk") for c in ("company", "role", "location")],
            F.when(absent("website") & ~F.contains("low", site), "website must occur in the source chunk or be null"),
        )
    )
    # the schema is checked over the whole completion before anything is looked up in the chunk
    per_record = typed.select("id", "k", "r", "shape", F.when(F.size("shape") == 0, grounding).otherwise(F.array().cast("array<string>")).alias("grounding"))
    placed = lambda c, sign: F.transform(c, lambda i: F.concat(F.lit("records."), F.col("k").cast("string"), F.lit(sign), i))
    gathered = per_record.groupBy("id").agg(  # up to 100 records
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", placed(F.col("shape"), ".").alias("i")))), lambda s: s["i"])).alias("shape"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", placed(F.col("grounding"), ".").alias("i")))), lambda s: s["i"])).alias("grounding"),
        F.transform(F.array_sort(F.collect_list(F.struct("k", "r"))), lambda s: s["r"]).alias("records"),
    )
    joined = rows.select("id", "broken").join(gathered, "id", "left")
    none = F.array().cast("array<string>")
    issues = F.when(F.col("broken").isNotNull(), F.array("broken")).when(F.size("shape") > 0, F.col("shape")).otherwise(F.coalesce("grounding", none))
    out = joined.withColumn("issues", issues)
    fine = F.size("issues") == 0
    return out.select("id", fine.alias("success"), F.when(fine, F.coalesce("records", F.array().cast(f"array<{RECORD}>"))).alias("records"), "issues")
