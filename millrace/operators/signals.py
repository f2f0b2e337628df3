"""Signals: normalised fields, keys, relevance, comparison and merging of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import score as sc
from millrace.functions import text as tx
from millrace.functions import url as ur

SEPARATOR = "\u001f"


def normalized(signals: DataFrame) -> DataFrame:
    """Adds the comparable company, role, domain, address, location and signal of each record."""
    return signals.withColumns(
        {
            "n_company": tx.company_name(F.col("company")),
            "n_role": tx.role_name(F.col("role")),
            "n_url": ur.canonical(F.col("source_url")),
            "n_domain": ur.domain(F.col("website"), F.col("source_url")),
            "n_location": tx.place_name(F.col("location")),
            "n_signal": tx.matching(F.col("signal_text")),
        }
    )


def keyed(df: DataFrame) -> DataFrame:
    """Adds the key of equal records and the key a record gets when it conflicts."""
    key = F.sha2(F.concat_ws(SEPARATOR, "n_company", "n_role", "n_domain", "n_url"), 256)
    return df.withColumn("dedup_key", key).withColumn("conflict_key", F.sha2(F.concat_ws(SEPARATOR, "dedup_key", "n_location", "n_signal", "n_url"), 256))


def components(query: Column, now: Column) -> dict[str, Column]:
    c = F.col
    return {
        "keyword_overlap": sc.keyword_overlap(query, c("company"), c("website"), c("role"), c("location"), c("signal_text"), c("evidence")),
        "completeness": sc.completeness(c("company"), c("website"), c("role"), c("location"), c("signal_text"), c("source_url"), c("evidence")),
        "confidence": F.coalesce(sc.clamped(c("confidence_score")), F.lit(0.0)),
        "freshness": sc.freshness(c("published_at"), now),
        "credibility": sc.credibility(c("credibility_score"), c("website"), c("n_domain"), c("source_url")),
        "directness": sc.directness(c("company"), c("role"), c("evidence")),
    }


def scored(df: DataFrame, query: Column, now: Column) -> DataFrame:
    """Adds the six components and the relevance of each record."""
    parts = components(query, now)
    out = df.withColumns({name: sc.rounded(value) for name, value in parts.items()})
    return out.withColumn("relevance", sc.total({name: F.col(name) for name in parts}))


def best_of_key(df: DataFrame) -> DataFrame:
    """The first row of each (source_document_id, dedup_key) by time of creation, then id."""
    window = Window.partitionBy("source_document_id", "dedup_key").orderBy("created_at", "record_id")
    return df.withColumn("rank", F.row_number().over(window)).where("rank = 1").drop("rank")


def match_kind(a: str, b: str) -> tuple[Column, Column, Column, Column]:
    """(kind, domain conflict, location conflict, polarity conflict) of two aliased records of one company and role."""
    left, right = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    domain = (left("n_domain") != "") & (right("n_domain") != "") & (left("n_domain") != right("n_domain"))
    location = (left("n_location") != "") & (right("n_location") != "") & (left("n_location") != right("n_location"))
    polarity = left("negative") != right("negative")
    shared = F.size(F.array_intersect(left("words"), right("words")))
    every = F.size(left("words")) + F.size(right("words")) - shared
    same = (left("n_domain") == right("n_domain")) & ((left("n_url") == right("n_url")) | (every == 0) | (shared / F.nullif(every, F.lit(0)) >= 0.6))
    kind = F.when(domain | location | polarity, "CONFLICT").when(same, "DUPLICATE").otherwise("DISTINCT")
    return kind, domain, location, polarity


def matches(df: DataFrame) -> DataFrame:
    """Comparison of the different normalised records of each job, company and role.

    Records equal in every normalised field are one candidate with a count: they compare alike,
    so a group of copies is never expanded into pairs.
    """
    fields = ["job_id", "n_company", "n_role", "n_domain", "n_url", "n_location", "n_signal"]
    candidates = df.groupBy(*fields).agg(F.min("record_id").alias("record_id"), F.count(F.lit(1)).alias("copies"))
    # what each comparison needs of one record is made once a candidate
    words = F.array_distinct(F.filter(F.split("n_signal", " "), lambda t: t != ""))
    candidates = candidates.withColumns({"negative": tx.negative(F.col("n_signal")), "words": words})
    kind, domain, location, polarity = match_kind("a", "b")
    a, b = candidates.alias("a"), candidates.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("job_id", "n_company", "n_role")] + [F.col("a.record_id") < F.col("b.record_id")]
    return a.join(b, on).select(
        F.col("a.job_id").alias("job_id"), F.col("a.record_id").alias("record_id_a"), F.col("b.record_id").alias("record_id_b"), kind.alias("kind"),
        domain.alias("domain_differs"), location.alias("location_differs"), polarity.alias("polarity_differs"),
    )
