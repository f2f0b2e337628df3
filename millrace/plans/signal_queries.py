"""Queries over the signals: normalisation, keys, relevance, comparison, merging, reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import score as sc
from millrace.functions import text as tx
from millrace.functions import url as ur
from millrace.operators import fold
from millrace.operators import signals as sg
from millrace.plans import sqltext as q
from millrace.sources import spread, table

QUERIES: dict = {}
SQL: dict = {}
NOW = datetime.fromisoformat(q.NOW)
COLUMNS = ("record_id", "job_id", "source_document_id", "company", "website", "role", "location", "signal_text", "source_url", "evidence", "confidence_score", "published_at", "credibility_score",
           "created_at")


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


def signals(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "signals", *(columns or COLUMNS))


def keyed(spark: SparkSession, sf: str) -> DataFrame:
    return sg.keyed(sg.normalized(spread(signals(spark, sf))))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "research_jobs", "job_id", "query_text")
    return sg.scored(keyed(spark, sf).join(asked, "job_id", "left"), F.col("query_text"), F.lit(q.NOW + "+00:00").cast("timestamp"))


@query("fs1_collapsed_text", f"SELECT record_id, {q.collapsed('company')} AS company, {q.collapsed('role')} AS role, {q.collapsed('location')} AS location FROM signals")
def fs1(spark, sf):
    return signals(spark, sf).select("record_id", *[tx.collapsed(F.col(c)).alias(c) for c in ("company", "role", "location")])


@query("fs2_matching_text", f"SELECT record_id, {q.matching('signal_text')} AS signal FROM signals")
def fs2(spark, sf):
    return signals(spark, sf).select("record_id", tx.matching(F.col("signal_text")).alias("signal"))


@query("fs3_company_name", f"SELECT record_id, {q.company('company')} AS company FROM signals")
def fs3(spark, sf):
    return signals(spark, sf).select("record_id", tx.company_name(F.col("company")).alias("company"))


@query("fs4_role_name", f"SELECT record_id, {q.role('role')} AS role FROM signals")
def fs4(spark, sf):
    return signals(spark, sf).select("record_id", tx.role_name(F.col("role")).alias("role"))


@query("fs5_place_name", f"SELECT record_id, {q.place('location')} AS location FROM signals")
def fs5(spark, sf):
    return signals(spark, sf).select("record_id", tx.place_name(F.col("location")).alias("location"))


def _variants(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN ''::VARCHAR ELSE {q.collapsed(c)} END"


@query(
    "fs6_original_variants",
    f"SELECT record_id, {q.collapsed('company')} AS companies, {_variants('website')} AS websites, {_variants('role')} AS roles, {_variants('location')} AS locations FROM signals",
)
def fs6(spark, sf):
    none = F.array().cast("array<string>")
    arrays = {n: F.when(F.col(c).isNull(), none).otherwise(F.array(tx.collapsed(F.col(c)))) for n, c in (("companies", "company"), ("websites", "website"), ("roles", "role"), ("locations", "location"))}
    return signals(spark, sf).select("record_id", *[F.array_join(v, "|").alias(n) for n, v in arrays.items()])


@query("fs7_normalized_signal", f"SELECT record_id, n_company, n_role, n_domain, n_url, n_location, n_signal FROM ({q.NORMALIZED})")
def fs7(spark, sf):
    return sg.normalized(spread(signals(spark, sf))).select("record_id", "n_company", "n_role", "n_domain", "n_url", "n_location", "n_signal")


@query("fs8_query_tokens", f"SELECT job_id, array_to_string({q.tokens('query_text')}, ' ') AS tokens FROM research_jobs")
def fs8(spark, sf):
    return table(spark, sf, "research_jobs", "job_id", "query_text").select("job_id", F.array_join(F.array_sort(tx.tokens(F.col("query_text"))), " ").alias("tokens"))


@query("ur1_canonical_url", f"SELECT record_id, {q.canonical('source_url')} AS url FROM signals")
def ur1(spark, sf):
    return signals(spark, sf).select("record_id", ur.canonical(F.col("source_url")).alias("url"))


@query("ur2_domain", f"SELECT record_id, {q.domain('website', 'source_url')} AS domain FROM signals")
def ur2(spark, sf):
    return signals(spark, sf).select("record_id", ur.domain(F.col("website"), F.col("source_url")).alias("domain"))


@query("hs1_dedup_key", f"SELECT record_id, dedup_key FROM ({q.KEYED})")
def hs1(spark, sf):
    return keyed(spark, sf).select("record_id", "dedup_key")


@query("hs2_conflict_key", f"SELECT record_id, conflict_key FROM ({q.KEYED})")
def hs2(spark, sf):
    return keyed(spark, sf).select("record_id", "conflict_key")


_FIVE = ("company", "website", "role", "location", "signal_text")


@query("hs3_extraction_key", "SELECT record_id, sha256(concat_ws(chr(31), " + ", ".join(f"lower({q.trimmed(f'coalesce({c}, {chr(39)}{chr(39)})')})" for c in _FIVE) + ")) AS key FROM signals")
def hs3(spark, sf):
    return signals(spark, sf).select("record_id", F.sha2(F.concat_ws("\u001f", *[F.lower(tx.trimmed(F.coalesce(F.col(c), F.lit("")))) for c in _FIVE]), 256).alias("key"))


@query("fl5_negative_signal", f"SELECT record_id, {q.negative(q.matching('signal_text'))} AS negative FROM signals")
def fl5(spark, sf):
    return signals(spark, sf).select("record_id", tx.negative(tx.matching(F.col("signal_text"))).alias("negative"))


@query("st1_token_jaccard", f"SELECT record_id, {q.rounded(q.jaccard(q.matching('signal_text'), q.matching('evidence')))} AS similarity FROM signals")
def st1(spark, sf):
    return signals(spark, sf).select("record_id", sc.rounded(tx.jaccard(tx.matching(F.col("signal_text")), tx.matching(F.col("evidence")))).alias("similarity"))


_PARTS = ("keyword_overlap", "completeness", "confidence", "freshness", "credibility", "directness")


@query("sr1_score_components", f"SELECT record_id, {', '.join(_PARTS)} FROM ({q.scored('query_text')})")
def sr1(spark, sf):
    return scored(spark, sf).select("record_id", *_PARTS)


@query("ag16_relevance", f"SELECT record_id, relevance FROM ({q.scored('query_text')})")
def ag16(spark, sf):
    return scored(spark, sf).select("record_id", "relevance")


@query(
    "wn1_first_of_key",
    f"SELECT record_id, source_document_id, dedup_key FROM ({q.KEYED}) QUALIFY row_number() OVER (PARTITION BY source_document_id, dedup_key ORDER BY created_at, record_id) = 1",
)
def wn1(spark, sf):
    return sg.best_of_key(keyed(spark, sf)).select("record_id", "source_document_id", "dedup_key")


_SOURCES = "SELECT source_document_id AS sd, job_id AS sj, title, domain AS source_domain, fetched_at FROM source_documents"


@query("jn1_records_with_source", f"SELECT record_id, s.job_id, source_document_id, title, source_domain FROM signals s JOIN ({_SOURCES}) d ON s.source_document_id = d.sd AND s.job_id = d.sj")
def jn1(spark, sf):
    sources = table(spark, sf, "source_documents", "source_document_id", "job_id", "title", F.col("domain").alias("source_domain"))
    return signals(spark, sf, "record_id", "job_id", "source_document_id").join(sources, ["job_id", "source_document_id"]).select("record_id", "job_id", "source_document_id", "title", "source_domain")


@query(
    "rk1_ranked_results",
    f"""WITH b AS (SELECT * FROM ({q.scored('query_text')}) QUALIFY row_number() OVER (PARTITION BY source_document_id, dedup_key ORDER BY created_at, record_id) = 1),
        r AS (SELECT b.*, d.title, d.source_domain, row_number() OVER (PARTITION BY b.job_id ORDER BY relevance DESC, created_at DESC, record_id) AS rank
              FROM b JOIN ({_SOURCES}) d ON b.source_document_id = d.sd AND b.job_id = d.sj)
        SELECT job_id, rank, record_id, n_company, n_role, relevance, title, source_domain FROM r WHERE rank <= 20""",
)
def rk1(spark, sf):
    """The 20 most relevant distinct records of each job with their source."""
    # the first of each key needs no score, so only survivors are scored
    asked = table(spark, sf, "research_jobs", "job_id", "query_text")
    best = sg.scored(sg.best_of_key(keyed(spark, sf)).join(asked, "job_id", "left"), F.col("query_text"), F.lit(q.NOW + "+00:00").cast("timestamp"))
    sources = table(spark, sf, "source_documents", "source_document_id", "job_id", "title", F.col("domain").alias("source_domain"))
    window = Window.partitionBy("job_id").orderBy(F.desc("relevance"), F.desc("created_at"), "record_id")
    ranked = best.join(sources, ["job_id", "source_document_id"]).withColumn("rank", F.row_number().over(window)).where("rank <= 20")
    return ranked.select("job_id", F.col("rank").cast("bigint").alias("rank"), "record_id", "n_company", "n_role", "relevance", "title", "source_domain")


@query(
    "sc4_results_page",
    f"""SELECT job_id, rn, record_id, relevance, total, title FROM (
        SELECT s.*, d.title, row_number() OVER (PARTITION BY s.job_id ORDER BY relevance DESC, s.created_at DESC, record_id) AS rn, count(*) OVER (PARTITION BY s.job_id) AS total
        FROM ({q.scored('query_text')}) s JOIN ({_SOURCES}) d ON s.source_document_id = d.sd AND s.job_id = d.sj) WHERE rn BETWEEN 21 AND 40""",
)
def sc4(spark, sf):
    """Page 2 of 20 results of every job with source and total: the feature is a page, so the limit stays."""
    source = table(spark, sf, "source_documents", "source_document_id", "job_id", "title")
    rows = scored(spark, sf).select("job_id", "source_document_id", "record_id", "relevance", "created_at").join(source, ["source_document_id", "job_id"])
    window = Window.partitionBy("job_id").orderBy(F.desc("relevance"), F.desc("created_at"), "record_id")
    total = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"))
    paged = rows.withColumn("rn", F.row_number().over(window).cast("bigint")).where("rn <= 40").where("rn >= 21")
    return paged.join(total, "job_id").select("job_id", "rn", "record_id", "relevance", "total", "title")


@query("rk2_total_pages", "SELECT job_id, count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM signals WHERE job_id IS NOT NULL GROUP BY job_id")
def rk2(spark, sf):
    return signals(spark, sf, "job_id").where("job_id IS NOT NULL").groupBy("job_id").agg(F.count(F.lit(1)).alias("total")).withColumn("total_pages", F.ceil(F.col("total") / 20.0))


_CANDIDATES = f"SELECT job_id, n_company, n_role, n_domain, n_url, n_location, n_signal, min(record_id) AS record_id FROM ({q.NORMALIZED}) GROUP BY ALL"
_DOM, _LOC = "(a.n_domain <> '' AND b.n_domain <> '' AND a.n_domain <> b.n_domain)", "(a.n_location <> '' AND b.n_location <> '' AND a.n_location <> b.n_location)"
_POL = f"({q.negative('a.n_signal')} <> {q.negative('b.n_signal')})"


@query(
    "jn2_record_matches",
    f"""WITH c AS ({_CANDIDATES})
        SELECT a.job_id, a.record_id AS record_id_a, b.record_id AS record_id_b, CASE WHEN {_DOM} OR {_LOC} OR {_POL} THEN 'CONFLICT'
               WHEN a.n_domain = b.n_domain AND (a.n_url = b.n_url OR {q.jaccard('a.n_signal', 'b.n_signal')} >= 0.6) THEN 'DUPLICATE' ELSE 'DISTINCT' END AS kind,
               {_DOM} AS domain_differs, {_LOC} AS location_differs, {_POL} AS polarity_differs
        FROM c a JOIN c b ON a.job_id = b.job_id AND a.n_company = b.n_company AND a.n_role = b.n_role AND a.record_id < b.record_id""",
)
def jn2(spark, sf):
    return sg.matches(sg.normalized(spread(signals(spark, sf))))


@query("ag1_resolved_by_source")
def ag1(spark, sf):
    """Records resolved within each source document."""
    jobs = table(spark, sf, "research_jobs", "job_id", "query_text")
    rows = scored(spark, sf)
    asked = table(spark, sf, "signals", "source_document_id", "job_id").groupBy("source_document_id").agg(F.min("job_id").alias("job_id")).join(jobs, "job_id", "left")
    return fold.resolve(rows, "source_document_id", asked.select("source_document_id", "query_text"), NOW)


@query("sk8_resolved_by_job")
def sk8(spark, sf):
    """Records resolved over all sources of each job, as the canonical store keeps them."""
    return fold.resolve(scored(spark, sf), "job_id", table(spark, sf, "research_jobs", "job_id", "query_text"), NOW)


@query("sk8_merged_by_source")
def sk8_merged(spark, sf):
    """The canonical store: each source's records folded and then merged, source after source, into the job's stored ones."""
    return fold.resolve(scored(spark, sf), "job_id", table(spark, sf, "research_jobs", "job_id", "query_text"), NOW, by_source=True)


def same_words(a: dict, b: dict) -> float:
    """A matcher: shared words of the two signals by all their words."""
    x, y = set(a["n_signal"].split()), set(b["n_signal"].split())
    return len(x & y) / len(x | y) if x | y else 1.0


@query("uf1_semantic_matches")
def uf1(spark, sf):
    """Records resolved within each job with a matcher of similar records as a second way to meet."""
    return fold.resolve(scored(spark, sf), "job_id", table(spark, sf, "research_jobs", "job_id", "query_text"), NOW, matcher=same_words, threshold=0.5)


@query(
    "ag3_preferred_record",
    f"""SELECT job_id, dedup_key, record_id FROM ({q.KEYED}) QUALIFY row_number() OVER (PARTITION BY job_id, dedup_key
        ORDER BY (website IS NOT NULL)::INT + (role IS NOT NULL)::INT + (location IS NOT NULL)::INT DESC, coalesce(confidence_score, 0) DESC, record_id) = 1""",
)
def ag3(spark, sf):
    filled = sum(F.col(c).isNotNull().cast("int") for c in ("website", "role", "location"))
    best = F.max(F.struct(filled.alias("f"), F.coalesce("confidence_score", F.lit(0.0)).alias("c"), (-F.col("record_id")).alias("r")))
    return keyed(spark, sf).groupBy("job_id", "dedup_key").agg(best.alias("b")).select("job_id", "dedup_key", (-F.col("b.r")).alias("record_id"))


def _set(c: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list({q.collapsed(c)}))), '|') AS {c}"


@query("ag6_variant_sets", f"SELECT job_id, dedup_key, {_set('company')}, {_set('role')}, {_set('location')} FROM ({q.KEYED}) GROUP BY job_id, dedup_key")
def ag6(spark, sf):
    sets = [F.array_join(F.sort_array(F.collect_set(tx.collapsed(F.col(c)))), "|").alias(c) for c in ("company", "role", "location")]
    out = keyed(spark, sf).groupBy("job_id", "dedup_key").agg(*sets)
    return out.select("job_id", "dedup_key", *[F.when(F.col(c) != "", F.col(c)).otherwise(F.col(c)).alias(c) for c in ("company", "role", "location")])


@query(
    "jn11_merged_attributions",
    f"""SELECT job_id, dedup_key, source_document_id, source_url, max(published_at) AS published_at, max(credibility_score) AS credibility_score, count(DISTINCT evidence) AS evidence
        FROM ({q.KEYED}) GROUP BY ALL""",
)
def jn11(spark, sf):
    """Sources of each key: newest date, greatest credibility, how many different quotes."""
    by = ["job_id", "dedup_key", "source_document_id", "source_url"]
    once = keyed(spark, sf).groupBy(*by, "evidence").agg(F.max("published_at").alias("p"), F.max("credibility_score").alias("c"))
    return once.groupBy(*by).agg(F.max("p").alias("published_at"), F.max("c").alias("credibility_score"), F.count("evidence").alias("evidence"))


@query(
    "ag12_last_value_first_place",
    """WITH k AS (SELECT *, sha256(concat_ws(chr(31), """
    + ", ".join(f"lower({q.trimmed(f'coalesce({c}, {chr(39)}{chr(39)})')})" for c in _FIVE)
    + """)) AS key FROM signals)
        SELECT source_document_id, key, min(record_id) AS first_place, arg_max(record_id, record_id) AS last_record FROM k GROUP BY source_document_id, key""",
)
def ag12(spark, sf):
    key = F.sha2(F.concat_ws("\u001f", *[F.lower(tx.trimmed(F.coalesce(F.col(c), F.lit("")))) for c in _FIVE]), 256)
    return signals(spark, sf).withColumn("key", key).groupBy("source_document_id", "key").agg(F.min("record_id").alias("first_place"), F.max("record_id").alias("last_record"))


@query(
    "ag13_duplicate_counters",
    f"""WITH g AS (SELECT job_id, dedup_key, count(*) AS n, count(DISTINCT source_document_id) AS s FROM ({q.KEYED}) GROUP BY ALL)
        SELECT job_id, sum(n)::BIGINT AS records, count(*) AS canonical, sum(n - s)::BIGINT AS within_source, sum(s - 1)::BIGINT AS across_sources FROM g GROUP BY job_id""",
)
def ag13(spark, sf):
    per_source = keyed(spark, sf).groupBy("job_id", "dedup_key", "source_document_id").agg(F.count(F.lit(1)).alias("n"))
    per_key = per_source.groupBy("job_id", "dedup_key").agg(F.sum("n").alias("n"), F.count("source_document_id").alias("s"))
    return per_key.groupBy("job_id").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("canonical"), F.sum(F.col("n") - F.col("s")).alias("within_source"), F.sum(F.col("s") - 1).alias("across_sources"))


_ISSUES = (
    ("evidence", "NOT contains(t, evidence)"),
    ("company", "NOT contains(lower(t), lower(company))"),
    ("role", "role IS NOT NULL AND NOT contains(lower(t), lower(role))"),
    ("location", "location IS NOT NULL AND NOT contains(lower(t), lower(location))"),
    ("website", f"website IS NOT NULL AND NOT contains(lower(t), lower(website)) AND NOT contains(lower(t), coalesce(nullif({q.host('website')}, ''), lower(website)))"),
)


@query(
    "fl10_grounding_issues",
    "SELECT record_id, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in _ISSUES)
    + "], lambda x: x IS NOT NULL), ',') AS issues FROM signals s JOIN (SELECT source_document_id AS sd, job_id AS sj, raw_content AS t FROM source_documents WHERE raw_content IS NOT NULL) d"
    " ON s.source_document_id = d.sd AND s.job_id = d.sj",
)
def fl10(spark, sf):
    """What of each record its stored page does not mention."""
    pages = table(spark, sf, "source_documents", "source_document_id", "job_id", F.col("raw_content").alias("t")).where("t IS NOT NULL")
    # lowered once a page, before it meets its records
    pages = spread(pages).withColumn("low", F.lower("t"))
    low = F.col("low")
    missing = lambda c: F.col(c).isNotNull() & ~F.contains(low, F.lower(F.col(c)))
    site_host = F.coalesce(F.nullif(ur.host(F.col("website")), F.lit("")), F.lower("website"))
    rules = {"evidence": ~F.contains(F.col("t"), F.col("evidence")), "company": missing("company"), "role": missing("role"), "location": missing("location"), "website": missing("website") & ~F.contains(low, site_host)}
    issues = F.array_join(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])), ",")
    return signals(spark, sf).join(pages, ["source_document_id", "job_id"]).select("record_id", issues.alias("issues"))


@query(
    "fl14_bound_violations",
    f"""SELECT record_id, rule FROM (SELECT record_id, unnest([
        CASE WHEN coalesce(length({q.trimmed('company')}), 0) NOT BETWEEN 1 AND 300 THEN 'company' END, CASE WHEN role IS NOT NULL AND length({q.trimmed('role')}) NOT BETWEEN 1 AND 500 THEN 'role' END,
        CASE WHEN location IS NOT NULL AND length({q.trimmed('location')}) NOT BETWEEN 1 AND 500 THEN 'location' END, CASE WHEN coalesce(length({q.trimmed('signal_text')}), 0) NOT BETWEEN 1 AND 2000 THEN 'signal' END,
        CASE WHEN coalesce(length({q.trimmed('evidence')}), 0) NOT BETWEEN 1 AND 1000 THEN 'evidence' END, CASE WHEN website IS NOT NULL AND NOT ({q.is_web('website')} AND length(website) <= 2048) THEN 'website' END,
        CASE WHEN NOT ({q.is_web('source_url')} AND length(source_url) <= 2048) THEN 'source_url' END, CASE WHEN confidence_score IS NULL OR confidence_score NOT BETWEEN 0 AND 1 THEN 'confidence' END]) AS rule
        FROM signals) WHERE rule IS NOT NULL""",
)
def fl14(spark, sf):
    """Rules of the record schema that each record breaks."""
    c = F.col
    size = lambda name: F.coalesce(tx.utf16_length(tx.trimmed(c(name))), F.lit(0))
    web = lambda name: ur.is_web(c(name)) & (F.length(c(name)) <= ur.LONGEST)
    rules = {
        "company": ~size("company").between(1, 300), "role": c("role").isNotNull() & ~size("role").between(1, 500), "location": c("location").isNotNull() & ~size("location").between(1, 500),
        "signal": ~size("signal_text").between(1, 2000), "evidence": ~size("evidence").between(1, 1000), "website": c("website").isNotNull() & ~web("website"), "source_url": ~web("source_url"),
        "confidence": c("confidence_score").isNull() | ~c("confidence_score").between(0, 1),
    }
    return signals(spark, sf).select("record_id", F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))).alias("rule"))


def _csv(x: str) -> str:
    v = f"coalesce(({x})::VARCHAR, '')"
    safe = f"CASE WHEN regexp_matches({v}, '^[\\t \\r]*[=+\\-@]') THEN '''' || {v} ELSE {v} END"
    return f"CASE WHEN regexp_matches({safe}, '[\",\\n\\r]') THEN '\"' || replace({safe}, '\"', '\"\"') || '\"' ELSE {safe} END"


_CSV = ("company", "role", "location", "signal_text", "relevance_text", "confidence_text", "source_url", "evidence")
_HEADER = "company,role,location,signal,relevanceScore,confidenceScore,sourceUrl,evidence"
_NUMBERS = "regexp_replace(relevance::VARCHAR, '\\.0$', '') AS relevance_text, regexp_replace(confidence_score::VARCHAR, '\\.0$', '') AS confidence_text"


@query("sk15_csv_lines", f"SELECT record_id, {' || chr(44) || '.join(_csv(c) for c in _CSV)} AS line FROM (SELECT *, {_NUMBERS} FROM ({q.scored('query_text')})) UNION ALL SELECT 0, '{_HEADER}'")
def sk15(spark, sf):
    """The lines of the export, eight columns, the header under the id 0; whole numbers come without a point."""
    number = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    rows = scored(spark, sf).withColumns({"relevance_text": number("relevance"), "confidence_text": number("confidence_score")})
    header = spark.range(1).select(F.col("id").alias("record_id"), F.lit(_HEADER).alias("line"))
    return rows.select("record_id", F.concat_ws(",", *[tx.csv_field(F.col(c)) for c in _CSV]).alias("line")).unionByName(header)


@query(
    "sk9_replaced_by_source",
    """WITH fresh AS (SELECT record_id + 1000000000 AS record_id, source_document_id, company FROM signals WHERE source_document_id % 2 = 0 AND confidence_score >= 0.8),
        kept AS (SELECT record_id, source_document_id, company FROM signals WHERE source_document_id NOT IN (SELECT source_document_id FROM fresh))
        SELECT * FROM kept UNION ALL SELECT * FROM fresh""",
)
def sk9(spark, sf):
    """A batch replaces all stored records of its sources (the batch: sure records of the even sources)."""
    stored = signals(spark, sf, "record_id", "source_document_id", "company", "confidence_score")
    fresh = stored.where("source_document_id % 2 = 0 AND confidence_score >= 0.8").select((F.col("record_id") + 1_000_000_000).alias("record_id"), "source_document_id", "company")
    kept = stored.drop("confidence_score").where("source_document_id IS NOT NULL").join(fresh.select("source_document_id").distinct(), "source_document_id", "left_anti")
    return kept.select("record_id", "source_document_id", "company").unionByName(fresh)


@query(
    "pj1_result_rows",
    f"""SELECT record_id, to_json({{'company': company, 'role': role, 'location': location}}) AS structured, to_json({{'url': d.source_url, 'normalizedUrl': normalized_url, 'domain': domain, 'title': title}}) AS source,
        strftime(s.created_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at, coalesce(confidence_score BETWEEN 0 AND 1, false) AND coalesce({q.trimmed('evidence')} <> '', false) AS valid
        FROM signals s JOIN source_documents d ON s.source_document_id = d.source_document_id AND s.job_id = d.job_id""",
)
def pj1(spark, sf):
    """Result rows with nested fields and source, nulls written out, and whether they pass what was checked when they were stored."""
    written = {"ignoreNullFields": "false"}
    source = F.to_json(F.struct(F.col("source_url").alias("url"), F.col("normalized_url").alias("normalizedUrl"), "domain", "title"), written)
    sources = table(spark, sf, "source_documents", "source_document_id", "job_id", "source_url", "normalized_url", "domain", "title").select("source_document_id", "job_id", source.alias("source"))
    valid = F.coalesce(F.col("confidence_score").between(0, 1), F.lit(False)) & F.coalesce(tx.trimmed(F.col("evidence")) != "", F.lit(False))
    rows = signals(spark, sf, "record_id", "job_id", "source_document_id", "company", "role", "location", "created_at", "confidence_score", "evidence").join(sources, ["source_document_id", "job_id"])
    return rows.select("record_id", F.to_json(F.struct("company", "role", "location"), written).alias("structured"), "source", tx.iso_time(F.col("created_at")).alias("created_at"), valid.alias("valid"))


_MATCHED = f"list_filter({q.tokens_in_order('query_text')}, lambda t: list_contains({q.tokens(q.FIELDS_TEXT)}, t))"


@query(
    "st2_score_reasons",
    f"""SELECT record_id, CASE WHEN len({q.tokens_in_order('query_text')}) = 0 THEN 'The query contains no scorable keywords.' ELSE len({_MATCHED}) || ' of ' || len({q.tokens_in_order('query_text')}) || ' query keywords matched: ' || coalesce(nullif(array_to_string({_MATCHED}, ', '), ''), 'none') || '.' END AS keywords,
        CASE WHEN published_at IS NULL THEN 'No reliable publication timestamp was available; neutral freshness applied.'
             ELSE 'Newest source publication is approximately ' || floor(greatest(0.0, (epoch_us(TIMESTAMPTZ '{q.NOW}+00') - epoch_us(published_at)) / 86400000000.0))::BIGINT || ' days old.' END AS freshness,
        'Evidence company=' || coalesce(contains(lower(evidence), lower(company)), false) || ', role=' || coalesce(role IS NULL OR contains(lower(evidence), lower(role)), false) || ', hiring-language=' || coalesce(regexp_matches(lower(evidence), '{q.words(tx.HIRING_VERBS)}'), false) || '.' AS directness
        FROM signals s LEFT JOIN (SELECT job_id AS qj, query_text FROM research_jobs) j ON s.job_id = j.qj""",
)
def st2(spark, sf):
    """Why each record scores as it does: the words of the query it holds, in the query's order, the age of its source, what its evidence says."""
    rows = signals(spark, sf).join(table(spark, sf, "research_jobs", "job_id", "query_text"), "job_id", "left")
    return rows.select("record_id", *[v.alias(k) for k, v in sc.reasons(F.col("query_text"), F.lit(q.NOW + "+00:00").cast("timestamp")).items()])
