"""Queries of this package's operators over the whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import p01_names, p02_residue, p03_survivor, p04_split, p05_canonical, p06_boilerplate, p07_lines, p08_tokens, p09_leaks, p10_toxic
from millrace.sources import spread, table


NAMES = ("record_id", "job_id", "company", "website")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p01_names.variant_pairs(table(spark, sf_dir, "signals", *NAMES))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p01_names.clusters(table(spark, sf_dir, "signals", *NAMES))


RESULTS = ("result_id", "final_url", "title", "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p02_residue.residual_results(spread(table(spark, sf_dir, "extraction_results", *RESULTS)))


def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p02_residue.residue(spread(table(spark, sf_dir, "extraction_results", *RESULTS)))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p02_residue.clean_results(spread(table(spark, sf_dir, "extraction_results", *RESULTS))).select("result_id", "title", "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p03_survivor.dominant_records(table(spark, sf_dir, "signals"))


def p3_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p03_survivor.survivors(table(spark, sf_dir, "signals"))


def p3_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p03_survivor.survivors(table(spark, sf_dir, "signals")).select("job_id", "deduplication_key", "members", "leads")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p04_split.oversized(spread(table(spark, sf_dir, "extraction_inputs")), table(spark, sf_dir, "chunking_configurations"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p04_split.split_inputs(spread(table(spark, sf_dir, "extraction_inputs")), table(spark, sf_dir, "chunking_configurations"))


def p4_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p04_split.piece_checks(spread(table(spark, sf_dir, "extraction_inputs")), table(spark, sf_dir, "chunking_configurations"))


def _typed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        table(spark, sf_dir, "signals", "record_id", "role", "location"),
        table(spark, sf_dir, "canonical_roles", "role_id", "role_name", "aliases"),
        table(spark, sf_dir, "canonical_locations", "location_id", "city", "province", "country", "aliases"),
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p05_canonical.map_values(*_typed(spark, sf_dir))


def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p05_canonical.unmatched_values(*_typed(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p06_boilerplate.boilerplate_lines(spread(table(spark, sf_dir, "source_documents")), spread(table(spark, sf_dir, "extraction_results")))


def p6_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p06_boilerplate.main_bodies(spread(table(spark, sf_dir, "source_documents")), spread(table(spark, sf_dir, "extraction_results")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p07_lines.repeated_lines(spread(table(spark, sf_dir, "source_documents")))


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p07_lines.without_repeated_lines(spread(table(spark, sf_dir, "source_documents")))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p08_tokens.encode_documents(spread(table(spark, sf_dir, "documents")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p09_leaks.leaked_items(spread(table(spark, sf_dir, "documents", "doc_id", "text")), table(spark, sf_dir, "benchmark", "item_id", "text"))


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p09_leaks.leak_counts(p9_found(spark, sf_dir))


def p9_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p09_leaks.leak_evidence(spread(table(spark, sf_dir, "documents", "doc_id", "text")), table(spark, sf_dir, "benchmark", "item_id", "text"))


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spread(table(spark, sf_dir, "documents", "doc_id", "source", "text")), table(spark, sf_dir, "labels", "doc_id", "toxic")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_toxic.toxic_documents(*_labelled(spark, sf_dir))


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _labelled(spark, sf_dir)
    return p10_toxic.score_documents(documents, p10_toxic.train(documents, labels))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_toxic.source_rates(*_labelled(spark, sf_dir))


QUERIES = {
    "p1_found": p1_found,
    "p1_clusters": p1_clusters,
    "p2_found": p2_found,
    "p2_reasons": p2_reasons,
    "p2_clean": p2_clean,
    "p3_found": p3_found,
    "p3_survivors": p3_survivors,
    "p3_leads": p3_leads,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p4_checks": p4_checks,
    "p5_found": p5_found,
    "p5_unmatched": p5_unmatched,
    "p6_found": p6_found,
    "p6_bodies": p6_bodies,
    "p7_found": p7_found,
    "p7_cleaned": p7_cleaned,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_items": p9_items,
    "p9_evidence": p9_evidence,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rates": p10_rates,
}

def _p5_sql() -> str:
    """The mapping without pigeonholes: every typed value against every form, the closest one within the edits allowed."""
    m = p05_canonical
    word = lambda x: (
        f"trim(regexp_replace(regexp_replace(translate(lower({x}), '{m.ACCENTED}', '{m.PLAIN}'), '&', ' and ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    )
    words = ", ".join(f"'{w}': ['{w}', {', '.join(repr(x) for x in a)}]" for w, a in m.WORD_FORMS.items())
    phrases = ", ".join(f"{{'p': '{p}', 'a': '{a}'}}" for p, a in m.PHRASE_FORMS.items())
    edits = m.edits_sql("length(f.form)")
    return f"""
        WITH entries AS (
            SELECT 'role' AS field, role_id AS ref_id, 1 AS plain, role_name AS name FROM canonical_roles
            UNION ALL SELECT 'role', role_id, 0, unnest(aliases) FROM canonical_roles
            UNION ALL SELECT 'location', location_id, 1, city FROM canonical_locations
            UNION ALL SELECT 'location', location_id, 0, unnest(aliases) FROM canonical_locations),
        named AS (SELECT field, ref_id, plain, {word("name")} AS name FROM entries WHERE name IS NOT NULL),
        phrased AS (
            SELECT field, ref_id, plain, unnest(list_distinct(list_concat([name], list_transform(list_filter([{phrases}], lambda x: contains(name, x.p)), lambda x: replace(name, x.p, x.a))))) AS name FROM named),
        spelt AS (
            SELECT field, ref_id, plain, unnest(list_reduce(list_transform(string_split(name, ' '), lambda w: coalesce(MAP {{{words}}}[w], [w])),
                   lambda acc, alts: flatten(list_transform(acc, lambda a: list_transform(alts, lambda x: a || ' ' || x))))) AS name FROM phrased),
        ordered AS (SELECT field, ref_id, plain, unnest([trim(name), regexp_replace(trim(name), '^(.*) ([^ ]+)$', '\\2 \\1')]) AS name FROM spelt),
        base AS (SELECT field, ref_id, max(plain) AS plain, replace(name, ' ', '') AS form FROM ordered WHERE replace(name, ' ', '') <> '' GROUP BY ALL),
        around AS (
            SELECT location_id, replace({word("country")}, ' ', '') AS c, replace(regexp_replace({word("province")}, '\\bprovince\\b', '', 'g'), ' ', '') AS p FROM canonical_locations),
        spread AS (
            SELECT field, ref_id, plain, unnest([form, form || c, c || form, c || form || c, form || left(c, 3), form || p, p || form, form || p || c]) AS form FROM base JOIN around ON ref_id = location_id WHERE field = 'location'),
        forms AS (SELECT field, ref_id, max(plain) AS plain, form FROM (SELECT * FROM base WHERE field = 'role' UNION ALL SELECT field, ref_id, plain, form FROM spread WHERE form IS NOT NULL) GROUP BY ALL),
        typed AS (
            SELECT record_id, 'role' AS field, role AS value FROM signals WHERE role IS NOT NULL AND regexp_matches(role, '\\S')
            UNION ALL SELECT record_id, 'location', location FROM signals WHERE location IS NOT NULL AND regexp_matches(location, '\\S')),
        cleaned AS (
            SELECT field, value, trim(CASE WHEN field = 'role' THEN regexp_replace({word("value")}, '{m.ROLE_REMARKS}', ' ', 'g') ELSE regexp_replace({word("value")}, '{m.PLACE_REMARKS}', ' ', 'g') END) AS words
            FROM (SELECT DISTINCT field, value FROM typed)),
        glued AS (
            SELECT DISTINCT field, value, replace(unnest(CASE WHEN field = 'role' THEN [words, regexp_replace(words, '{m.ROLE_RANKS}', ''), regexp_replace(words, '{m.ROLE_RANKS}|s$', '', 'g')] ELSE [words] END), ' ', '') AS typed FROM cleaned),
        hits AS (
            SELECT g.field, g.value, f.ref_id, levenshtein(g.typed, f.form) AS d, f.plain FROM (SELECT * FROM glued WHERE typed <> '') g JOIN forms f ON g.field = f.field AND abs(length(g.typed) - length(f.form)) <= 5
            WHERE levenshtein(g.typed, f.form) <= {edits}),
        best AS (SELECT field, value, ref_id FROM hits QUALIFY row_number() OVER (PARTITION BY field, value ORDER BY d, plain DESC, ref_id) = 1)
        SELECT DISTINCT record_id, t.field, coalesce(b.ref_id, -1) AS ref_id FROM typed t LEFT JOIN best b ON t.field = b.field AND t.value = b.value
    """


SQL = {
    "p5_found": _p5_sql(),
    "p3_found": r"""
        WITH r AS (
            SELECT job_id, deduplication_key AS k, record_id, coalesce(credibility_score, -1) AS c,
                   coalesce(epoch_us(published_at), -1) AS p, coalesce(confidence_score, -1) AS f,
                   (coalesce(trim(website, E' \t\n\r'), '') <> '')::INT + (coalesce(trim(role, E' \t\n\r'), '') <> '')::INT
                   + (coalesce(trim(location, E' \t\n\r'), '') <> '')::INT AS n
            FROM signals WHERE job_id IS NOT NULL AND deduplication_key IS NOT NULL)
        SELECT a.record_id FROM r a JOIN r b ON a.job_id = b.job_id AND a.k = b.k AND a.record_id <> b.record_id
        GROUP BY a.record_id
        HAVING bool_and(a.c >= b.c AND a.p >= b.p AND a.f >= b.f AND a.n >= b.n AND (a.c > b.c OR a.p > b.p OR a.f > b.f OR a.n > b.n))
    """,
    "p3_leads": r"""
        WITH r AS (
            SELECT job_id, deduplication_key, coalesce(credibility_score, -1) AS c, coalesce(epoch_us(published_at), -1) AS p, coalesce(confidence_score, -1) AS f,
                   (coalesce(trim(website, E' \t\n\r'), '') <> '')::INT + (coalesce(trim(role, E' \t\n\r'), '') <> '')::INT + (coalesce(trim(location, E' \t\n\r'), '') <> '')::INT AS n
            FROM signals WHERE job_id IS NOT NULL AND deduplication_key IS NOT NULL),
        m AS (SELECT *, max(c) OVER g AS mc, max(p) OVER g AS mp, max(f) OVER g AS mf, max(n) OVER g AS mn FROM r WINDOW g AS (PARTITION BY job_id, deduplication_key))
        SELECT job_id, deduplication_key, count(*) AS members, count(*) FILTER (WHERE c = mc AND p = mp AND f = mf AND n = mn) = 1 AS leads
        FROM m GROUP BY job_id, deduplication_key HAVING count(*) > 1
    """,
    "p4_found": r"""
        SELECT i.input_id FROM extraction_inputs i JOIN chunking_configurations c ON i.config_id = c.config_id
        WHERE length(i.source_text) + length(regexp_replace(i.source_text, '[^\x{10000}-\x{10FFFF}]', '', 'g')) > c.max_chunk_characters
    """,
    "p4_checks": r"""
        SELECT i.input_id, md5(i.source_text) AS pieces_join, true AS within_limit, true AS overlap_kept,
               length(i.source_text) + length(regexp_replace(i.source_text, '[^\x{10000}-\x{10FFFF}]', '', 'g')) > c.max_chunk_characters AS several
        FROM extraction_inputs i JOIN chunking_configurations c ON i.config_id = c.config_id WHERE i.source_text IS NOT NULL AND c.max_chunk_characters IS NOT NULL
    """,
    "p7_found": r"""
        WITH l AS (
            SELECT source_document_id, domain, unnest(string_split(raw_content, chr(10))) AS line,
                   generate_subscripts(string_split(raw_content, chr(10)), 1) - 1 AS line_no
            FROM source_documents WHERE raw_content IS NOT NULL AND domain IS NOT NULL),
        k AS (SELECT *, lower(regexp_replace(line, '[^\p{L}\p{M}]+', '', 'g')) AS letters FROM l),
        f AS (SELECT domain, letters FROM k WHERE letters <> '' GROUP BY ALL HAVING count(DISTINCT source_document_id) >= 8)
        SELECT source_document_id, line_no::BIGINT AS line_no FROM k JOIN f USING (domain, letters)
    """,
}

