"""Fragments of the DuckDB SQL that checks the queries: the same definitions, spelt for that engine."""

from __future__ import annotations

from millrace.functions import text as tx
from millrace.functions import url as ur

SP = tx.SPACE
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
NARROW = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
SEP = "chr(31)"


def nfkc(x: str) -> str:
    """NFKC of texts whose only compatible letters are the full-width ones (true of the test tables)."""
    return f"translate({x}, '{WIDE}', '{NARROW}')"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SP}+', ' ', 'g'))"


def collapsed(x: str) -> str:
    return squeezed(nfkc(x))


def matching(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({collapsed(x)}), '&', ' and ', 'g'), '[^\\p{{L}}\\p{{N}}+#.]+', ' ', 'g'))"


def words(names: tuple[str, ...]) -> str:
    return rf"\b(?:{'|'.join(names)})\b"


def company(x: str) -> str:
    base = f"trim(regexp_replace({matching(x)}, ' and company$', ''))"
    return rf"trim(regexp_replace({base}, '(?: *\b(?:{'|'.join(tx.LEGAL_FORMS)})\b\.? *)+$', ''))"


def role(x: str) -> str:
    base = rf"regexp_replace(regexp_replace(regexp_replace({matching(x)}, '\b(?:sr|snr)\b', 'senior', 'g'), '\b(?:jr)\b', 'junior', 'g'), '\b(?:back end)\b', 'backend', 'g')"
    return (
        rf"CASE WHEN {x} IS NULL THEN '' WHEN regexp_matches({base}, '\bbackend\b') AND regexp_matches({base}, '\b(?:developer|software engineer|engineer)\b') "
        rf"THEN trim(regexp_extract({base}, '\b(senior|junior|lead|principal)\b', 1) || ' backend engineer') ELSE {base} END"
    )


def place(x: str) -> str:
    return f"coalesce({matching(x)}, '')"


SHAPE = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]/?#]*\]|[^:/?#\[\]]*)(?::(\d*))?(/[^?#]*)?(?:\?([^#]*))?(?:#.*)?$"


def part(x: str, n: int) -> str:
    return f"regexp_extract({x}, '{SHAPE}', {n})"


def host(x: str) -> str:
    return f"lower({part(x, 3)})"


def is_web(x: str) -> str:
    return f"coalesce(lower({part(x, 1)}) IN ('http', 'https') AND {part(x, 3)} <> '' AND {part(x, 2)} = '', false)"


def canonical(x: str, drop_tracking: bool = True) -> str:
    t = trimmed(x)
    pairs = f"list_filter(string_split({part(t, 6)}, '&'), lambda p: p <> '')"
    if drop_tracking:
        names = ", ".join(f"'{n}'" for n in ur.TRACKING)
        pairs = f"list_filter({pairs}, lambda p: NOT (starts_with(lower(split_part(p, '=', 1)), 'utm_') OR lower(split_part(p, '=', 1)) IN ({names})))"
    keyed = f"list_sort(list_transform({pairs}, lambda p, i: {{'k': split_part(p, '=', 1), 'i': i, 'p': CASE WHEN contains(p, '=') THEN p ELSE p || '=' END}}))"
    query = f"coalesce(array_to_string(list_transform({keyed}, lambda s: s.p), '&'), '')"
    scheme, port, path = f"lower({part(t, 1)})", part(t, 4), part(t, 5)
    return (
        f"CASE WHEN {is_web(t)} THEN {scheme} || '://' || {host(t)} || CASE WHEN {port} = '' OR ({scheme} = 'https' AND {port} = '443') OR ({scheme} = 'http' AND {port} = '80') THEN '' ELSE ':' || {port} END"
        f" || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END END"
    )


def domain(website: str, source: str) -> str:
    w, s = trimmed(website), trimmed(source)
    return f"regexp_replace(coalesce(CASE WHEN {is_web(w)} THEN {host(w)} END, {host(s)}), '^www\\.', '')"


def tokens(x: str) -> str:
    """Distinct words, sorted: for comparing sets."""
    stop = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
    return f"list_sort(list_distinct(list_filter(regexp_split_to_array(lower({nfkc(x)}), '[^\\p{{L}}\\p{{N}}+#.]+'), lambda t: length(t) >= 2 AND t NOT IN ({stop}))))"


FIELDS_TEXT = "concat_ws(' ', coalesce(company, ''), coalesce(website, ''), coalesce(role, ''), coalesce(location, ''), coalesce(signal_text, ''), coalesce(evidence, ''))"


def tokens_in_order(x: str) -> str:
    """Distinct words in the order of their first place."""
    stop = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
    found = f"list_filter(regexp_split_to_array(lower(coalesce({nfkc(x)}, '')), '[^\\p{{L}}\\p{{N}}+#.]+'), lambda t: length(t) >= 2 AND t NOT IN ({stop}))"
    return f"list_filter({found}, lambda t, i: list_position({found}, t) = i)"


def rounded(x: str) -> str:
    return f"(floor(({x}) * 1e6 + 0.5) / 1e6)"


def negative(x: str) -> str:
    return f"regexp_matches({x}, '{words(tx.NEGATIVE_PHRASES)}')"


def jaccard(a: str, b: str) -> str:
    x, y = (f"list_distinct(list_filter(string_split({v}, ' '), lambda t: t <> ''))" for v in (a, b))
    return f"CASE WHEN len(list_distinct(list_concat({x}, {y}))) = 0 THEN 1.0 ELSE len(list_intersect({x}, {y})) * 1.0 / len(list_distinct(list_concat({x}, {y}))) END"


def readable(x: str) -> str:
    lines = f"list_filter(list_transform(regexp_split_to_array({x}, '\\n+'), lambda l: {squeezed('l')}), lambda l: l <> '')"
    return f"array_to_string(list_filter({lines}, lambda l, i: list_position(list_transform({lines}, lambda k: lower(k)), lower(l)) = i), chr(10))"


NORMALIZED = f"""
    SELECT *, {company('company')} AS n_company, {role('role')} AS n_role, {canonical('source_url')} AS n_url, {domain('website', 'source_url')} AS n_domain,
           {place('location')} AS n_location, {matching('signal_text')} AS n_signal FROM signals
"""
KEYED = f"""
    SELECT *, sha256(concat_ws({SEP}, dedup_key, n_location, n_signal, n_url)) AS conflict_key
    FROM (SELECT *, sha256(concat_ws({SEP}, n_company, n_role, n_domain, n_url)) AS dedup_key FROM ({NORMALIZED}))
"""
#: Fixed value: the time that counts as now.
NOW = "2026-07-01 00:00:00"


def scored(query: str) -> str:
    """The keyed records with their rounded components and relevance; ``query`` is a SQL expression."""
    fields = "concat_ws(' ', coalesce(company, ''), coalesce(website, ''), coalesce(role, ''), coalesce(location, ''), coalesce(signal_text, ''), coalesce(evidence, ''))"
    filled = " + ".join(f"coalesce(({trimmed(c)} <> '')::INT, 0)" for c in ("company", "website", "role", "location", "signal_text", "source_url", "evidence"))
    days = f"greatest(0.0, (epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(published_at)) / 86400000000.0)"
    clamp = lambda x: f"least(1.0, greatest(0.0, {x}))"
    verbs = words(tx.HIRING_VERBS)
    parts = {
        "keyword_overlap": f"CASE WHEN len({tokens(query)}) = 0 THEN 0.0 ELSE len(list_intersect({tokens(query)}, {tokens(fields)})) * 1.0 / len({tokens(query)}) END",
        "completeness": f"({filled}) / 7.0",
        "confidence": clamp("confidence_score"),
        "freshness": f"CASE WHEN published_at IS NULL THEN 0.5 WHEN {days} <= 30 THEN 1.0 WHEN {days} <= 90 THEN 0.8 WHEN {days} <= 180 THEN 0.6 WHEN {days} <= 365 THEN 0.4 ELSE 0.2 END",
        "credibility": f"coalesce(CASE WHEN credibility_score IS NOT NULL THEN {clamp('credibility_score')} END, CASE WHEN website IS NOT NULL AND regexp_replace({host('source_url')}, '^www\\.', '') = n_domain THEN 0.9 "
        f"WHEN lower({part('source_url', 1)}) = 'https' THEN 0.7 ELSE 0.5 END)",
        "directness": f"CASE WHEN contains(lower(evidence), lower(company)) THEN 0.3 ELSE 0.0 END + CASE WHEN role IS NULL OR contains(lower(evidence), lower(role)) THEN 0.25 ELSE 0.0 END "
        f"+ CASE WHEN regexp_matches(lower(evidence), '{verbs}') THEN 0.35 ELSE 0.0 END + CASE WHEN evidence IS NOT NULL THEN 0.1 ELSE 0.0 END",
    }
    from millrace.functions.score import WEIGHTS

    inner = ", ".join(f"({v})::DOUBLE AS raw_{k}" for k, v in parts.items())
    outer = ", ".join(f"{rounded(f'raw_{k}')} AS {k}" for k in parts)
    total = " + ".join(rounded(f"{rounded(f'raw_{k}')} * {WEIGHTS[k]}") for k in parts)
    return f"SELECT *, {outer}, {rounded(total)} AS relevance FROM (SELECT k.*, {inner} FROM ({KEYED}) k LEFT JOIN (SELECT job_id AS qj, query_text FROM research_jobs) q ON k.job_id = q.qj)"
