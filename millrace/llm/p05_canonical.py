"""Freely typed roles and locations mapped to the entries of a reference list, in SQL only.

Each reference entry is spelt out in the forms people type (aliases, usual abbreviations, the
last word put first; for places the country, its short code or the province beside the town).
A form of length L may differ from a typed value by up to k(L) edits. Pigeonhole: a form is
cut into k + 1 segments; a value within k edits holds at least one of them unchanged, at a
place that the edits before and behind it bound, so an equality join on (length, number of
the segment, substring) over just these lengths and places finds every such pair. The
built-in levenshtein verifies; the value goes to the closest entry. Values without an entry are reported as -1 by an anti-join.

Only distinct values are matched, so a value that a third of the rows share costs one row;
values equal to a form leave the work before the segments are made.

Defined results: null and blank values give no row; remarks on rank, working time, number of
posts and team are set aside, as are words for the surroundings of a town; equally close
entries go to the one whose plain name is closer, then to the smaller id; null reference names
and aliases are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.llm.common import durable, narrow

#: Letters with accents and look-alikes, and what they stand for.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýаеорсухіѕ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyaeopcyxis"
#: Usual abbreviations of single words.
WORD_FORMS = {
    "engineer": ["engr", "eng"], "engineering": ["eng"], "manager": ["mgr", "mngr"], "administrator": ["admin"], "officer": ["offr", "off"],
    "developer": ["dev"], "development": ["dev"], "analyst": ["anlst", "an"], "assistant": ["asst"], "technician": ["techn", "tech"],
    "technical": ["tech"], "representative": ["rep"], "specialist": ["splst", "spec"], "electrical": ["elec"], "mechanical": ["mech"],
    "environmental": ["env"], "programme": ["prog", "program"], "research": ["rsrch", "res"], "supervisor": ["supv", "superv"],
    "secondary": ["sec"], "university": ["univ"], "coordinator": ["coord", "co ordinator"], "operations": ["ops"], "backend": ["bknd", "back end"],
    "frontend": ["fe", "front end"], "laboratory": ["lab"], "production": ["prod"], "accountant": ["acct"], "executive": ["exec"],
    "communications": ["comms"], "maintenance": ["maint"], "professional": ["prof"], "director": ["dir"], "consultant": ["cons"],
    "port": ["pt"], "new": ["nw"], "north": ["n"], "mount": ["mt"], "upper": ["upr"], "saint": ["st"], "south": ["s"], "east": ["e"], "west": ["w"],
    "on": ["o"],
}
#: Usual short forms of phrases.
PHRASE_FORMS = {
    "quality assurance": "qa", "user experience": "ux", "human resources": "hr", "public relations": "pr", "machine learning": "ml",
    "site reliability engineer": "sre", "chief technology officer": "cto", "chief financial officer": "cfo", "database administrator": "dba",
    "health and safety": "h and s", "sales development representative": "sdr", "research and development": "rnd",
}
#: Remarks beside a role or a place.
ROLE_REMARKS = r"\bm f d\b|\b(?:part|full) time\b|\b(?:temp|remote|wanted|x\d+|i{2,3}|hybrid)\b|\b[^ ]+ team *$"
ROLE_RANKS = r"^ *(?:(?:senior|snr|sr|junior|jr|lead|principal|deputy) +)+"
PLACE_REMARKS = r"\band surroundings\b|\bcity centre\b|^ *(?:near|region|greater)\b|\barea *$|\bhybrid\b|\bprovince\b|\b\d{4,6}\b"


def edits_sql(length: str) -> str:
    """Edits allowed for a form of a length; short codes must be equal."""
    return f"CASE WHEN {length} <= 3 THEN 0 WHEN {length} <= 5 THEN 1 WHEN {length} <= 9 THEN 2 WHEN {length} <= 13 THEN 3 WHEN {length} <= 19 THEN 4 ELSE 5 END"


def words_sql(value: str) -> str:
    """Lower case, plain letters, words apart by one space."""
    return (
        f"trim(regexp_replace(regexp_replace(translate(lower({value}), '{ACCENTED}', '{PLAIN}'), '&', ' and '),"
        " '[^\\\\p{{L}}\\\\p{{N}}]+', ' '))"
    )


def pattern_sql(pattern: str) -> str:
    """A regular expression inside a SQL string that is formatted with named frames."""
    return pattern.replace("\\", "\\\\").replace("{", "{{").replace("}", "}}")


def forms(entries: DataFrame) -> DataFrame:
    """(field, ref_id, plain, form): the glued forms of (field, ref_id, plain, name) entries."""
    words = ", ".join(f"'{w}', array({', '.join(repr(x) for x in a)})" for w, a in WORD_FORMS.items())
    phrases = ", ".join(f"named_struct('p', '{p}', 'a', '{a}')" for p, a in PHRASE_FORMS.items())
    return entries.sparkSession.sql(
        f"""
        WITH named AS (SELECT field, ref_id, plain, {words_sql("name")} AS name FROM {{entries}} WHERE name IS NOT NULL AND ref_id IS NOT NULL),
        phrased AS (
            SELECT field, ref_id, plain, explode(array_distinct(concat(array(name),
                   transform(filter(array({phrases}), x -> contains(name, x.p)), x -> replace(name, x.p, x.a))))) AS name FROM named),
        spelt AS (
            SELECT field, ref_id, plain, explode(aggregate(split(name, ' '), array(''), (acc, w) -> flatten(transform(acc, a ->
                   transform(concat(array(w), coalesce(try_element_at(map({words}), w), array())), x -> concat(a, ' ', x)))))) AS name FROM phrased),
        ordered AS (
            SELECT field, ref_id, plain, explode(array(trim(name), regexp_replace(trim(name), '^(.*) ([^ ]+)$', '$2 $1'))) AS name FROM spelt)
        SELECT field, ref_id, max(plain) AS plain, replace(name, ' ', '') AS form FROM ordered
        WHERE replace(name, ' ', '') <> '' GROUP BY field, ref_id, replace(name, ' ', '')
        """,
        entries=entries,
    )


def role_forms(roles: DataFrame) -> DataFrame:
    entries = roles.sparkSession.sql(
        """SELECT 'role' AS field, role_id AS ref_id, role_name AS name, 1 AS plain FROM {roles}
           UNION ALL SELECT 'role', role_id, a, 0 FROM {roles} LATERAL VIEW explode(aliases) AS a""",
        roles=roles,
    )
    return forms(entries)


def place_forms(places: DataFrame) -> DataFrame:
    """Towns alone, and with country, country code or province before or behind them."""
    spark = places.sparkSession
    towns = spark.sql(
        """SELECT 'location' AS field, location_id AS ref_id, city AS name, 1 AS plain FROM {places}
           UNION ALL SELECT 'location', location_id, a, 0 FROM {places} LATERAL VIEW explode(aliases) AS a""",
        places=places,
    )
    town_forms = forms(towns)
    return spark.sql(
        f"""
        WITH around AS (
            SELECT location_id, replace({words_sql("country")}, ' ', '') AS country,
                   replace(regexp_replace({words_sql("province")}, '\\\\bprovince\\\\b', ''), ' ', '') AS province FROM {{places}}),
        -- what stands beside a town that entries share tells them apart; the town alone goes to the smallest id
        spread AS (
            SELECT t.field, t.ref_id, t.plain, t.form, explode(filter(array(t.form, t.form || country, country || t.form, country || t.form || country,
                   t.form || left(country, 3), t.form || province, province || t.form, t.form || province || country), x -> x IS NOT NULL)) AS full
            FROM {{town_forms}} t JOIN around a ON t.ref_id = a.location_id)
        SELECT field, ref_id, max(plain) AS plain, full AS form FROM spread GROUP BY field, ref_id, full
        """,
        places=places,
        town_forms=town_forms,
    )


def reference_forms(roles: DataFrame, places: DataFrame) -> DataFrame:
    """All forms of both lists, written once: their number follows the lists, not the records."""
    return durable(role_forms(roles).unionByName(place_forms(places)))


def typed_values(records: DataFrame) -> DataFrame:
    """(record_id, field, value) of the values that are neither null nor blank."""
    return records.sparkSession.sql(
        """SELECT record_id, field, value FROM {records}
           LATERAL VIEW stack(2, 'role', role, 'location', location) AS field, value
           WHERE value IS NOT NULL AND value RLIKE '(?U)[^\\\\s]'""",
        records=narrow(records, record_id="record_id", role="role", location="location"),
    )


def mapped_values(values: DataFrame, all_forms: DataFrame) -> DataFrame:
    """(field, value, ref_id, distance) of each distinct value that has an entry."""
    spark = values.sparkSession
    glued = spark.sql(
        f"""
        WITH d AS (SELECT DISTINCT field, value FROM {{values}}),
        w AS (SELECT field, value, {words_sql("value")} AS words FROM d),
        r AS (
            SELECT field, value, trim(regexp_replace(words, CASE WHEN field = 'role' THEN '{pattern_sql(ROLE_REMARKS)}'
                   ELSE '{pattern_sql(PLACE_REMARKS)}' END, ' ')) AS words FROM w)
        SELECT DISTINCT field, value, replace(form, ' ', '') AS typed FROM r
        LATERAL VIEW explode(CASE WHEN field = 'role' THEN array(words, regexp_replace(words, '{pattern_sql(ROLE_RANKS)}', ''),
               regexp_replace(words, '{pattern_sql(ROLE_RANKS)}|s$', '')) ELSE array(words) END) AS form
        WHERE replace(form, ' ', '') <> ''
        """,
        values=values,
    )
    # each of these is read several times below; written once, they keep the plan small
    glued = durable(glued)
    return spark.sql(
        f"""
        WITH forms AS (SELECT field, ref_id, plain, form, length(form) AS l, {edits_sql("length(form)")} AS k FROM {{all_forms}}),
        typed AS (SELECT DISTINCT field, typed, length(typed) AS l FROM {{glued}}),
        same AS (SELECT t.field, t.typed, f.ref_id, f.plain, 0 AS distance FROM typed t JOIN forms f ON t.field = f.field AND t.typed = f.form),
        rest AS (SELECT t.* FROM typed t LEFT ANTI JOIN forms f ON t.field = f.field AND t.typed = f.form),
        segments AS (
            SELECT DISTINCT field, form, l, k, i, CAST(floor(i * l / (k + 1)) AS INT) AS at,
                   substring(form, CAST(floor(i * l / (k + 1)) AS INT) + 1, CAST(floor((i + 1) * l / (k + 1)) - floor(i * l / (k + 1)) AS INT)) AS segment
            FROM forms LATERAL VIEW explode(sequence(0, k)) AS i WHERE k > 0),
        -- the lengths, segments and places that a form within the edits can have: segment i has at most i edits before it, or at
        -- most k - i behind it, so its place in the typed value lies within i of its own and within k - i of its own plus the shift
        cuts AS (SELECT DISTINCT field, l AS fl, k, i, at, length(segment) AS n FROM segments),
        spans AS (
            SELECT DISTINCT r.field, r.typed, c.fl, c.i, substring(r.typed, p + 1, c.n) AS segment
            FROM rest r JOIN cuts c ON r.field = c.field AND c.fl BETWEEN r.l - c.k AND r.l + c.k
            LATERAL VIEW explode(sequence(greatest(0, c.at - c.i, c.at + r.l - c.fl - (c.k - c.i)), greatest(0, c.at - c.i, c.at + r.l - c.fl - (c.k - c.i), least(r.l - c.n, c.at + c.i, c.at + r.l - c.fl + (c.k - c.i))))) AS p
            WHERE p <= least(r.l - c.n, c.at + c.i, c.at + r.l - c.fl + (c.k - c.i))),
        pairs AS (
            SELECT DISTINCT s.field, s.typed, g.form, g.k FROM spans s JOIN segments g
            ON s.field = g.field AND s.fl = g.l AND s.i = g.i AND s.segment = g.segment),
        near AS (
            SELECT field, typed, form, distance FROM (SELECT *, levenshtein(typed, form, k) AS distance FROM pairs) WHERE distance >= 0),
        hits AS (
            SELECT * FROM same
            UNION ALL SELECT n.field, n.typed, f.ref_id, f.plain, n.distance FROM near n JOIN forms f ON n.field = f.field AND n.form = f.form)
        SELECT g.field, g.value, min(struct(h.distance, -h.plain AS plain, h.ref_id)).ref_id AS ref_id, min(h.distance) AS distance
        FROM {{glued}} g JOIN hits h ON g.field = h.field AND g.typed = h.typed GROUP BY g.field, g.value
        """,
        all_forms=all_forms,
        glued=glued,
    )


def map_values(records: DataFrame, roles: DataFrame, places: DataFrame) -> DataFrame:
    """(record_id, field, ref_id): the entry meant by each typed role and location, -1 where none is."""
    values = typed_values(records)
    mapped = durable(mapped_values(values, reference_forms(roles, places)))
    return records.sparkSession.sql(
        """SELECT DISTINCT v.record_id, v.field, m.ref_id FROM {values} v JOIN {mapped} m ON v.field = m.field AND v.value = m.value
           UNION ALL
           SELECT DISTINCT v.record_id, v.field, CAST(-1 AS BIGINT) FROM {values} v LEFT ANTI JOIN {mapped} m ON v.field = m.field AND v.value = m.value""",
        values=values,
        mapped=mapped,
    )


def unmatched_values(records: DataFrame, roles: DataFrame, places: DataFrame) -> DataFrame:
    """(field, value, n): the typed values without an entry, with their number of records."""
    values = typed_values(records)
    mapped = mapped_values(values, reference_forms(roles, places))
    return records.sparkSession.sql(
        """SELECT v.field, v.value, count(*) AS n FROM {values} v LEFT ANTI JOIN {mapped} m ON v.field = m.field AND v.value = m.value
           GROUP BY v.field, v.value""",
        values=values,
        mapped=mapped,
    )
