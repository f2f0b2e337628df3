"""Relevance of a signal: six weighted components and their total.

Each component is rounded to six places, its weighted value as well, and the total of the
rounded values once more, half up: the rule is floor(x * 1e6 + 0.5) / 1e6.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions import url as ur

#: Weights of the components.
WEIGHTS = {"keyword_overlap": 0.25, "completeness": 0.15, "confidence": 0.2, "freshness": 0.1, "credibility": 0.15, "directness": 0.15}
#: Greatest age in days, and the score up to it.
AGES = ((30, 1.0), (90, 0.8), (180, 0.6), (365, 0.4))


def rounded(value: Column) -> Column:
    return F.floor(value * 1e6 + 0.5) / F.lit(1e6)


def clamped(value: Column) -> Column:
    """Between 0 and 1; null stays null (least and greatest would pass over it)."""
    return F.when(value.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def keyword_overlap(query: Column, *fields: Column) -> Column:
    """Part of the query's words that the fields hold; 0 for a query without words."""
    wanted = tx.tokens(query)
    held = tx.tokens(F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields]))
    return F.when(F.size(wanted) == 0, 0.0).otherwise(F.size(F.array_intersect(wanted, held)) / F.size(wanted))


def completeness(*fields: Column) -> Column:
    """Part of the fields that are neither null nor blank."""
    return sum(F.coalesce((tx.trimmed(f) != "").cast("int"), F.lit(0)) for f in fields) / F.lit(float(len(fields)))


def freshness(published: Column, now: Column) -> Column:
    """By the age of the newest date; a date to come counts as today, none is neutral."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(published)) / F.lit(86_400_000_000.0))
    out = F.when(published.isNull(), 0.5)
    for most, value in AGES:
        out = out.when(days <= most, value)
    return out.otherwise(0.2)


def credibility(explicit: Column, website: Column, domain: Column, source_url: Column) -> Column:
    """The explicit score, else 0.9 on the company's own site, else by the scheme of the address."""
    own = website.isNotNull() & (F.regexp_replace(ur.host(source_url), r"^www\.", "") == domain)
    return F.coalesce(clamped(explicit), F.when(own, 0.9).when(ur.scheme(source_url) == "https", 0.7).otherwise(0.5))


def directness(company: Column, role: Column, evidence: Column) -> Column:
    """Whether the evidence names company and role and speaks of hiring."""
    low = F.lower(evidence)
    points = F.when(F.contains(low, F.lower(company)), 0.3).otherwise(0.0) + F.when(role.isNull() | F.contains(low, F.lower(role)), 0.25).otherwise(0.0)
    return points + F.when(low.rlike(tx.word(tx.HIRING_VERBS)), 0.35).otherwise(0.0) + F.when(evidence.isNotNull(), 0.1).otherwise(0.0)


def weighted(components: dict[str, Column]) -> dict[str, Column]:
    """Each component's rounded weighted value."""
    return {name: rounded(value * F.lit(WEIGHTS[name])) for name, value in components.items()}


def total(components: dict[str, Column]) -> Column:
    return rounded(sum(weighted(components).values()))


def reasons(query: Column, now: Column) -> dict[str, Column]:
    """Sentences that explain the scores of a record's keywords, freshness and directness."""
    c = F.col
    wanted = tx.tokens(F.coalesce(query, F.lit("")))
    held = tx.tokens(F.concat_ws(" ", *[F.coalesce(c(f), F.lit("")) for f in ("company", "website", "role", "location", "signal_text", "evidence")]))
    # an array of one binds both lists to a name, so that neither is made twice
    pair = F.array(F.struct(wanted.alias("w"), held.alias("h")))

    def sentence(p: Column) -> Column:
        matched = F.filter(p["w"], lambda t: F.array_contains(p["h"], t))
        words = F.when(F.size(matched) == 0, "none").otherwise(F.array_join(matched, ", "))
        text = F.concat(F.size(matched).cast("string"), F.lit(" of "), F.size(p["w"]).cast("string"), F.lit(" query keywords matched: "), words, F.lit("."))
        return F.when(F.size(p["w"]) == 0, "The query contains no scorable keywords.").otherwise(text)

    days = F.floor(F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros("published_at")) / F.lit(86_400_000_000.0)))
    age = F.when(c("published_at").isNull(), "No reliable publication timestamp was available; neutral freshness applied.")
    low = F.lower("evidence")
    said = lambda x: F.coalesce(x, F.lit(False)).cast("string")
    return {
        "keywords": F.get(F.transform(pair, sentence), F.lit(0)), "freshness": age.otherwise(F.concat(F.lit("Newest source publication is approximately "), days.cast("string"), F.lit(" days old."))),
        "directness": F.concat(
            F.lit("Evidence company="), said(F.contains(low, F.lower("company"))), F.lit(", role="), said(c("role").isNull() | F.contains(low, F.lower("role"))), F.lit(", hiring-language="), said(low.rlike(tx.word(tx.HIRING_VERBS))), F.lit("."),
        ),
    }
