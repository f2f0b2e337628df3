"""Ordered entity resolution: each record merges into the first duplicate, or is flagged against the first conflict.

Records can only meet within one scope (a source or a job), company and role, so each such block
is folded by itself, in the order of its comparable fields under root collation, then of the
record id. The outcome depends on that order, hence the fold is sequential within a block;
blocks are the unit of parallelism. Their rows arrive as one sorted array per block and go
through one Arrow function, many blocks per batch.

Two forms: one fold over all records of a scope, and the store's form, in which each source's
records are folded by themselves and the outcome then merges, source after source, into what
the job has stored. Either may take a matcher of similar records as a second way to meet.

Defined results: records whose comparable fields cannot be made (no valid address) are left
out; null scores and dates stay null and lose every comparison; a record repeated under one id
is a duplicate of itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import score as sc
from millrace.functions import text as tx

NEGATIVE = re.compile(r"\b(?:" + "|".join(tx.NEGATIVE_PHRASES) + r")\b", re.ASCII)
VERBS = re.compile(r"\b(?:" + "|".join(tx.HIRING_VERBS) + r")\b", re.ASCII)
FIELDS = ("record_id", "source_document_id", "company", "website", "role", "location", "signal_text", "source_url", "evidence", "confidence_score", "published_at", "credibility_score",
          "n_company", "n_role", "n_domain", "n_url", "n_location", "n_signal", "dedup_key", "relevance")
OUTPUT = (
    "scope bigint, record_id bigint, n_company string, n_role string, n_domain string, n_location string, website string, role string, location string, confidence double, relevance double, "
    "dedup_key string, review_required boolean, conflicts array<string>, sources array<bigint>, evidence array<string>, members array<bigint>, duplicates_removed int, conflicts_detected int"
)


def conflict_types(a: dict, b: dict) -> list[str]:
    """How two records of one company and role contradict each other."""
    out = []
    if a["n_domain"] and b["n_domain"] and a["n_domain"] != b["n_domain"]:
        out.append("DOMAIN_MISMATCH")
    if a["n_location"] and b["n_location"] and a["n_location"] != b["n_location"]:
        out.append("LOCATION_MISMATCH")
    if bool(NEGATIVE.search(a["n_signal"])) != bool(NEGATIVE.search(b["n_signal"])):
        out.append("SIGNAL_POLARITY_MISMATCH")
    return out


def alike(a: dict, b: dict) -> bool:
    if a["n_domain"] != b["n_domain"]:
        return False
    if a["n_url"] == b["n_url"]:
        return True
    x, y = set(a["n_signal"].split()), set(b["n_signal"].split())
    return not (x or y) or len(x & y) / len(x | y) >= 0.6


def better(a: dict, b: dict) -> dict:
    """The record to keep: more of the nullable fields, then the surer one, then the smaller key."""
    rank = lambda r: (sum(r[c] is not None for c in ("website", "role", "location")), r["confidence_score"] or 0.0)
    if rank(a) != rank(b):
        return a if rank(a) > rank(b) else b
    return a if a["dedup_key"] <= b["dedup_key"] else b


def half_up(value: float) -> float:
    import math

    return math.floor(value * 1e6 + 0.5) / 1e6


def words(text: str) -> set[str]:
    return {t for t in re.split(r"[^\w+#.]|_", text.lower()) if len(t) >= 2 and t not in tx.STOP_WORDS}


def rescore(record: dict, query: str | None, now: datetime) -> float:
    """Relevance of a merged record, from its kept fields and all its sources."""
    evidence = [e.lower() for source in record["sources"].values() for e in source["evidence"] if e is not None]
    wanted = words(query or "")
    kept = " ".join(record[c] or "" for c in ("company", "website", "role", "location", "signal_text"))
    dates = [s["published"] for s in record["sources"].values() if s["published"] is not None]
    given = [s["credibility"] for s in record["sources"].values() if s["credibility"] is not None]
    days = max(0.0, (now - max(dates)).total_seconds() / 86_400) if dates else None
    hosts = {re.sub(r"^www\.", "", re.sub(r"^[a-z]+://([^/:?#]*).*$", r"\1", (s["url"] or "").lower())) for s in record["sources"].values()}
    own = record["website"] is not None and record["n_domain"] in hosts
    secure = all((s["url"] or "").lower().startswith("https:") for s in record["sources"].values())
    parts = {
        "keyword_overlap": len(wanted & words(kept + " " + " ".join(evidence))) / len(wanted) if wanted else 0.0,
        "completeness": sum(bool((record[c] or "").strip()) for c in ("company", "website", "role", "location", "signal_text", "source_url", "evidence")) / 7,
        "confidence": min(1.0, max(0.0, record["confidence_score"] or 0.0)),
        "freshness": 0.5 if days is None else next((v for most, v in sc.AGES if days <= most), 0.2),
        "credibility": max(given) if given else 0.9 if own else 0.7 if secure else 0.5,
        "directness": 0.3 * any((record["company"] or "").lower() in e for e in evidence) + 0.25 * (record["role"] is None or any(record["role"].lower() in e for e in evidence))
        + 0.35 * any(bool(VERBS.search(e)) for e in evidence) + 0.1 * bool(evidence),
    }
    return half_up(sum(half_up(v * sc.WEIGHTS[k]) for k, v in parts.items()))


def newest(a, b):
    return b if a is None else a if b is None else max(a, b)


def merged(a: dict, b: dict, query: str | None, now: datetime) -> dict:
    """Two records as one: the better one's fields, gaps filled, sources, flags and conflicts of both."""
    keep = better(a, b)
    other = b if keep is a else a
    sources = {k: dict(v) for k, v in a["sources"].items()}
    for key, source in b["sources"].items():
        old = sources.get(key)
        sources[key] = dict(source) if old is None else {
            "url": old["url"], "evidence": sorted(set(old["evidence"]) | set(source["evidence"]), key=lambda e: (e is not None, e or "")),
            "published": newest(old["published"], source["published"]), "credibility": newest(old["credibility"], source["credibility"]),
        }
    out = {
        **keep, **{c: keep[c] if keep[c] is not None else other[c] for c in ("website", "role", "location")}, "sources": sources,
        "confidence_score": newest(a["confidence_score"], b["confidence_score"]), "dedup_key": min(a["dedup_key"], b["dedup_key"]),
        "review": a["review"] or b["review"], "conflicts": {**a["conflicts"], **b["conflicts"]}, "members": a["members"] + b["members"],
    }
    out["relevance"] = rescore(out, query, now)
    return out


Matcher = Callable[[dict, dict], float]


def candidate(record: dict) -> dict:
    """A record with its one source, no flags and no conflicts."""
    credibility = None if record["credibility_score"] is None else min(1.0, max(0.0, record["credibility_score"]))
    source = {"url": record["source_url"], "evidence": [record["evidence"]], "published": record["published_at"], "credibility": credibility}
    return {**record, "sources": {(record["source_document_id"], record["source_url"]): source}, "review": False, "conflicts": {}, "members": [record["record_id"]]}


def set_against(old: dict, new: dict, kinds: list[str]) -> tuple[dict, dict]:
    """Two records that contradict each other: the later one gets a key of its own, and both point at each other."""
    own = hashlib.sha256("\x1f".join((new["dedup_key"], new["n_location"], new["n_signal"], new["n_url"])).encode()).hexdigest()
    flagged = {**old, "review": True, "conflicts": {**old["conflicts"], **{(kind, own): kind for kind in kinds}}}
    return flagged, {**new, "dedup_key": own, "review": True, "conflicts": {**new["conflicts"], **{(kind, old["dedup_key"]): kind for kind in kinds}}}


class Tally:
    """What a fold counted: duplicates removed, those of them that added a source, and conflicts."""

    def __init__(self) -> None:
        self.removed = self.across = self.detected = 0


def take_in(stored: list[dict], new: dict, query: str | None, now: datetime, tally: Tally, matcher: Matcher | None = None, threshold: float = 0.9) -> None:
    """One record into the ordered list: into its first duplicate, against its first conflict, else into its first similar one, else at the end."""
    for k, old in enumerate(stored):
        kinds = conflict_types(old, new)
        if kinds:
            stored[k], new = set_against(old, new, kinds)
            stored.append(new)
            tally.detected += len(kinds)
            return
        if alike(old, new):
            break
    else:
        k = next((k for k, old in enumerate(stored) if matcher is not None and matcher(old, new) >= threshold), -1)
        if k < 0:
            stored.append(new)
            return
    tally.removed += 1
    tally.across += not {d for d, _ in new["sources"]} <= {d for d, _ in stored[k]["sources"]}
    stored[k] = merged(stored[k], new, query, now)


def fold(records: list[dict], query: str | None, now: datetime, matcher: Matcher | None = None, threshold: float = 0.9) -> tuple[list[dict], int, int]:
    """Resolved records of one ordered block, duplicates removed, conflicts detected."""
    out: list[dict] = []
    tally = Tally()
    for record in records:
        take_in(out, candidate(record), query, now, tally, matcher, threshold)
    return out, tally.removed, tally.detected


def accumulate(records: list[dict], query: str | None, now: datetime, matcher: Matcher | None = None, threshold: float = 0.9) -> tuple[list[dict], int, int]:
    """The same in the store's form: ``records`` come source by source; each source is folded, then merged into what is stored."""
    stored: list[dict] = []
    tally = Tally()
    for _, batch in groupby(records, key=lambda r: r["source_document_id"]):
        resolved, removed, detected = fold(list(batch), query, now, matcher, threshold)
        tally.removed, tally.detected = tally.removed + removed, tally.detected + detected
        for record in resolved:
            take_in(stored, record, query, now, tally)
    return stored, tally.removed, tally.detected


def resolve(df: DataFrame, scope: str, queries: DataFrame, now: datetime, by_source: bool = False, matcher: Matcher | None = None, threshold: float = 0.9) -> DataFrame:
    """Resolved records of each scope. ``df`` is normalised, keyed and scored; ``queries`` has (scope, query_text); ``now`` is UTC without a zone.

    ``by_source`` takes the store's form, the sources in the order of their ids. ``matcher`` says
    how similar two records are; from ``threshold`` on they are one.
    """
    work = accumulate if by_source else fold
    order = F.collate(F.concat_ws("\u001f", "n_company", "n_role", "n_domain", "n_url", "n_location", "n_signal"), "UNICODE")
    rows = df.where(F.col(scope).isNotNull())
    blocks = rows.groupBy(F.col(scope).alias("scope"), "n_company", "n_role").agg(F.sort_array(F.collect_list(F.struct((F.col("source_document_id") if by_source else F.lit(0)).alias("batch"), order.alias("sort_key"), *FIELDS))).alias("rows"))
    slim = blocks.select("scope", F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in FIELDS])).alias("rows"))
    asked = slim.join(queries.select(F.col(scope).alias("scope"), "query_text"), "scope", "left").select("scope", "query_text", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table: list[tuple] = []
            for key, query, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                # sorted out here: a filter on computed columns would be pushed below them and compute them twice
                members = [r for r in members if None not in (r["n_url"], r["n_signal"], r["n_company"], r["dedup_key"])]
                for r in members:
                    if r["published_at"] is not None:
                        r["published_at"] = r["published_at"].astimezone(UTC).replace(tzinfo=None)
                result, removed, detected = work(members, query, now, matcher, threshold)
                for k, r in enumerate(result):
                    table.append((
                        key, r["record_id"], r["n_company"], r["n_role"], r["n_domain"], r["n_location"], r["website"], r["role"], r["location"], r["confidence_score"], r["relevance"],
                        r["dedup_key"], r["review"], sorted({kind for kind, _ in r["conflicts"]}), sorted({d for d, _ in r["sources"] if d is not None}),
                        sorted({e for s in r["sources"].values() for e in s["evidence"] if e is not None}), sorted(r["members"]), removed if k == 0 else 0, detected if k == 0 else 0,
                    ))
            text, number, real, flag = pa.string(), pa.int64(), pa.float64(), pa.bool_()
            types = [number, number, text, text, text, text, text, text, text, real, real, text, flag, pa.list_(text), pa.list_(number), pa.list_(text), pa.list_(number), pa.int32(), pa.int32()]
            names = [c.split(" ")[0] for c in OUTPUT.split(", ")]
            columns = list(zip(*table, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return asked.mapInArrow(run, OUTPUT)
