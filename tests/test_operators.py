import re
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from millrace.functions import text as tx
from millrace.operators import fold, pages
from millrace.operators import signals as sg

NOW = datetime(2026, 6, 3)


def record(record_id, **change):
    base = {
        "record_id": record_id, "source_document_id": 1, "company": "Vellorgri Foods", "website": "https://vellorgri.example/", "role": "Welder", "location": "Bergen", "signal_text": "Vellorgri wants two welders",
        "source_url": "https://board.example/v/7", "evidence": "Vellorgri wants two welders in Bergen", "confidence_score": 0.75, "published_at": datetime(2026, 5, 9), "credibility_score": 0.6,
        "n_company": "vellorgri foods", "n_role": "welder", "n_domain": "vellorgri.example", "n_url": "https://board.example/v/7", "n_location": "bergen", "n_signal": "vellorgri wants two welders", "dedup_key": f"k{record_id}",
        "relevance": 0.5,
    }
    return base | change


def test_duplicates_merge_with_all_evidence():
    out, removed, detected = fold.fold([record(1), record(2, evidence="other quote", confidence_score=0.5)], "welder bergen", NOW)
    assert (len(out), removed, detected) == (1, 1, 0)
    source = next(iter(out[0]["sources"].values()))
    assert len(source["evidence"]) == 2 and out[0]["confidence_score"] == 0.75 and out[0]["dedup_key"] == "k1"


def test_similar_signal_at_another_address_is_a_duplicate():
    out, removed, _ = fold.fold([record(1), record(2, n_url="https://b.example/", n_signal="vellorgri wants two welders soon")], None, NOW)
    assert len(out) == 1 and removed == 1


def test_distinct_signal_at_another_address_stays():
    out, removed, detected = fold.fold([record(1), record(2, n_url="https://b.example/", n_signal="open vacancy apply")], None, NOW)
    assert (len(out), removed, detected) == (2, 0, 0)


def test_location_conflict_flags_both_sides():
    out, removed, detected = fold.fold([record(1), record(2, n_location="narvik")], None, NOW)
    assert (len(out), removed, detected) == (2, 0, 1)
    assert all(r["review"] for r in out) and {k for r in out for k, _ in r["conflicts"]} == {"LOCATION_MISMATCH"}
    assert (("LOCATION_MISMATCH", out[1]["dedup_key"]) in out[0]["conflicts"]) and (("LOCATION_MISMATCH", "k1") in out[1]["conflicts"])


def test_conflict_comes_before_duplicate_and_all_kinds_are_seen():
    kinds = fold.conflict_types(record(1), record(2, n_domain="b.example", n_location="narvik", n_signal="hiring freeze"))
    assert kinds == ["DOMAIN_MISMATCH", "LOCATION_MISMATCH", "SIGNAL_POLARITY_MISMATCH"]
    assert fold.conflict_types(record(1), record(2, n_domain="", n_location="")) == []


def test_better_record_fills_gaps():
    out, _, _ = fold.fold([record(1, website=None, role=None), record(2, location=None)], None, NOW)
    assert (out[0]["website"], out[0]["role"], out[0]["location"]) == ("https://vellorgri.example/", "Welder", "Bergen") and out[0]["record_id"] == 2


@settings(max_examples=60, deadline=None)
@given(hs.lists(hs.tuples(hs.sampled_from(["", "a.example", "b.example"]), hs.sampled_from(["", "oslo", "rome"]), hs.sampled_from(["x y z", "x y z w", "hiring freeze x", "q"]), hs.sampled_from(["u1", "u2"])), max_size=8))
def test_fold_keeps_every_record(rows):
    records = [record(k, n_domain=d, n_location=p, n_signal=s, n_url=u) for k, (d, p, s, u) in enumerate(rows)]
    out, removed, detected = fold.fold(records, "x", NOW)
    assert len(out) + removed == len(records)
    assert sorted(m for r in out for m in r["members"]) == list(range(len(records)))
    assert all(0 <= r["relevance"] <= 1 for r in out) and (detected == 0) == (not any(r["review"] for r in out))


def test_resolve_handles_nulls_and_empty_tables(spark):
    schema = "record_id bigint, job_id bigint, source_document_id bigint, company string, website string, role string, location string, signal_text string, source_url string, evidence string, confidence_score double, published_at timestamp, credibility_score double, created_at timestamp"
    rows = [(1, 7, 1, "Acme", None, None, None, "hiring", "https://a.example/", None, None, None, None, None), (2, 7, 1, "Acme", None, None, None, "hiring", "https://a.example/", "hiring", 0.5, None, None, None),
            (3, 7, 1, None, None, None, None, None, None, None, None, None, None, None)]
    from pyspark.sql import functions as F

    queries = spark.createDataFrame([(7, "acme")], "job_id bigint, query_text string")
    for data in (rows, []):
        df = sg.scored(sg.keyed(sg.normalized(spark.createDataFrame(data, schema))).join(queries, "job_id", "left"), F.col("query_text"), F.lit(NOW).cast("timestamp"))
        out = fold.resolve(df, "job_id", queries, NOW).collect()
        assert len(out) == (1 if data else 0)
        if out:
            assert out[0].members == [1, 2] and out[0].duplicates_removed == 1


ARTICLE = """<!doctype html><html lang="en"><head><title> A &amp; B </title><link rel="canonical" href="/pages/seven"><meta name="description" content="d">
<meta property="article:published_time" content="2026-07-01"></head><body><header><p>top</p></header><nav><a href="/n">n</a></nav><main><h1>Head</h1><p>One<br>two</p><p>one two</p><p>Three <a href="/w/9#x">l</a>
<a href="mailto:a@b">m</a><ul><li>item<li>item 2</ul></main><div class="cookie-banner"><p>c</p></div><script>var p = '<p>no</p>'</script><footer><p>f</p></footer></body></html>"""


def test_page_parsing():
    page = pages.parse_page(ARTICLE, "https://example.com/a/b")
    assert page["title"] == "A & B" and page["canonical_url"] == "https://example.com/pages/seven"
    assert page["text"] == "Head\nOnetwo\none two\nThree l\nm\nitem\nitem 2"
    assert page["links"] == ["https://example.com/w/9"]
    assert page["metadata"] == {"description": "d", "publishedAt": "2026-07-01", "language": "en"} and page["access_restricted"] is False


def test_page_parsing_of_odd_input():
    for html in ("", "plain text", "<p>a<p>b", "</div><b>x", "<<<>>>", "<main>" * 50 + "x"):
        assert isinstance(pages.parse_page(html, "")["text"], str)


def units(text):
    return len(text.encode("utf-16-le")) // 2


def test_bounded_chunks():
    text = "one two three\nfour five\n\nsix seven eight nine"
    assert pages.bounded_chunks(text, 16, 9) == ["one two three", "four five", "six seven eight", "nine"]
    assert pages.bounded_chunks(text, 16, 3) is None and pages.bounded_chunks(" \n", 10, 1) == [] and pages.bounded_chunks("abc", 10, 1) == ["abc"]


@settings(max_examples=150, deadline=None)
@given(text=hs.text(alphabet="ab \n\r😀é", max_size=80), most=hs.integers(2, 20))
def test_chunks_are_counted_in_utf16_units_and_lose_nothing_but_space(text, most):
    out = pages.bounded_chunks(text, most, 10**6)
    assert all(units(c) <= most for c in out) and "".join("".join(out).split()) == "".join(text.split())


class Replay:
    """The store's merge told once more in its own words, over whole tables, as a check."""

    def __init__(self, query, now):
        self.query, self.now, self.rows = query, now, []

    @staticmethod
    def clash(x, y):
        differ = lambda c: x[c] != "" and y[c] != "" and x[c] != y[c]
        says_no = lambda r: any(re.search(rf"(?<![A-Za-z0-9_]){p}(?![A-Za-z0-9_])", r["n_signal"]) for p in tx.NEGATIVE_PHRASES)
        return differ("n_domain") + differ("n_location") + (says_no(x) != says_no(y))

    @staticmethod
    def equal(x, y):
        a, b = set(filter(None, x["n_signal"].split(" "))), set(filter(None, y["n_signal"].split(" ")))
        return x["n_domain"] == y["n_domain"] and (x["n_url"] == y["n_url"] or not a | b or len(a & b) >= 0.6 * len(a | b))

    def add(self, rows, new):
        for k in range(len(rows)):
            if self.clash(rows[k], new):
                rows[k] = {**rows[k], "flag": True}
                rows.append({**new, "flag": True})
                return
            if self.equal(rows[k], new):
                full = lambda r: (sum(r[c] is not None for c in ("website", "role", "location")), r["confidence_score"] or 0)
                x, y = rows[k], new
                first = x if (full(x), y["key"]) > (full(y), x["key"]) or (full(x) == full(y) and x["key"] == y["key"]) else y
                rest = y if first is x else x
                fill = {c: first[c] if first[c] is not None else rest[c] for c in ("website", "role", "location")}
                top = max((r["confidence_score"] for r in (x, y) if r["confidence_score"] is not None), default=None)
                rows[k] = {**first, **fill, "confidence_score": top, "key": min(x["key"], y["key"]), "ids": x["ids"] + y["ids"], "flag": x["flag"] or y["flag"]}
                return
        rows.append(new)

    def run(self, records, by_source):
        stored = []
        for source in sorted({r["source_document_id"] for r in records}) if by_source else [None]:
            own = []
            for r in records:
                if source is None or r["source_document_id"] == source:
                    self.add(own, {**r, "ids": [r["record_id"]], "flag": False, "key": r["dedup_key"]})
            for r in own:
                self.add(stored, r) if by_source else stored.append(r)
        return sorted((sorted(r["ids"]), r["flag"]) for r in stored)


@pytest.mark.parametrize("by_source", [False, True])
def test_whole_tables_resolve_as_the_replay_does(spark, data, by_source):
    from pyspark.sql import functions as F

    from millrace.plans import signal_queries

    rows = signal_queries.scored(spark, data)
    name = "sk8_merged_by_source" if by_source else "sk8_resolved_by_job"
    got: dict = {}
    for r in signal_queries.QUERIES[name](spark, data).collect():
        got.setdefault((r.scope, r.n_company, r.n_role), []).append((sorted(r.members), r.review_required))
    key = F.collate(F.concat_ws("\u001f", "n_company", "n_role", "n_domain", "n_url", "n_location", "n_signal"), "UNICODE")
    blocks: dict = {}
    for r in rows.where("job_id IS NOT NULL").orderBy(key, "record_id").collect():
        if None not in (r.n_url, r.n_signal, r.n_company, r.dedup_key):
            blocks.setdefault((r.job_id, r.n_company, r.n_role), []).append(r.asDict())
    want = {k: Replay(None, NOW).run(v, by_source) for k, v in blocks.items()}
    assert {k: sorted(v) for k, v in got.items()} == want and sum(len(v) for v in want.values()) > 100


def test_a_matcher_is_asked_last():
    seen = []

    def matcher(a, b):
        seen.append((a["record_id"], b["record_id"]))
        return 0.95

    rows = [record(1), record(2, n_url="https://b.example/", n_signal="open vacancy apply"), record(3, n_location="narvik")]
    out, removed, detected = fold.fold(rows, None, NOW, matcher)
    assert (len(out), removed, detected) == (2, 1, 1) and seen == [(1, 2)]
    assert len(fold.fold(rows[:2], None, NOW, matcher, threshold=0.99)[0]) == 2


def test_scripted_provider_and_stage(spark):
    from millrace.operators import model

    script = model.Scripted(["a", "b"])
    assert [script.complete(""), script.complete("")] == ["a", "b"]
    with pytest.raises(LookupError):
        script.complete("")
    prompts = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id bigint, messages string").coalesce(1)
    assert [r.response for r in model.completions(prompts, lambda: model.Scripted(["one", "two"])).collect()] == ["one", "two", None]


def test_similar_vectors(spark):
    from millrace.operators import vectors

    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, None), (None, [1.0, 0.0])], "id bigint, vector array<double>")
    got = sorted((r.query_id, r.id) for r in vectors.similar(rows, rows.where("id < 3"), 0.9).collect())
    assert got == [(1, 2), (2, 1)] and vectors.similar(rows, rows.limit(0), 0.9).count() == 0


def test_chunks_of_null_rows(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(None, 5, 2), ("abc", 5, 2), ("abcdefghijk", 5, 2), ("x", None, 2)], "t string, m int, n int")
    assert [r[0] for r in df.select(pages.chunk_column(F.col("t"), F.col("m"), F.col("n"))).collect()] == [None, ["abc"], None, None]
