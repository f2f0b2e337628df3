"""The operators on small frames: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.llm import p01_names, p02_residue, p03_survivor, p04_split, p05_canonical, p06_boilerplate, p07_lines, p08_tokens, p09_leaks, p10_toxic
from millrace.llm.common import durable

SIGNALS = "record_id bigint, job_id bigint, company string, website string, role string, location string, confidence_score double, published_at timestamp, credibility_score double, deduplication_key string"
#: Columns whose names the operators use inside.
CLASHING = ("id", "key", "node", "value", "field", "text_", "line", "n", "cluster", "block", "lines", "score")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING})


def signals(spark, rows):
    return spark.createDataFrame(rows, SIGNALS).transform(clashing)


def at(day):
    return datetime(2026, 1, day)


def test_survivors(spark):
    rows = [
        (1, 1, "Acme", None, "Welder", "Oslo", 0.9, at(3), 0.9, "k"), (2, 1, "Acme", " ", "Welder", "Oslo", 0.8, at(2), 0.5, "k"), (3, 1, "ACME", None, None, None, None, None, None, "k"),
        (4, 1, "B", None, None, None, 0.5, at(1), 0.5, "tie"), (5, 1, "B", None, None, None, 0.5, at(1), 0.5, "tie"),
        (6, 1, "C", None, None, None, 0.9, at(1), 0.1, "split"), (7, 1, "C", None, None, None, 0.1, at(1), 0.9, "split"),
        (8, 1, "D", None, None, None, 0.9, at(1), 0.1, "alone"), (9, None, "D", None, None, None, 0.9, at(1), 0.1, "alone"), (10, 1, "D", None, None, None, 0.9, at(1), 0.1, None),
        (11, 2, None, None, None, None, None, None, None, "nulls"), (12, 2, None, None, None, None, float("nan"), None, None, "nulls"), (13, 2, None, "w", None, None, None, None, None, "nulls"),
    ]
    df = signals(spark, rows)
    assert sorted(r[0] for r in p03_survivor.dominant_records(df).collect()) == [1, 13]
    out = {r.deduplication_key: r for r in p03_survivor.survivors(df).collect()}
    assert set(out) == {"k", "tie", "split", "nulls"} and out["k"].company == "Acme" and out["k"].website is None and out["nulls"].website == "w" and not out["tie"].leads
    assert p03_survivor.survivors(signals(spark, [])).count() == 0
    # a row that comes twice ties with itself
    assert p03_survivor.dominant_records(signals(spark, rows[:3] + rows[:1])).count() == 0


def test_large_groups_have_the_outcome_of_whole_ones(spark, data, monkeypatch):
    from millrace.sources import table

    rows = [(k, 1, f"Acme Works {k % 9}" if k % 3 else "Acme Works", None, f"Senior Welder {'abc'[k % 3]}", None, 0.5, at(1 + k % 5), 0.5, "big") for k in range(100)]
    frames = [signals(spark, rows), table(spark, data, "signals")]
    whole = [sorted(map(tuple, p03_survivor.survivors(df).collect()), key=str) for df in frames]
    monkeypatch.setattr(p03_survivor, "WHOLE", 1)
    assert [sorted(map(tuple, p03_survivor.survivors(df).collect()), key=str) for df in frames] == whole
    assert len(whole[0]) == 1 and whole[0][0][4] == 100 and len(whole[1]) > 100


def test_found_records_come_out_of_the_consensus(spark, data):
    from millrace.sources import table

    plan = p03_survivor.dominant_records(table(spark, data, "signals"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "company" in plan


def test_splitting(spark):
    inputs = spark.createDataFrame([(1, 1, None), (2, 1, ""), (3, 1, "short"), (4, 1, "word " * 100), (5, 9, "x" * 50), (6, 1, "y" * 95), (4, 1, "word " * 100), (7, None, "z" * 50), (8, 1, "😀" * 15)], "input_id bigint, config_id int, source_text string").transform(clashing)
    config = spark.createDataFrame([(1, 20, 5), (2, None, 1), (None, 5, 1)], "config_id int, max_chunk_characters int, overlap_characters int")
    assert sorted(r[0] for r in p04_split.oversized(inputs, config).collect()) == [4, 6, 8]
    pieces = p04_split.split_inputs(inputs, config).collect()
    assert {p.input_id for p in pieces} == {2, 3, 4, 6, 8} and all(len(p.piece.encode("utf-16-le")) // 2 <= 20 for p in pieces)
    assert p04_split.oversized(inputs.limit(0), config).count() == 0 and p04_split.split_inputs(inputs, config.limit(0)).count() == 0


ROLES = "role_id bigint, role_name string, aliases array<string>"
PLACES = "location_id bigint, city string, province string, country string, aliases array<string>"


def test_mapping(spark):
    roles = spark.createDataFrame([(1, "Backend Engineer", ["Server-side Programmer"]), (2, "Financial Analyst", None), (3, "Site Reliability Engineer", None), (4, "Sales Representative", None), (5, "Sales Development Representative", None), (6, None, None)], ROLES)
    places = spark.createDataFrame([(1, "Port Lanmor", "Lumrog Province", "Ostravia", ["Juntul"]), (2, "Port Lanmor", "Naucri Province", "Hallora", None), (3, "Arktánrys", None, None, None)], PLACES)
    typed = [
        (1, "Sr. Bakend Engr (m/f/d)", "Pt. Lanmor, Ostrvaia"), (2, "analyst / financial", "near Arktanrys"), (3, "SRE", "82995 Port Lanmor (Hallora)"), (4, "Puppeteer", "Hepzulzan"), (5, None, " "), (6, "Sales Dev. Rep wanted", "Hallora - Port Lanmor"),
        (7, "server side programmer x2", "???"), (1, "Sr. Bakend Engr (m/f/d)", "Pt. Lanmor, Ostrvaia"),
    ]
    df = signals(spark, [(k, 1, "c", None, r, p, None, None, None, None) for k, r, p in typed])
    got = {(r.record_id, r.field): r.ref_id for r in p05_canonical.map_values(df, roles, places).collect()}
    assert got == {
        (1, "role"): 1, (1, "location"): 1, (2, "role"): 2, (2, "location"): 3, (3, "role"): 3, (3, "location"): 2, (4, "role"): -1, (4, "location"): -1, (6, "role"): 5, (6, "location"): 2, (7, "role"): 1, (7, "location"): -1,
    }
    assert p05_canonical.map_values(df, roles, places).count() == len(got)
    assert {r.value for r in p05_canonical.unmatched_values(df, roles, places).collect()} == {"Puppeteer", "Hepzulzan", "???"}
    assert p05_canonical.map_values(df.limit(0), roles, places).count() == 0
    assert {r.ref_id for r in p05_canonical.map_values(df, roles.limit(0), places.limit(0)).collect()} == {-1}


def test_pigeonhole_finds_what_brute_force_finds(spark, data):
    from millrace.sources import table

    values = p05_canonical.typed_values(table(spark, data, "signals"))
    forms = p05_canonical.reference_forms(table(spark, data, "canonical_roles"), table(spark, data, "canonical_locations"))
    mapped = {(r.field, r.value): r.distance for r in p05_canonical.mapped_values(values, forms).collect()}
    assert mapped and all(d >= 0 for d in mapped.values())
    glued = spark.sql(
        "SELECT field, value, replace(trim(regexp_replace(lower(value), '[^a-z0-9]+', ' ')), ' ', '') AS typed FROM {v} WHERE value RLIKE '^[A-Za-z ]+$' GROUP BY field, value", v=values
    ).where("typed NOT RLIKE 'team|wanted|time|remote|near|region|greater|area|city|surroundings|hybrid|temp|^(sr|snr|senior|jr|junior|lead|principal|deputy)'")
    best = spark.sql(
        "SELECT t.field, t.value, min(levenshtein(t.typed, f.form)) AS d FROM {t} t JOIN {f} f ON t.field = f.field AND levenshtein(t.typed, f.form) <= "
        + p05_canonical.edits_sql("length(f.form)") + " GROUP BY t.field, t.value",
        t=glued, f=forms,
    ).collect()
    assert len(best) > 50
    assert all(mapped.get((r.field, r.value), 99) <= r.d for r in best)


def test_long_forms_are_matched_as_well(spark):
    long = " ".join(f"{w} supervisor" for w in ("Regional", "Warehouse", "Inventory", "Packaging", "Dispatch", "Security"))
    roles = spark.createDataFrame([(1, long, None), (2, "Welder", None)], ROLES)
    typed = long.replace("Warehouse", "Warehuose")
    df = signals(spark, [(1, 1, "c", None, typed, None, None, None, None, None)])
    assert [r.ref_id for r in p05_canonical.map_values(df, roles, spark.createDataFrame([], PLACES)).collect()] == [1]


DOCS = "source_document_id bigint, domain string, title string, raw_content string"
RESULTS = "result_id bigint, final_url string, title string, text string"


def test_repeated_lines(spark):
    rows = [(k, "a.example", None, f"Unique words {chr(97 + k)}\nShare  THIS page {k}!\n\n123\nShare this page") for k in range(8)] + [(100 + k, "b.example", None, f"Share this page\nx{k}") for k in range(7)]
    rows += [(200, None, None, "Share this page"), (None, "a.example", None, "x"), (201, "a.example", None, None), (202, "a.example", None, ""), (0, "a.example", None, rows[0][3])]
    df = spark.createDataFrame(rows, DOCS).transform(clashing)
    got = sorted((r[0], r[1]) for r in p07_lines.repeated_lines(df).collect())
    assert got == sorted((k, n) for k in range(8) for n in (1, 4))
    cleaned = {r.source_document_id: r for r in p07_lines.without_repeated_lines(df.where("source_document_id IS NOT NULL").dropDuplicates(["source_document_id"])).collect()}
    assert cleaned[3].text == "Unique words d\n\n123" and cleaned[3].removed_lines == 2 and cleaned[201].text is None and cleaned[202].text == "" and cleaned[100].removed_lines == 0
    assert p07_lines.repeated_lines(df.limit(0)).count() == 0


def test_lines_of_one_document_under_many_variants_count_once(spark):
    rows = [(k, "a.example", None, f"Page {k} of 9\nPAGE {k}, OF 9!\npage of") for k in range(7)]
    assert p07_lines.repeated_lines(spark.createDataFrame(rows, DOCS)).count() == 0
    assert p07_lines.repeated_lines(spark.createDataFrame(rows + [(-5, "a.example", None, "Page of")], DOCS)).count() == 22


def test_large_and_distant_ids_share_a_line(spark):
    ids = [1, 65_535, 65_536, 65_537, 10**12, 10**12 + 1, 2**40, 7]
    df = spark.createDataFrame([(i, "a.example", None, "Back to top") for i in ids], DOCS)
    assert sorted(r[0] for r in p07_lines.repeated_lines(df).collect()) == sorted(ids)


def test_boilerplate(spark):
    page = "Home | Jobs | Help\nWelder at Acme\nAcme is hiring a welder for its field group in Oslo today.\n\nBack to top"
    docs = spark.createDataFrame([(1, "a.example", "Welder at Acme", page), (2, None, None, None), (3, "a.example", None, ""), (4, "a.example", None, " \n "), (1, "a.example", "Welder at Acme", page)], DOCS).transform(clashing)
    results = spark.createDataFrame([(9, None, None, page), (None, None, None, page)], RESULTS).transform(clashing)
    got = sorted((r.field, r.row_id, r.line_no) for r in p06_boilerplate.boilerplate_lines(docs, results).collect())
    assert got == [("raw_content", 1, 0), ("raw_content", 1, 4), ("text", 9, 0), ("text", 9, 4)]
    bodies = {(r.field, r.row_id): r.body for r in p06_boilerplate.main_bodies(docs, results).collect()}
    assert bodies["text", 9].startswith("Welder at Acme\n") and bodies["raw_content", 3] == ""
    assert p06_boilerplate.boilerplate_lines(docs.limit(0), results.limit(0)).count() == 0


def test_repeated_lines_of_unlisted_wording_are_boilerplate(spark):
    body = "{} wants {} welders for the yard in {}, and the work begins on the first of June."
    notice = "Zebras graze upon our terms and will nibble at yours if you tarry here for long."
    rows = [(k, f"s{k % 4}.example", None, f"Welders wanted in town {k}\n" + body.format("ABCDEFGHIJ"[k], k + 2, "Oslo Bergen Narvik Bodo Moss Larvik Hamar Molde Alta Skien".split()[k]) + f"\n{notice}") for k in range(10)]
    docs = spark.createDataFrame(rows, DOCS)
    found = {(r.row_id, r.line_no) for r in p06_boilerplate.boilerplate_lines(docs, spark.createDataFrame([], RESULTS)).collect()}
    assert found == {(k, 2) for k in range(10)}
    # in place of the content the same sentence is the body
    alone = spark.createDataFrame([(k, f"s{k % 4}.example", None, notice) for k in range(10)], DOCS)
    assert p06_boilerplate.boilerplate_lines(alone, spark.createDataFrame([], RESULTS)).count() == 0


def test_the_density_threshold_decides(monkeypatch):
    page = "Home | Jobs | Help | Search\nWelder at Acme\nAcme is hiring a welder for its field group in Oslo today.\nBaker - Bolt, Oslo\nThe group works in the open from six to two, and it pays well.\nTerms / Imprint / Contact"
    assert p06_boilerplate.main_body(page, "Welder at Acme", "acme") == {1, 2, 4}
    leaves = [p06_boilerplate.Leaf(k, x) for k, x in enumerate(page.split("\n"))]
    for leaf in leaves:
        leaf.settle(True)
    # the stretches of links are left out by their density alone
    assert [s.leaves[0].number for s in p06_boilerplate.body_stretches(leaves)] == [1, 4]
    monkeypatch.setattr(p06_boilerplate, "composite_density", lambda *_: 1.0)
    assert p06_boilerplate.main_body(page, "Welder at Acme", "acme") == {1, 2, 3, 4, 5}


def test_residue(spark):
    good = "Welder at Acme\nAcme is hiring a welder for its field group in Oslo, and the work begins in June."
    rows = [
        (1, "https://a.example/1", "Welder at {{company}}", good), (2, "https://a.example/2", "Welder", good + "\nWrite to [company] today"), (3, "https://b.example/", "Error", "Error\nPlease turn on JavaScript to see this page."),
        (4, "https://b.example/", None, good), (5, None, None, None), (6, None, "", ""), (7, "https://c.example/", "x", "In our guide Ann explains that a name in double braces such as {{name}} is filled in later by Ben."),
        (None, None, "{{x}}", "{{x}}"), (1, "https://a.example/1", "Welder at {{company}}", good), (8, "https://d.example/", None, "y" * 100_000),
    ]
    df = spark.createDataFrame(rows, RESULTS).transform(clashing)
    assert sorted(r[0] for r in p02_residue.residual_results(df).collect()) == [1, 2, 3]
    assert {r.result_id for r in p02_residue.clean_results(df).collect()} == {4, 5, 6, 7, 8, None}
    assert p02_residue.residual_results(df.limit(0)).count() == 0


def test_repeated_page_templates_count_without_a_cue(spark):
    rows = [(k, f"https://s{k}.example/x", f"Headline {k}", f"Headline {k}\nThe kitchen is resting just now and will be back with you.") for k in range(8)]
    rows += [(50, "https://t.example/", "Other", "Other\nAcme is hiring a welder for its field group in Oslo.")]
    assert sorted(r[0] for r in p02_residue.residual_results(spark.createDataFrame(rows, RESULTS)).collect()) == list(range(8))


def test_long_page_templates_count_without_a_cue(spark):
    notice = "The kitchen is resting just now, so please bear with us while the cooks get some sleep before they come back."
    rows = [(k, f"https://s{k}.example/x", f"Headline {k}", f"Headline {k}\n{notice}") for k in range(8)]
    # a page that has content besides, and a sentence that only one site repeats
    rows += [(50, "https://t.example/", "Other", f"Other\n{notice}\nAcme is hiring a welder for its field group in Oslo, and the work there begins on the first of June.")]
    rows += [(60 + k, "https://u.example/", f"Top {k}", f"Top {k}\nOur one office opens at eight in the morning and stays open until the last visitor has been seen.") for k in range(8)]
    assert sorted(r[0] for r in p02_residue.residual_results(spark.createDataFrame(rows, RESULTS)).collect()) == list(range(8))


def test_error_sentences_of_unlisted_wording_are_found_by_repetition(spark):
    notice = "Our gears are being oiled at this very moment, and nothing that you asked for can be brought up to you before the evening."
    rows = [(k, f"https://s{k % 8}.example/{k}", f"Top {k}", f"Top {k}\n{notice}") for k in range(40)]
    assert sorted(r[0] for r in p02_residue.residual_results(spark.createDataFrame(rows, RESULTS)).collect()) == list(range(40))


def test_variable_names_left_in_slots(spark):
    firms = [("Acme", "Welder"), ("Bolt", "Cook"), ("Cord", "Nurse"), ("Dorn", "Driver"), ("Ebba", "Baker"), ("Fjord", "Pilot"), ("Glen", "Smith")]
    rows = [(k, f"https://s{k}.example/", None, f"{f} is looking for a {r} who can start in June and stay.") for k, (f, r) in enumerate(firms)]
    rows += [(20, "https://t.example/", None, "CompanyName is looking for a JobTitle who can start in June and stay."), (21, "https://t.example/", None, "McGregor is looking for a Welder who can start in June and stay.")]
    assert [r[0] for r in p02_residue.residual_results(spark.createDataFrame(rows, RESULTS)).collect()] == [20]


def test_blanks_are_told_by_filled_records(spark):
    towns = ["Oslo", "Bergen", "Lima", "Rome", "Paris", "Vaduz"]
    long = " and we would very much like to hear from you, whoever you are and wherever it is that you happen to live now, since the work that we offer is open to all who can do it well"
    line = "Join us at {}, the house for people who weld" + long + "."
    rows = [(k, f"https://s{k}.example/x", "Welder", "Welder\n" + line.format(w)) for k, w in enumerate(towns)]
    rows += [(20, "https://a.example/", "Welder", "Welder\n" + line.format("")), (21, "https://a.example/", "Welder", "Welder\n" + line.format("Company Name"))]
    # nobody fills this one, and this one never varies
    rows += [(30, "https://a.example/", "Cook", "Cook\nThe tool that he works in , he says, is old.")]
    rows += [(40 + k, "https://b.example/", "Cook", "Cook\nWe all cook at Lima, as ever we did.") for k in range(6)] + [(50, "https://b.example/", "Cook", "Cook\nWe all cook at , as ever we did.")]
    assert sorted(r[0] for r in p02_residue.residual_results(spark.createDataFrame(rows, RESULTS)).collect()) == [20, 21]


def test_variant_names(spark):
    names = [(1, "Vellorgri Foods", None), (2, "VELLORGRI FOODS LTD.", None), (3, "Velorgri Foods", None), (4, "Vellorgri Energy", None), (5, "AOM", "https://www.ostvin.example/"), (6, "Alexander Ostvin Motors", "ostvin.example"), (7, None, None), (8, " ", "x.example"), (1, "Vellorgri Foods", None), (9, "Vellorgri Foods", None)]
    df = signals(spark, [(k, 1, c, w, None, None, None, None, None, None) for k, c, w in names] + [(20, 2, "Vellorgri Foods Ltd", None, None, None, None, None, None, None), (21, None, "Vellorgri Foods", None, None, None, None, None, None, None)])
    got = sorted(tuple(r) for r in p01_names.variant_pairs(df).collect())
    assert got == [(1, 2), (1, 3), (2, 3), (2, 9), (3, 9), (5, 6)]
    assert p01_names.variant_pairs(df.limit(0)).count() == 0


def linked(spark, *names):
    df = signals(spark, [(k, 1, c, None, None, None, None, None, None, None) for k, c in enumerate(names)])
    return sorted(tuple(r) for r in p01_names.variant_pairs(df).collect())


def test_names_of_unlisted_words(spark):
    rest = ("Dolmen Castings", "Ferrolux Paints", "Halberg Tiles", "Nordwick Sails")
    assert linked(spark, "Quarrick Plumbing", "Plumbing Quarrick", *rest) == [(0, 1)]
    assert linked(spark, "Zürich Handelskammer", "Handelskammer Zurich", *rest) == [(0, 1)]
    assert linked(spark, "Mohammed Khan Roofing", "Mo Khan Roofing", *rest) == [(0, 1)]
    assert linked(spark, "Quarrick Roofing Ltd", "Quarrick Roofing & Tiling", *rest) == []
    assert linked(spark, "Ox", "Ox Software", *rest) == linked(spark, "Voxen", "Voxen Software", *rest) == [(0, 1)]
    assert linked(spark, "Benjamin Hallum and Partners", "Benjamin Hallum nad Partners Ltd", *rest) == [(0, 1)]


def test_names_read_alike_are_linked_whatever_else_a_site_is_called(spark):
    rows = [(1, "Griyorpexuvo Energy", "https://griyor.example/"), (2, "The Blue People", "griyor.example"), (4, "griyorpexuvo  ENERGY", None)]
    df = signals(spark, [(k, 1, c, w, None, None, None, None, None, None) for k, c, w in rows])
    assert {(1, 2), (1, 4), (2, 4)} == {tuple(r) for r in p01_names.variant_pairs(df).collect()}


def test_near_names_are_those_of_the_whole_vectors(spark, data):
    from millrace.sources import table

    names = p01_names.named(table(spark, data, "signals", "record_id", "job_id", "company", "website"))
    nodes = durable(names.where("length(own) >= 3 AND own NOT LIKE '#%'").groupBy("job_id", "own", "business").agg(F.max(F.size("sites") > 0).alias("sited")).withColumn("node", F.xxhash64("job_id", "own", "business")))
    # two swaps, which levenshtein counts as four edits, and no line of business
    odd = spark.createDataFrame([(-1, "vellorgrimak", 0, False, 1), (-1, "vellorgirmka", 0, False, 2)], "job_id bigint, own string, business bigint, sited boolean, node bigint")
    nodes = nodes.select("job_id", "own", "business", "sited", "node").unionByName(odd)
    total, rows = names.count(), nodes.collect()
    weights = p01_names.np.log(total / p01_names.np.maximum(1.0, p01_names.gram_frequencies(nodes))) + 0.5
    vectors = {r.node: {g: w for w, g in p01_names.vector_of(r.own, weights)} for r in rows}
    expected, cut = set(), 0
    for a in rows:
        for b in rows:
            most = p01_names.edits_allowed(min(len(a.own), len(b.own)))
            if a.node < b.node and a.job_id == b.job_id and p01_names.businesses_agree(a.business, b.business) > 0 and (a.own == b.own or not (a.sited and b.sited)) and p01_names.distance(a.own, b.own, most) <= most:
                if sum(w * vectors[b.node].get(g, 0.0) for g, w in vectors[a.node].items()) >= p01_names.COSINE:
                    expected.add((a.node, b.node))
                    cut += p01_names.distance(a.own, b.own, most) > 0
    got = {(r.a, r.b) for r in p01_names.near_pairs(nodes, total).collect()}
    assert cut > 1 and (1, 2) in expected and expected <= got


def test_job_boards_link_nothing(spark):
    words = ["Arkmor", "Belnau", "Cadfen", "Drevin", "Ethgos", "Falhep", "Glajun", "Haldov", "Irikel", "Jorlan"]
    df = signals(spark, [(k, 1, f"{w}olri Foods", "https://boards.hire.example/x", None, None, None, None, None, None) for k, w in enumerate(words)])
    assert p01_names.variant_pairs(df).count() == 0


def test_boards_are_told_by_spread_and_not_by_number(spark):
    # a small board links nothing
    firms = [(k, 1, f"{w}olri Foods", "https://boards.hire.example/x", None, None, None, None, None, None) for k, w in enumerate(["Arkmor", "Belnau", "Cadfen", "Drevin"])]
    assert p01_names.variant_pairs(signals(spark, firms)).count() == 0
    # an own site stays one, whatever the number of spellings and of their beginnings
    spellings = [f"Vellorgrimak Foods {x}".strip() for x in ("", "Ltd", "Inc", "GmbH", "Corp", "LLC", "plc", "S.A.")] + [x + "ellorgrimak Foods" for x in "bcdfghjk"] + ["VF", "Foods of Vellorgrimak", "The Vellorgrimak Foods", "Vlelorgrimak Foods"]
    rows = [(100 + k, 1, c, "https://vellorgrimak.example/", None, None, None, None, None, None) for k, c in enumerate(spellings)]
    assert p01_names.variant_pairs(signals(spark, rows)).count() == len(spellings) * (len(spellings) - 1) // 2


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    labels = {r.node: r.label for r in p01_names.components(edges).collect()}
    assert {labels[k] for k in range(41)} == {0} and labels[101] == 100


def test_encoding_rows(spark):
    import os

    if not os.path.exists(f"{p08_tokens.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"):
        pytest.skip("no vocabulary files here")
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (1, "hello world"), (4, "<|endoftext|>")], "doc_id bigint, text string").transform(clashing)
    rows = sorted((r.doc_id, list(r.ids)) for r in p08_tokens.encode_documents(df).collect())
    assert rows[0] == rows[1] == (1, [31373, 995]) and rows[2] == (2, []) and rows[3] == (3, []) and 50256 not in rows[4][1]
    assert p08_tokens.encode_documents(df.limit(0)).count() == 0


ITEM = " ".join(f"word{k}" for k in range(40))


def test_leaks(spark):
    part = ITEM.split()
    docs = [
        (1, "Intro here. " + " ".join(part[5:25]).upper().replace(" ", ", ")), (2, "short " + " ".join(part[5:15])), (3, None), (4, ""), (5, "x " + " ".join(part[0:8] + ["other"] + part[9:20])), (6, "nothing at all to see"),
        (1, "Intro here. " + " ".join(part[5:25])), (7, " ".join(["filler"] * 3000 + part[:30])),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").transform(clashing)
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "too short to leak"), (5, ITEM)], "item_id bigint, text string")
    assert sorted(tuple(r) for r in p09_leaks.leaked_items(df, items).collect()) == [(d, i) for d in (1, 5, 7) for i in (1, 5)]
    assert p09_leaks.leaked_items(df.limit(0), items).count() == 0 and p09_leaks.leaked_items(df, items.limit(0)).count() == 0


def test_latent_search_decides_and_finds_the_shortest_runs(spark, data, monkeypatch):
    import numpy as np

    from millrace.sources import table

    (items,) = p09_leaks.blocks_of_items(table(spark, data, "benchmark"))
    corpus = p09_leaks.numbered(table(spark, data, "documents", "doc_id", "text").where("text IS NOT NULL").selectExpr("doc_id AS id", "text"), items.vocabulary)
    weights = p09_leaks.Weights(*p09_leaks.document_frequencies(corpus, len(items.vocabulary)))
    search = p09_leaks.Search(items, weights, p09_leaks.latent_basis(corpus, items, weights))
    texts = p09_leaks.read_numbers(corpus.select("words").toArrow().column("words").combine_chunks())
    rng, planted, want = np.random.default_rng(3), [], []
    for n in range(400):
        k = int(rng.integers(len(items.words)))
        item = items.words[k]
        at = int(rng.integers(len(item) - 14))
        run = np.array(item[at : at + 15], np.int32)
        if n % 2:
            run[int(rng.integers(1, 14))] = -1
        host = texts[int(rng.integers(len(texts)))]
        place = int(rng.integers(len(host) + 1))
        planted.append(np.concatenate((host[:place], run, host[place:])))
        want.append(k)
    got = {(start + t, k) for start, some in p09_leaks.spans(planted) for t, k, _, _ in search.candidates(some)}
    assert np.mean([(n, k) in got for n, k in enumerate(want)]) >= 0.98
    monkeypatch.setattr(p09_leaks, "COSINE", -1.0)
    every = {(start + t, k) for start, some in p09_leaks.spans(planted) for t, k, _, _ in search.candidates(some)}
    assert len(every) > 2 * len(got)


def test_paraphrases_need_their_answer_words(spark):
    words = [f"term{k}" for k in range(18)] + ["417", "zanzibar", "quorum"] + [f"word{k}" for k in range(19)]
    text = " ".join(words)
    loose = " ".join(w for k, w in enumerate(words[8:34]) if k % 5 != 3)
    docs = spark.createDataFrame([(1, text), (2, loose), (3, loose.replace("417", "88").replace("zanzibar", "x").replace("quorum", "y"))] + [(10 + k, " ".join(sorted(w for w in words if w[0] in "tw"))) for k in range(3)] + [(20 + k, f"filler text number {k} of no item") for k in range(40)], "doc_id bigint, text string")
    rows = {r.doc_id: r.kind for r in p09_leaks.leak_evidence(docs, spark.createDataFrame([(1, text)], "item_id bigint, text string")).collect()}
    assert rows == {1: "run", 2: "paraphrase"}


def test_search_misses_no_planted_run(spark, data):
    from millrace.sources import table

    items = p09_leaks.Items(sorted((r.item_id, r.text) for r in table(spark, data, "benchmark").collect()))
    docs = [(r.doc_id, p09_leaks.to_ids(r.text, items.vocabulary).tolist()) for r in table(spark, data, "documents", "doc_id", "text").collect()]
    want = {(d, items.ids[k]) for d, ids in docs for k, item in enumerate(items.words) if len(set(ids) & items.sets[k]) >= 8 and p09_leaks.shared_run(item, ids)}
    got = {tuple(r) for r in p09_leaks.leaked_items(table(spark, data, "documents"), table(spark, data, "benchmark")).collect()}
    assert got == want


def test_toxicity(spark):
    rows = [(k, "s", "You are a filthy idiot, and everyone in packing knows it." if k % 5 == 0 else "Work on the ledger begins in June.") for k in range(60)] + [(100, None, None), (101, None, ""), (102, "t", "quiet words " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").transform(clashing)
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(40)] + [(1, 0), (None, 1), (3, None)], "doc_id bigint, toxic int")
    assert sorted(r[0] for r in p10_toxic.toxic_documents(docs, labels).collect()) == list(range(0, 60, 5))
    rates = {r.source: r for r in p10_toxic.source_rates(docs, labels).collect()}
    assert rates["s"].documents == 60 and rates["s"].flagged == 12 and rates[None].flagged == 0
    assert p10_toxic.toxic_documents(docs.limit(0), labels).count() == 0 and p10_toxic.score_documents(docs, p10_toxic.train(docs, labels.limit(0))).count() == 63


def test_document_labels_alone_teach_the_sentences():
    clean = ["Work on the ledger begins in June. Bring a pen.", "The yard opens at six. Tea is free.", "We mend nets in Bodo. Come by."]
    bad = "you utter grumblefluff"
    texts = [f"{clean[k % 3]} {bad if k % 4 == 0 else 'All are well'}, said the man. {clean[(k + 1) % 3]}" for k in range(120)]
    model = p10_toxic.fit(texts, [float(k % 4 == 0) for k in range(120)], seed_words=())
    reader = p10_toxic.Reader(model.common)
    score, place = model.document(reader.sentences(f"The yard opens at six. {bad}, said she. Tea is free."))
    assert score > 0.5 and place == 1 and model.document(reader.sentences(" ".join(clean)))[0] < 0.5


def test_durable_uses_the_shared_folder(spark):
    assert durable(spark.range(5)).count() == 5
