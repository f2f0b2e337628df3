"""The pure parts of the operators against brute force and round trips."""

import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from millrace.llm import p01_names, p02_residue, p03_survivor, p04_split, p06_boilerplate, p08_tokens, p09_leaks, p10_toxic

FOLDER = p08_tokens.TOKENIZER_DIR


@pytest.fixture(scope="module")
def encoder():
    try:
        return p08_tokens.Encoder(p08_tokens.load_ranks(f"{FOLDER}/byte_bpe_50k.tiktoken"))
    except FileNotFoundError:
        pytest.skip("no vocabulary files here")


@pytest.fixture(scope="module")
def tiktoken_encoding(encoder):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=p08_tokens.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def decoded(data: bytes) -> list[int]:
    return [int.from_bytes(data[k : k + 4], "little") for k in range(0, len(data), 4)]


@settings(max_examples=200, deadline=None)
@given(text=hs.text(alphabet="ab \n\t\x1c\x85 　é中😀'sl09.,-ŕ<|>endoftx", max_size=40))
def test_encoding_equals_the_reference_library(encoder, tiktoken_encoding, text):
    assert decoded(encoder.encode(text)) == tiktoken_encoding.encode_ordinary(text)


def test_encoding_of_long_words_and_round_trip(encoder, tiktoken_encoding):
    for text in ("a" * 5000, "xyz" * 3000, "äöü " * 500, "<|endoftext|>", ""):
        ids = decoded(encoder.encode(text))
        assert ids == tiktoken_encoding.encode_ordinary(text) and tiktoken_encoding.decode(ids) == text
    assert encoder.encode(None) == b""


def test_cache_limits_do_not_change_results(encoder, monkeypatch):
    monkeypatch.setattr(p08_tokens, "CACHE_PIECES", 3)
    small = p08_tokens.Encoder(encoder.ranks)
    text = "one two three four five six seven one two three"
    assert small.encode(text) == encoder.encode(text) and len(small.cache) <= 3


def units(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


@settings(max_examples=200, deadline=None)
@given(text=hs.text(alphabet="ab .,\n\r中。😀é́‍", max_size=200), limit=hs.integers(4, 40), overlap=hs.integers(0, 30))
def test_pieces_fit_overlap_and_lose_nothing(text, limit, overlap):
    cuts = p04_split.cut_text(text, limit, overlap)
    rebuilt, end = "", 0
    for k, (a, b) in enumerate(cuts):
        assert units(text[a:b]) <= limit
        if k:
            assert a <= end < b and units(text[a:end]) <= overlap
        rebuilt, end = rebuilt + text[max(a, end) : b], b
    assert rebuilt == text and (len(cuts) == 1) == (units(text) <= limit)


def test_cuts_prefer_strong_places():
    text = "First sentence here. Second one, with more words\n\nThird paragraph begins here and goes on."
    first = p04_split.cut_text(text, 60, 0)[0]
    assert text[: first[1]].endswith("\n\n")


@settings(max_examples=100, deadline=None)
@given(values=hs.lists(hs.integers(0, 6), min_size=1, max_size=60), data=hs.data())
def test_sparse_table_equals_a_scan(values, data):
    import numpy as np

    table = p04_split.SparseTable(np.array(values, np.int8))
    low = data.draw(hs.integers(0, len(values) - 1))
    high = data.draw(hs.integers(low, len(values) - 1))
    best = max(range(low, high + 1), key=lambda k: (values[k], k))
    assert table.strongest(low, high) == best


def test_consensus_emits_an_existing_value():
    votes = [("Senior Backend Engineer", 2.0), ("Backend Engineer", 1.0), ("Senior Backend Enginer", 0.5), ("Sr Backend Engineer", 0.4)]
    assert p03_survivor.closest(votes)[0] == "Senior Backend Engineer"
    assert p03_survivor.closest([("x", 1.0)])[0] == "x"
    assert p03_survivor.closest([("b", 1.0), ("a", 1.0)])[0] == "a"


@settings(max_examples=60, deadline=None)
@given(hs.lists(hs.tuples(hs.text("ab ", max_size=8), hs.floats(0.1, 5)), min_size=1, max_size=8))
def test_consensus_is_one_of_the_values(values):
    assert p03_survivor.closest(values)[0] in [v for v, _ in values]


def brute_run(item: list[int], text: list[int]) -> bool:
    """Whether any stretch of 15 or more item words lies in the text with one edit in ten."""
    for i in range(len(item)):
        for n in range(15, len(item) - i + 1):
            part = item[i : i + n]
            # edits from part to the best matching stretch of the text
            row = [0] * (len(text) + 1)
            for x in part:
                diagonal, row[0] = row[0], row[0] + 1
                for j, y in enumerate(text, 1):
                    diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
            if min(row) * 10 <= n:
                return True
    return False


def test_shared_runs_equal_brute_force():
    rng = random.Random(5)
    missed = 0
    for _ in range(120):
        item = [rng.randrange(200) for _ in range(rng.randrange(15, 34))]
        at, n = rng.randrange(3), rng.randrange(10, 30)
        part = list(item[at : at + n])
        for _ in range(rng.randrange(4)):
            k = rng.randrange(max(1, len(part)))
            rng.choice([lambda k=k: part.__setitem__(k, 999), lambda k=k: part.pop(k), lambda k=k: part.insert(k, 998)])()
        text = [rng.randrange(300, 400) for _ in range(6)] + part + [rng.randrange(300, 400) for _ in range(6)]
        ours, theirs = p09_leaks.shared_run(item, text), brute_run(item, text)
        assert theirs or not ours
        # brute force also counts a run whose first or last word is the edited one
        missed += theirs and not ours
    assert missed <= 6


def test_common_subsequence():
    item = [1, 2, 3, 4, 2, 5]
    places = p09_leaks.bit_places(item)
    assert p09_leaks.common_subsequence([2, 3, 9, 2, 5], places, 6) == 4
    assert p09_leaks.common_subsequence([], places, 6) == 0


@pytest.mark.parametrize(
    ("a", "b", "linked"),
    [
        ("Arkgriquisti Associates", "Aekgriquisti Assoxiates, Ltd.", True),
        ("Benjamin Coryadenomak and Partners", "B. Coryadenomak & Partners Co.", True),
        ("Textiles of Rogmortivru", "ROGMORTIVRU TEXTILES", True),
        ("Ｃｏｒｚａｎ Ｃｏｎｓｔｒｕｃｔｉｏｎ", "Corzan Constr.", True),
        ("Bardarshaf0 Publ1shing", "Bardarshafo Publishing", True),
        ("Arkbar Kipjun Associates", "Arkbar Kipjun Foods", False),
        ("Alexander Vellor Motors", "Robert Vellor Motors", False),
        ("Zulbarex Energy", "Tivnolgri Energy", False),
    ],
)
def test_names(a, b, linked):
    reader = p01_names.Reader()
    names = []
    for raw in (a, b):
        own, sectors, first, initials, _ = reader.read(raw)
        names.append({"company": raw, "own": own, "business": p01_names.business_bits(sectors), "first": first, "initials": initials, "sites": []})
    got = p01_names.average_linkage(names)
    assert (got[0] == got[1]) == linked


def test_sites_decide():
    reader = p01_names.Reader()

    def name(raw, *sites):
        own, sectors, first, initials, _ = reader.read(raw)
        return {"company": raw, "own": own, "business": p01_names.business_bits(sectors), "first": first, "initials": initials, "sites": list(sites)}

    same = p01_names.average_linkage([name("AOM", "a.example"), name("Alexander Ostvin Motors", "a.example")])
    other = p01_names.average_linkage([name("Vellor Foods", "a.example"), name("Vellor Foods Ltd", "b.example")])
    assert same[0] == same[1] and other[0] != other[1]


def test_odd_names_are_read():
    reader = p01_names.Reader()
    for raw in ("", " ", "...", "Ltd", "1234", "😀", "a" * 5000, "A.B.C.", "'s"):
        assert len(reader.read(raw)) == 5


def test_marks_and_explanations():
    assert p02_residue.marks("Dear {{ first_name }}, see ${city} and <your role> [insert team here]")[0] == ["first_name", "city", "role", "team"]
    assert p02_residue.marks("a name in double braces such as {{name}} is filled in later") == ([], [])
    assert p02_residue.marks("[remote] [company] {role} TODO: city")[1] == ["remote", "company", "role", "city"]


def test_faults_and_content():
    for line in ("You need to enable JavaScript to run this career portal.", "404 - this address leads nowhere", "Seite nicht gefunden.", "asdf asdf", "velum lorem tibo pars fusca noctis erat", "Your headline here"):
        assert p02_residue.fault(line), line
    for line in ("Vellor cut page not found errors by 12 percent after Tiv rebuilt the ledger.", "404 applicants came, and Darvin took 67 of them.", "A browser without scripts still shows the Morhep board.", "The lorem of print shops is dead, Vel told us."):
        assert not p02_residue.fault(line), line


def test_cues_stand_in_whatever_matches():
    assert p06_boilerplate.cues(r"\ba\ (?:b|cd)?efg\ \d+ | x[yz(|]{2}(?:foo|bars) | abc?d\+{1,2}(?!long)") == {"efg ", "foo", "bars", "ab"}
    assert p06_boilerplate.cues(r"\d+") == p06_boilerplate.cues("(?:one|)") == p06_boilerplate.cues("(?:one)*") == {""}
    found = p06_boilerplate.finder(r"\bscripts?\ off$ | ^ref:?\ \d+")
    assert found("Scripts off", "scripts off") and found("REF 12", "ref 12") and found("ſcripts off", "ſcripts off")
    assert not found("scripts offline", "scripts offline") and not found("ref x", "ref x")


PIECES = ("JavaScript", "is off", "404", "error", "Ref", ":", "not found", "page", "back to the", "start", "lorem ipsum", "cookies", "ein", "el 3.4.25", "new jobs in", "12", "días", "KI", "ſcripts", "back to top", "| terms", "your title here", " ", ".")


@given(hs.lists(hs.sampled_from(PIECES), max_size=6), hs.sampled_from((str, str.upper, str.lower)))
@settings(max_examples=300, deadline=None)
def test_finder_equals_the_whole_pattern(pieces, case):
    line = " ".join(case(" ".join(pieces)).split())
    for pattern in (p02_residue.FAULTS, p06_boilerplate.PROMPTS):
        assert p06_boilerplate.finder(pattern)(line, line.lower()) == bool(re.search(pattern, line, re.I | re.X)), line


@given(hs.lists(hs.one_of(hs.none(), hs.text(alphabet="aZN\n\r\x1c\x85   .,;:()_éDear", max_size=12), hs.sampled_from(("CompanyName\nx", "Titleé\nN/A", "Dear ,\nTBD", "(　)")))))
@settings(max_examples=300, deadline=None)
def test_lines_with_hints_are_found_in_all_texts_at_once(texts):
    found = p02_residue.hinted_lines(pa.array(texts, pa.string()))
    assert [[x for x in lines if p02_residue.HINT.search(x)] for lines in found] == [[x for x in (text or "").split("\n") if p02_residue.HINT.search(x)] for text in texts]


PAGE = """We use cookies to measure visits.
Jobs / Oslo / Welder / Home
Welder at Vellor Foods
Posted by Ann Bee, Jobs Hub staff
Vellor Foods is hiring a welder for its field group in Oslo, and the shift starts at six.
Life at Vellor house
Those who can test a turbine under pressure will like the week in Oslo.
- Menu planning for the canteen
Share this page: mail, link, print
Painter - Tivnol, Bergen
Our terms are simple: Vellor house pays weekly, says Ann Bee.
© 2024 Jobs Hub. All rights kept.
Back to top"""


def test_main_body():
    body = p06_boilerplate.main_body(PAGE, "Welder at Vellor Foods", "jobshub")
    assert body == {2, 4, 5, 6, 7, 10}
    assert p06_boilerplate.main_body("", None, "") == set() and p06_boilerplate.main_body(" \n ", "x", "") == set()
    assert p06_boilerplate.main_body("Home | Jobs | Help | FAQ\nPlease turn on JavaScript", None, "") == {1}
    assert isinstance(p06_boilerplate.main_body("x" * 200_000, None, ""), set)


def test_disguised_words_are_read():
    read = lambda t: p10_toxic.Reader().sentences(t)[0]
    assert read("you IDI0T") == ["you", "idiot"]
    assert read("N-U-M-B-S-K-U-L-L here") == ["numbskul", "here"]
    assert read("a roooootten day")[1] == "roten"
    assert read("d**n fool")[0] == "*d4n"
    assert p10_toxic.Reader().sentences("") == []


def test_multiple_instance_training_finds_the_sentence():
    rng = random.Random(1)
    places = ["oslo", "bergen", "rome", "paris", "lima"]
    clean = ["the plant needs more hands", "work on the ledger begins in june", "the board named a new head", "travel is paid and meals are covered"]
    bad = ["you are a filthy grobnik and everyone knows it", "shut up you useless grobnik"]
    texts, labels = [], []
    for k in range(240):
        rows = [rng.choice(clean) + " " + rng.choice(places) for _ in range(5)]
        if k % 4 == 0:
            rows[rng.randrange(5)] = rng.choice(bad) + " " + rng.choice(places)
        texts.append(". ".join(rows))
        labels.append(float(k % 4 == 0))
    model = p10_toxic.fit(texts[:160], labels[:160])
    reader = p10_toxic.Reader(model.common)
    right = 0
    for text, label in zip(texts[160:], labels[160:], strict=True):
        bag = reader.sentences(text)
        score, place = model.document(bag)
        right += (score >= 0.5) == (label == 1)
        if label == 1:
            assert "grobnik" in bag[place]
    assert right == 80


@pytest.mark.parametrize("size", [400, 3200])
def test_two_sightings_teach_a_word_at_every_size(size):
    texts = [f"the plant needs more hands. travel is paid. desk {'abcdefgh'[k % 8] * 3} opens" for k in range(size)]
    labels = [0.0] * size
    for k in range(0, size, size // 8):
        texts[k], labels[k] = texts[k] + ". shut up you useless grobnik", 1.0
    for k in (7, 11):
        texts[k], labels[k] = texts[k] + ". what a vexbrum", 1.0
    model = p10_toxic.fit(texts, labels)
    assert model.weights.get("vexbrum", 0.0) > 0 and model.weights.get("grobnik", 0.0) > 0


def test_training_without_labels_uses_the_seed_words():
    model = p10_toxic.fit([], [])
    reader = p10_toxic.Reader(model.common)
    assert model.document(reader.sentences("a quiet day in town"))[0] == 0.0
    assert model.document([])[0] == 0.0
