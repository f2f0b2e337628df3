"""Variant spellings of organisations' names, linked within a job.

Names are read through their dressings (legal forms, look-alike letters, case, joined or parted
words, possessives) into a distinctive part and generic parts (line of business, first name).
The distinctive parts become vectors of character 4-grams weighted by inverse document
frequency; a distributed sparse join within each job finds the pairs whose cosine reaches a
threshold. The join runs over each vector's heaviest grams only: the grams left out have a
norm below the threshold, so a pair that shares no other gram cannot reach it, and the
commonest grams, whose blocks would be large, fall away. It yields candidates; their cosine is
then taken from the whole vectors. An own web site links the names that
use it; a site whose names for the larger part belong to no one cluster is a job board and links nothing. Linked names
form small blocks, and average-linkage clustering within each block decides. Names of one site,
and names read alike of which no two have different sites, start together; the similarity of
others grows with the cosine of their vectors where edits, order or abbreviation explain the
difference, and names with different own sites, different lines of business or different first
names repel each other. The words of a name are compared in any order.

Defined results: null and blank names and null jobs link to nothing; names without a letter are
compared by nothing but their site or their initials; records with the same name string are no pair; a repeated
row of one record gives no pair with itself and each pair comes out once.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import blank, durable, narrow

GRAM, COSINE = 4, 0.18
#: Buckets in which the frequencies of grams are counted: as many as there are grams of Latin letters, digits and the two ends.
BUCKETS = 1 << 21
#: Clusters merge while their average similarity is at least this.
LINKAGE = 0.45
#: A site is shared by organisations where so large a share of its names lies outside its largest cluster, and so many clusters differ.
BOARD_SHARE, BOARD_FIRMS = 1 / 3, 3
#: Legal forms.
LEGAL = frozenset("inc ltd limited llc plc corp co gmbh sa bv nv ag srl sarl oy ab pty llp lp corporation incorporated company".split())
#: Lines of business and what firms of persons call themselves.
SECTORS = tuple(
    "marine furniture textiles aviation publishing software energy holdings healthcare partners sons services industries foods robotics packaging solutions analytics laboratories development "
    "manufacturing consulting motors logistics technologies engineering design associates education insurance construction catering law international bakery systems pharmaceuticals studio office "
    "telecommunications people brothers group capital finance media security mining properties retail transport travel trading ventures hotels clinic school university bank".split()
)
#: Their usual abbreviations.
SHORT = {
    "dev": "development", "health": "healthcare", "log": "logistics", "svcs": "services", "svc": "services", "soln": "solutions", "inds": "industries", "ind": "industries", "labs": "laboratories",
    "lab": "laboratories", "mfg": "manufacturing", "tech": "technologies", "constr": "construction", "intl": "international", "educ": "education", "edu": "education", "robot": "robotics",
    "assoc": "associates", "eng": "engineering", "engr": "engineering", "ins": "insurance", "pharma": "pharmaceuticals", "cons": "consulting", "telecom": "telecommunications", "sys": "systems",
    "std": "studio", "off": "office", "bros": "brothers", "pkg": "packaging", "pub": "publishing", "hldgs": "holdings", "grp": "group", "furn": "furniture", "text": "textiles",
    "av": "aviation", "soft": "software", "anal": "analytics", "food": "foods", "cat": "catering", "part": "partners", "serv": "services", "sol": "solutions",
}
#: First names and what their bearers are called.
NICKNAMES = {
    "josephine": "jo josie", "elizabeth": "liz beth lizzie eliza betty", "alexander": "sasha alex sandy", "richard": "dick rick rich", "robert": "bob rob bobby", "william": "bill will billy",
    "nicholas": "nick nicky", "susannah": "sue susan suzy", "eleanor": "nell ellie nora", "michael": "mick mike mickey", "theodore": "ted theo teddy", "charles": "chuck charlie",
    "katherine": "kate kathy katie kat", "benjamin": "ben benny", "frederick": "fred freddie", "margaret": "peggy maggie meg", "james": "jim jimmy", "john": "jack johnny", "thomas": "tom tommy",
    "edward": "ed eddie ned", "anthony": "tony", "patricia": "pat patty", "jennifer": "jen jenny", "joseph": "joe joey", "daniel": "dan danny", "samuel": "sam sammy", "matthew": "matt",
    "andrew": "andy drew", "christopher": "chris", "victoria": "vicky", "rebecca": "becky", "deborah": "debbie", "lawrence": "larry", "henry": "harry hank", "dorothy": "dot", "david": "dave",
}
FILLERS = frozenset(("of", "the", "and", "de", "la", "und", "et", "y"))
#: Letters of other scripts that look like Latin ones, and digits in place of letters.
LOOKALIKES = str.maketrans("аеорсухкіѕјԁһӏвмнтАЕОРСУХКІЅЈВМНТαοερικνυτΑΟΕΡΙΚΝΥΤ", "aeopcyxkisjdhlbmhtAEOPCYXKISJBMHTaoepiknytAOEPIKNYT")
DIGITS = str.maketrans("0134578$@!|", "oieastbsaii")
WORD = re.compile(r"[^\W_]+")


def mistyped(token: str, word: str) -> bool:
    """Whether a token is a short word with one letter too many or two letters swapped."""
    if len(token) == len(word):
        return token != word and sorted(token) == sorted(word)
    return len(token) == len(word) + 1 and any(token[:k] + token[k + 1 :] == word for k in range(len(token)))


def deletions(word: str, depth: int) -> set[str]:
    out, edge = {word}, {word}
    for _ in range(depth):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))}
        out |= edge
    return out


def distance(a: str, b: str, most: int) -> int:
    """Edits between two strings, a swap of neighbours being one; ``most`` + 1 where there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


class Reader:
    """Names to (distinctive part, lines of business, first name, initials, kind)."""

    def __init__(self) -> None:
        self.exact: dict[str, tuple[str, str]] = {w: ("sector", w) for w in SECTORS} | {s: ("sector", w) for s, w in SHORT.items()}
        for name, nicks in NICKNAMES.items():
            self.exact[name] = ("first", name)
            for nick in nicks.split():
                self.exact.setdefault(nick, ("first", name))
        self.near: dict[str, list[str]] = {}
        for word in [*SECTORS, *NICKNAMES]:
            if len(word) >= 5:
                for d in deletions(word, 1 if len(word) < 7 else 2):
                    self.near.setdefault(d, []).append(word)
        self.ends = {(w[0], w[-1]) for w in [*SECTORS, *NICKNAMES] if len(w) >= 7}
        self.known: dict[str, tuple[str, str]] = {}

    def kind(self, token: str) -> tuple[str, str]:
        """("sector" | "first" | "own", canonical word) of a token, typing errors allowed for."""
        found = self.exact.get(token) or self.known.get(token)
        if found is None:
            found = ("own", token)
            if len(token) >= 4:
                most = 1 if len(token) < 7 else 2
                best = most + 1
                # two letters off on either side are looked for only where an end of the token is a word's
                ends = (token[0], token[-1]) in self.ends and len(token) >= 7
                for d in deletions(token, 2 if ends else 1):
                    for word in self.near.get(d, ()):
                        e = distance(token, word, most)
                        if e < best:
                            best, found = e, (self.exact[word][0], word)
            if len(self.known) < 500_000:
                self.known[token] = found
        return found

    def read(self, raw: str) -> tuple[str, list[str], str, str, str]:
        self.bag = ""
        text = unicodedata.normalize("NFKC", raw).translate(LOOKALIKES)
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
        text = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", text)
        shouted = text.isupper()
        own = bool(re.search(r"['’]s\b", text, re.IGNORECASE))
        text = re.sub(r"['’]s\b", " ", text, flags=re.IGNORECASE).replace("&", " and ").replace("_", " ")
        text = re.sub(r"\b(?:s\.a|b\.v|n\.v|g\.m\.b\.h|l\.l\.c|p\.l\.c)\b\.?", " ", text, flags=re.IGNORECASE)
        tokens = []
        for token in WORD.findall(text):
            small = token.lower()
            if not small.isalpha() and not small.isdigit():
                small = small.translate(DIGITS)
            tokens.append(small)
        while len(tokens) > 1 and tokens[-1] in LEGAL:
            tokens.pop()
        letters = [t for t in tokens if len(t) == 1]
        if len(letters) == len(tokens) and len(tokens) > 1:
            return "#" + "".join(tokens), [], "", "".join(tokens), "initials"
        if len(tokens) == 1 and len(tokens[0]) <= 5 and shouted and tokens[0] not in self.exact:
            return "#" + tokens[0], [], "", tokens[0], "initials"
        # parted words ("kath erine") are put together, joined ones ("vellorfoods") taken apart
        joined: list[str] = []
        k = 0
        while k < len(tokens):
            if k + 1 < len(tokens) and len(tokens[k]) > 1 and tokens[k + 1] not in FILLERS:
                both = tokens[k] + tokens[k + 1]
                if both in self.exact or (self.kind(tokens[k])[0] == "own" and self.kind(tokens[k + 1])[0] == "own" and len(both) >= 6 and self.kind(both)[0] != "own"):
                    joined.append(both)
                    k += 2
                    continue
            token = tokens[k]
            if len(token) > 11 and self.kind(token)[0] == "own":
                for word in SECTORS:
                    if len(word) >= 5 and token.endswith(word) and len(token) - len(word) >= 4:
                        joined += [token[: -len(word)], word]
                        token = ""
                        break
            if token:
                joined.append(token)
            k += 1
        distinctive, sectors, first, initials = [], [], "", ""
        for token in joined:
            if token in FILLERS or (distinctive and mistyped(token, "and")):
                continue
            initials += token[0]
            kind, word = self.kind("law" if mistyped(token, "law") and "office" in joined else token)
            if kind == "sector":
                if word not in sectors:
                    sectors.append(word)
            elif kind == "first" and not first:
                first = word
            elif len(token) == 1 and not first:
                first = token
            else:
                distinctive.append(token)
        if not distinctive and first and len(first) > 1:
            distinctive, first = [first], ""
        if sectors == ["people"]:
            sectors = []
        self.bag = " ".join(sorted(distinctive))
        return "".join(distinctive), sorted(sectors), first, initials, "possessive" if own else "plain"


def first_names_agree(a: str, b: str) -> bool:
    return not a or not b or a == b or a[0] == b[0] and (len(a) == 1 or len(b) == 1)


def business_bits(sectors: list[str]) -> int:
    """Lines of business as bits of one number."""
    return sum(1 << SECTORS.index(w) for w in sectors)


def businesses_agree(a: int, b: int) -> float:
    """1 for the same lines of business, less where one side names none or fewer, -1 where they differ."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.8
    return 0.6 if a & b in (a, b) else -1.0


def edits_allowed(length: int) -> int:
    return 1 if length <= 5 else 2 if length <= 13 else 3


def same_but_one_short(a: list[str], b: list[str]) -> bool:
    """Whether the words are the same but for one, which abbreviates its counterpart ("mo" for "mohammed")."""
    if len(a) != len(b) or len(a) < 2:
        return False
    x, y = sorted((Counter(a) - Counter(b)).elements()), sorted((Counter(b) - Counter(a)).elements())
    if len(x) != 1 or len(y) != 1:
        return False
    short, long = sorted((x[0], y[0]), key=len)
    return 2 <= len(short) < len(long) and long.startswith(short) and any(len(w) >= 4 for w in a if w in b)


def similarity(a: dict, b: dict, cosine: Callable[[str, str], float] | None = None) -> float:
    """From -1 (cannot be the same) over 0 (nothing known) to 1; ``cosine`` is that of the distinctive parts' vectors."""
    sites, others = a["sites"], b["sites"]
    if sites and others:
        return 1.0 if set(sites) & set(others) else -1.0
    x, y = a["own"], b["own"]
    if x[:1] == "#" or y[:1] == "#":
        if x == y:
            return 0.9
        if x[:1] == "#" and y[:1] == "#":
            return -0.5
        return 0.7 if len(a["initials"]) >= 3 and a["initials"] == b["initials"] else (0.0 if a["initials"] == b["initials"] else -0.3)
    if not x or not y:
        return 0.0
    business = businesses_agree(a["business"], b["business"])
    if business < 0 or not first_names_agree(a["first"], b["first"]):
        return -1.0
    shorter = min(len(x), len(y))
    most = edits_allowed(shorter)
    words, others_words = (a.get("bag") or x).split(), (b.get("bag") or y).split()
    d = min(distance(x, y, most), distance(" ".join(words), " ".join(others_words), most))
    if d <= most:
        if d >= shorter / 2:
            return -0.2
        # an edit costs a tenth, less where the vectors agree all the same
        return business * (1.0 - 0.1 * d * (1.0 - 0.5 * (cosine(x, y) if cosine else 0.0)))
    if same_but_one_short(words, others_words):
        return 0.7 * business
    short, long = (a, b) if len(x) < len(y) else (b, a)
    stem = short["own"]
    if len((short.get("bag") or stem).split()) >= 2 and set((short.get("bag") or stem).split()) < set((long.get("bag") or long["own"]).split()):
        return -0.6  # all of a name of several words, and a further word: firms that share a part of their names
    for cut in (0, 1, 2, 4):
        # "Vellorin Foods" is called Vellors, Vellorey, Vellcorp or Vellor
        if cut and not stem.endswith({1: "s", 2: "ey", 4: "corp"}[cut]):
            continue
        base = stem[: len(stem) - cut]
        if len(base) >= 4 and long["own"].startswith(base) and not short["business"]:
            return 0.6
    return -0.6


def average_linkage(names: list[dict], cosine: Callable[[str, str], float] | None = None) -> list[int]:
    """Cluster number of each name; names that share an own site, or are read alike and differ in no site, start together."""
    n = len(names)
    group = list(range(n))

    def join(k: int, other: int) -> None:
        a, b = group[k], group[other]
        if a != b:
            group[:] = [a if g == b else g for g in group]

    by_site: dict[str, int] = {}
    for k, name in enumerate(names):
        for site in name["sites"]:
            join(by_site.setdefault(site, k), k)
    by_reading: dict[tuple, list[int]] = {}
    for k, name in enumerate(names):
        if name["own"] and name["own"][0] != "#":
            by_reading.setdefault((name["own"], name["business"], name["first"]), []).append(k)
    for alike in by_reading.values():
        if len({group[k] for k in alike if names[k]["sites"]}) <= 1:
            for k in alike[1:]:
                join(alike[0], k)
    labels = sorted(set(group))
    place = {g: k for k, g in enumerate(labels)}
    members: list[list[int]] = [[] for _ in labels]
    for k, g in enumerate(group):
        members[place[g]].append(k)
    m = len(members)
    total: dict[tuple[int, int], float] = {}
    count: dict[tuple[int, int], int] = {}
    for i in range(m):
        for j in range(i + 1, m):
            values = [s for p in members[i] for q in members[j] if (s := similarity(names[p], names[q], cosine)) != 0.0]
            if values:
                total[i, j], count[i, j] = sum(values), len(values)
    alive = set(range(m))
    heap = [(-total[key] / count[key], key) for key in total if total[key] >= LINKAGE * count[key]]
    heapq.heapify(heap)
    while heap:
        value, (i, j) = heapq.heappop(heap)
        if (i, j) not in total or -total[i, j] / count[i, j] != value:
            continue  # one of the two has grown since
        members[i] += members[j]
        alive.discard(j)
        for k in alive - {i}:
            old, new = (min(j, k), max(j, k)), (min(i, k), max(i, k))
            if old in total:
                total[new] = total.get(new, 0.0) + total.pop(old)
                count[new] = count.get(new, 0) + count.pop(old)
                if total[new] >= LINKAGE * count[new]:
                    heapq.heappush(heap, (-total[new] / count[new], new))
        del total[i, j]
    out = [0] * n
    for i in alive:
        for k in members[i]:
            out[k] = i
    return out


NAMES = "job_id bigint, company string, sites array<string>, own string, first string, initials string, business bigint, bag string"


def read_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, text = Reader(), pa.string()
    for batch in batches:
        read = [(*reader.read(c), reader.bag) for c in batch.column(1).to_pylist()]
        own, first, initials = (pa.array([r[k] for r in read], text) for k in (0, 2, 3))
        business = pa.array([business_bits(r[1]) for r in read], pa.int64())
        bag = pa.array([r[5] for r in read], text)
        yield pa.RecordBatch.from_arrays([*batch.columns, own, first, initials, business, bag], ["job_id", "company", "sites", "own", "first", "initials", "business", "bag"])


def site_of(website):
    """Host of a web address without its www, careers, jobs or similar front."""
    host = F.regexp_extract(F.lower(F.trim(website)), r"^(?:[a-z]+://)?(?:[^/@]*@)?([^/:?#\s]+)", 1)
    return F.regexp_replace(host, r"^(?:www\d?|careers?|jobs?|apply|boards?|work|hiring|recruiting|en|de|fr|es|m)\.(?=[^.]+\.)", "")


def shared_by_firms(parts: list[tuple[str, int]]) -> bool:
    """Whether a site is a board, from its (distinctive part, number of names), in falling number.

    Both measures are of the names' spread and not of their number: spellings of one
    organisation, however many, join its cluster.
    """

    def alike(x: str, y: str) -> bool:
        most = edits_allowed(min(len(x), len(y)))
        return distance(x, y, most) <= most

    first, inside, others = parts[0][0], 0, []
    for own, n in parts:
        if alike(own, first):
            inside += n
        elif len(others) < BOARD_FIRMS - 1 and not any(alike(own, x) for x in others):
            others.append(own)
    return len(others) == BOARD_FIRMS - 1 and 1 - inside / sum(n for _, n in parts) >= BOARD_SHARE


def job_boards(used: DataFrame) -> DataFrame:
    """(site) of the sites that several organisations share, from (job_id, company, site).

    A cluster is first what begins alike, so that a row per site and beginning is gathered,
    with the part that most names have; names of initials only are left out, as they fit many.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            own = pa.array([reader.read(c)[0] for c in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), own], ["site", "own"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for parts in batch.column(1).to_pylist():
                keep.append(shared_by_firms(sorted(((p["own"], p["n"]) for p in parts), key=lambda p: (-p[1], p[0]))))
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["site"]).filter(pa.array(keep, pa.bool_()))

    parts = used.select("site", "company").distinct().mapInArrow(read, "site string, own string").where("own <> '' AND NOT startswith(own, '#')")
    spelt = parts.groupBy("site", "own").agg(F.count(F.lit(1)).alias("n"))
    begun = spelt.groupBy("site", F.substring("own", 1, GRAM).alias("beginning")).agg(F.max_by("own", F.struct("n", "own")).alias("own"), F.sum("n").alias("n"))
    gathered = begun.groupBy("site").agg(F.collect_list(F.struct("own", "n")).alias("parts")).where(F.size("parts") >= BOARD_FIRMS)
    return gathered.mapInArrow(judge, "site string")


def named(df: DataFrame) -> DataFrame:
    """(job_id, company, sites, own, first, initials, business) of each distinct name of a job.

    A site that is a board counts for nothing.
    """
    base = narrow(df, job_id="job_id", company="company", website="website").where("job_id IS NOT NULL").where(~blank(F.col("company")))
    typed = base.select("job_id", "company", F.when(~blank(F.col("website")), F.nullif(site_of(F.col("website")), F.lit(""))).alias("site"))
    used = typed.where("site IS NOT NULL")
    boards = job_boards(used)
    own = used.distinct().join(boards, "site", "left_anti").select("job_id", "company", "site")
    every = typed.select("job_id", "company", F.lit(None).cast("string").alias("site")).distinct().unionByName(own)
    return every.groupBy("job_id", "company").agg(F.sort_array(F.collect_set("site")).alias("sites")).mapInArrow(read_names, NAMES)


def grams_of(own: str) -> list[int]:
    """Digests of the different 4-grams of a padded name."""
    padded = f"^{own}$"
    return sorted({zlib.crc32(padded[i : i + GRAM].encode()) for i in range(max(1, len(padded) - GRAM + 1))})


def gram_frequencies(nodes: DataFrame) -> np.ndarray:
    """Names that hold each gram, by the gram's bucket; the number of buckets is fixed, so the table does not grow."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for own in batch.column(0).to_pylist():
                for gram in grams_of(own):
                    total[gram % BUCKETS] += 1
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(held), "n": pa.array(total[held])})

    counts = nodes.select("own").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS)
    out[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    return out


def gram_weights(nodes: DataFrame, total: int) -> np.ndarray:
    """Inverse document frequencies by bucket, four bytes each."""
    return (np.log(max(1, total) / np.maximum(1.0, gram_frequencies(nodes))) + 0.5).astype(np.float32)


def cosine_of(weights: np.ndarray) -> Callable[[str, str], float]:
    """The cosine of two names' vectors; the vectors of the names seen last are kept."""
    vector = lru_cache(20_000)(lambda own: {g: w for w, g in vector_of(own, weights)})

    def cosine(x: str, y: str) -> float:
        v, w = vector(x), vector(y)
        return sum(value * w.get(g, 0.0) for g, value in v.items())

    return cosine


def vector_of(own: str, weights: np.ndarray) -> list[tuple[float, int]]:
    """(weight, gram) of a name in falling weight, of norm 1."""
    vector = sorted(((float(weights[g % BUCKETS]), g) for g in grams_of(own)), reverse=True)
    norm = sum(w * w for w, _ in vector) ** 0.5
    return [(w / norm, g) for w, g in vector]


def near_pairs(nodes: DataFrame, total: int, weights: np.ndarray | None = None) -> DataFrame:
    """(a, b) of the nodes (node, job_id, own, business, sited, bag) that may be one organisation of a job.

    ``total`` is the number of names, for the weights. The cosine of their 4-gram vectors
    reaches the threshold, and either the distinctive parts differ by as few edits as the
    clustering allows or the shorter one, without a line of business, begins the longer one;
    their lines of business do not exclude each other.
    """
    weights = gram_weights(nodes, total) if weights is None else weights
    if "bag" not in nodes.columns:
        nodes = nodes.withColumn("bag", F.col("own"))

    def entries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for node, job, business, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rest = 1.0
                for w, gram in vector_of(own, weights):
                    # grams in falling weight; what follows once the rest's norm is below the threshold is left out
                    if rest < COSINE * COSINE:
                        break
                    rest -= w * w
                    # job and gram in one number; another job's equal number is told apart below
                    key = (job * 0x9E3779B97F4A7C15 + gram) & 0x7FFFFFFFFFFFFFFF
                    for column, value in zip(rows, (node, business, key, w, max(0.0, rest) ** 0.5), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float32(), pa.float32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["node", "business", "key", "w", "rest"])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cosine = cosine_of(weights)
        for batch in batches:
            keep = []
            for x, y, begins, p, q in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5, 6)), strict=True):
                most = edits_allowed(min(len(x), len(y)))
                near = begins or distance(x, y, most) <= most or distance(p, q, most) <= most or same_but_one_short(p.split(), q.split())
                keep.append(near and (x == y or cosine(x, y) >= COSINE))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    entries = nodes.select("node", "job_id", "business", "own").mapInArrow(entries_of, "node bigint, business bigint, key bigint, w float, rest float")
    left, right = entries.alias("l"), entries.alias("r")
    shared = F.col("l.business").bitwiseAND(F.col("r.business"))
    joined = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.node") < F.col("r.node")) & ((shared == F.col("l.business")) | (shared == F.col("r.business"))))
    # what the pair shares besides lies behind the last gram joined on, in both vectors: it adds the product of the rests' norms at most
    most = F.sum(F.col("l.w") * F.col("r.w")) + F.min(F.col("l.rest") * F.col("r.rest"))
    candidates = joined.groupBy(F.col("l.node").alias("a"), F.col("r.node").alias("b")).agg(most.alias("most"))
    near = candidates.where(F.col("most") >= COSINE - 1e-4).select("a", "b")
    for side in ("a", "b"):
        near = near.join(nodes.select(F.col("node").alias(side), F.col("own").alias(f"own_{side}"), F.col("job_id").alias(f"job_{side}"), F.col("business").alias(f"business_{side}"), F.col("sited").alias(f"sited_{side}"), F.col("bag").alias(f"bag_{side}")), side)
    # levenshtein counts a swap of neighbours twice, hence up to twice the edits of the clustering, which are counted after it
    shorter = "least(length(own_a), length(own_b))"
    limit = f"CASE WHEN {shorter} <= 5 THEN 2 WHEN {shorter} <= 13 THEN 4 ELSE 6 END"
    edits = F.expr(f"levenshtein(own_a, own_b) <= {limit} OR levenshtein(bag_a, bag_b) <= {limit} OR (contains(bag_a, ' ') AND contains(bag_b, ' ') AND arrays_overlap(split(bag_a, ' '), split(bag_b, ' ')))")
    # what has a site of its own is known by that: names are compared where one of the two has none
    stem = "(business_{x} = 0 AND length(own_{x}) < length(own_{y}) AND startswith(own_{y}, substring(own_{x}, 1, greatest(4, length(regexp_replace(own_{x}, '(s|ey|corp)$', ''))))))"
    near = near.where("job_a = job_b AND (own_a = own_b OR NOT (sited_a AND sited_b))").withColumn("begins", F.expr(stem.format(x="a", y="b")) | F.expr(stem.format(x="b", y="a")))
    return near.where(edits | F.col("begins")).select("a", "b", "own_a", "own_b", "begins", "bag_a", "bag_b").mapInArrow(reach, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component; rounds of hooking and jumping until nothing changes."""
    both = durable(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), F.least("a", "label").alias("label"))
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        hooked = labels.join(heard, labels["node"] == heard["a"]).select("node", "label", F.least("label", "heard").alias("next"))
        above = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        jumped = durable(hooked.join(above, "next", "left").select("node", "label", F.least("next", F.coalesce("jump", "next")).alias("new")))
        changed = jumped.where(F.col("new") < F.col("label")).limit(1).count()
        labels = jumped.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def clusters(df: DataFrame) -> DataFrame:
    """(job_id, company, block, number, place) of the names that mean the same organisation as another name of their job.

    Block and number name the organisation, place the name within its block.
    """
    short_form = F.col("own").rlike("^(#|$)")
    names = durable(named(df).withColumn("node", F.xxhash64("job_id", "own", "business", F.when(short_form, F.col("company")))))
    nodes = durable(names.where(~short_form).groupBy("node", "job_id", "own", "business").agg(F.max(F.size("sites") > 0).alias("sited"), F.min("bag").alias("bag")))
    total = names.count()
    weights = gram_weights(nodes, total)
    by_site = names.select("job_id", F.explode("sites").alias("site"), "node").distinct()
    anchors = by_site.groupBy("job_id", "site").agg(F.min("node").alias("a"))
    shared = by_site.join(anchors, ["job_id", "site"]).where("a <> node").select("a", F.col("node").alias("b"))
    labels = components(near_pairs(nodes, total, weights).unionByName(shared))
    placed = names.join(labels, "node", "left").withColumn("block", F.coalesce("label", "node")).drop("label")
    # initials without a site of their own mean the one organisation of the job that has them, if there is just one
    alike = Window.partitionBy("job_id", "initials")
    spelt = F.when(~short_form, F.col("block"))
    lonely = short_form & (F.length("initials") >= 3) & (F.size("sites") == 0)
    only = F.when(lonely & (F.min(spelt).over(alike) == F.max(spelt).over(alike)), F.min(spelt).over(alike))
    blocks = placed.withColumn("block", F.coalesce(only, "block"))
    gathered = blocks.groupBy("job_id", "block").agg(F.collect_list(F.struct("company", "own", "business", "first", "initials", "sites", "bag")).alias("names")).where(F.size("names") > 1)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cosine = cosine_of(weights)
        for batch in batches:
            rows = []
            for job, block, members in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                members.sort(key=lambda m: m["company"])
                linked = average_linkage(members, cosine)
                several = {number for number, n in Counter(linked).items() if n > 1}
                rows += [(job, m["company"], block, number, place) for place, (m, number) in enumerate(zip(members, linked, strict=True)) if number in several]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["job_id", "company", "block", "number", "place"])

    return gathered.mapInArrow(link, "job_id bigint, company string, block bigint, number int, place int")


def variant_pairs(df: DataFrame) -> DataFrame:
    """(record_id_a, record_id_b) of the records of one job under different names of one organisation."""
    records = narrow(df, record_id="record_id", job_id="job_id", company="company").where("record_id IS NOT NULL AND job_id IS NOT NULL")
    placed = durable(records.join(clusters(df), ["job_id", "company"]).select("record_id", "block", "number", "place"))
    a, b = placed.alias("a"), placed.alias("b")
    same = (F.col("a.block") == F.col("b.block")) & (F.col("a.number") == F.col("b.number"))
    pairs = a.join(b, same & (F.col("a.record_id") < F.col("b.record_id")) & (F.col("a.place") != F.col("b.place")))
    return pairs.select(F.col("a.record_id").alias("record_id_a"), F.col("b.record_id").alias("record_id_b")).distinct()
