"""Documents that contain passages of held-out evaluation items, whole or in part.

Latent semantic retrieval. The terms are the words of the items; their document frequencies
are counted over the whole corpus. Every passage of the corpus (windows of 16 words) is a
TF-IDF row over these terms, divided by the norm of its whole vector, in which words that no
item has weigh as rare ones. A randomised SVD finds the latent space: each task multiplies its
rows A with a fixed random matrix and returns A'(A omega), one row per term; Spark sums the
rows, and the orthonormal basis of the sum spans the leading right singular vectors (one power
step). In that space each corpus passage is compared with the passages of all items by cosine.
A passage cannot be near an item in the full space when little of its weight lies in the items'
terms (the root of that share bounds the cosine), so such passages end there. A candidate
is checked by the longest common subsequence of passage and item, and then exactly: a run of
at least 15 item words in order, with at most one word in ten changed, left out or added.
Candidates without such a run are paraphrases where most of the item passage's words come in
their order and the answer check holds: the item's answer words (its numbers and rarest words)
there stand in the passage.

The items are read in blocks of ``ITEM_BLOCK``, so vocabulary, basis and item vectors of one
pass have a bound; they alone reach the driver. The corpus is tokenised once for each block,
its word numbers are written to the checkpoint folder, and nothing of it is shuffled, apart
from the sums per term.

Defined results: null, empty and wordless texts and items leak nothing; repeated rows give
one row per (document, item); an item repeated under two ids is reported under both; items of
fewer than 15 words are never given away.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import durable, narrow

WINDOW, STEP, SEARCH_STEP, ITEM_STEP = 16, 8, 4, 4
RANK = 32
LEAST_RUN, ONE_EDIT_IN = 15, 10
#: Cosine in the latent space from which passage and item passage are candidates: of 4,000 planted runs of the least length
#: with an edit it finds 99.85 %, with 0.9 it would find 98.3 %.
COSINE = 0.8
#: Cosine in the full space that a passage must be able to reach.
FULL_COSINE = 0.5
#: Words of a window that a candidate's item must hold in order, and those of a paraphrase.
LEAST_SHARED, PARAPHRASED = 8, 11
UNCHANGED = 6
#: Words of fewer documents than one in so many weigh alike, so that an item that leaked often keeps its weight.
RARE = 100
#: Answer words of an item passage: its numbers and so many rarest words, of which so large a share must be there.
ANSWER_WORDS, ANSWERED = 3, 0.75
#: Items of one pass over the corpus, and positions of text that are in work at once.
ITEM_BLOCK, SPAN = 4_000, 60_000
WORD = re.compile(r"[^\W_]+").findall


def words(text: str | None) -> list[str]:
    return WORD(text.lower()) if text else []


def starts(n: int, step: int) -> range:
    """Window starts that cover n words; the last window may be short."""
    return range(0, max(1, n - WINDOW + step), step) if n else range(0)


def bit_places(item: list[int]) -> dict[int, int]:
    """For each word of an item the places where it stands, as bits."""
    out: dict[int, int] = {}
    for i, w in enumerate(item):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Items:
    """Vocabulary and words of the items."""

    def __init__(self, rows: list[tuple[int, str]]):
        read = [(i, words(t)) for i, t in rows]
        read = [(i, w) for i, w in read if w]
        self.ids = [i for i, _ in read]
        texts = [w for _, w in read]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
        self.words = [[self.vocabulary[w] for w in t] for t in texts]
        self.sets = [frozenset(t) for t in self.words]
        # 15 words with one edit, or 20 with two, hold six in a row unchanged, and so does any longer run
        self.grams = [frozenset(zip(*(t[k:] for k in range(UNCHANGED)), strict=False)) for t in self.words]
        self.places = [bit_places(t) for t in self.words]

    def passages(self) -> tuple[list[list[int]], list[int]]:
        out, owner = [], []
        for k, item in enumerate(self.words):
            for s in starts(len(item), ITEM_STEP):
                out.append(item[s : s + WINDOW])
                owner.append(k)
        return out, owner


def common_subsequence(a: list[int], places: dict[int, int], length: int) -> int:
    """Length of the longest common subsequence of ``a`` and an item, with one bit for each item word."""
    full = (1 << length) - 1
    row = full
    for x in a:
        matched = row & places.get(x, 0)
        row = ((row + matched) | (row - matched)) & full
    return length - row.bit_count()


def shared_run(item: list[int], text: list[int]) -> bool:
    """Whether text holds LEAST_RUN item words in a row, up to one word in ONE_EDIT_IN edited.

    Maximal equal runs of two words or more are chained: the gap between two runs costs as many
    edits as its longer side has words. A chain from run to run keeps its start, so every
    chain's words and edits are known where it ends.
    """
    places: dict[int, list[int]] = {}
    for i, w in enumerate(item):
        places.setdefault(w, []).append(i)
    runs = []  # (item start, text start, length)
    for j, w in enumerate(text):
        for i in places.get(w, ()):
            if i and j and item[i - 1] == text[j - 1]:
                continue
            n = 1
            while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n]:
                n += 1
            if n >= LEAST_RUN:
                return True
            if n >= 2:
                runs.append((i, j, n))
    budget = len(item) // ONE_EDIT_IN
    ends: list[list[tuple[int, int]]] = []  # of each run the chains that end in it: (item start, edits)
    for k, (i, j, n) in enumerate(runs):
        chains = {i: 0}
        for m in range(k):
            pi, pj, pn = runs[m]
            # a run may overlap the one before by repeated words; the overlap is cut off
            cut = max(0, pi + pn - i, pj + pn - j)
            di, dj = i + cut - pi - pn, j + cut - pj - pn
            if cut >= n or di < 0 or dj < 0:
                continue
            edits = max(di, dj)
            if edits > budget:
                continue
            for first, e in ends[m]:
                total = e + edits
                if total <= budget and total < chains.get(first, budget + 1):
                    chains[first] = total
        for first, e in chains.items():
            covered = i + n - first
            if covered >= LEAST_RUN and e * ONE_EDIT_IN <= covered:
                return True
        ends.append(list(chains.items()))
    return False


def to_ids(text: str | None, vocabulary: dict[str, int]) -> np.ndarray:
    """Numbers of the words of a text, -1 for words of no item."""
    found = words(text)
    return np.fromiter(map(vocabulary.get, found, repeat(-1)), np.int32, len(found))


class Weights:
    """TF-IDF weights by word number; the last two places are words of no item and padding."""

    def __init__(self, frequency: np.ndarray, documents: int):
        idf = np.minimum(np.log((1 + documents) / (1 + frequency)), np.log(RARE)) + 0.1
        self.known = np.append(idf, [0.0, 0.0]).astype(np.float32)
        self.mass = np.append(idf**2, [(min(np.log(1 + documents), np.log(RARE)) + 0.1) ** 2, 0.0]).astype(np.float32)
        self.terms = len(idf)

    def layout(self, texts: list[np.ndarray], step: int) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of several texts in blocks of ``step``, a window's padding after each, and each text's first place."""
        sizes = np.array([-(-len(t) // step) * step + WINDOW for t in texts], np.int64)
        first = np.concatenate(([0], np.cumsum(sizes)))
        flat = np.full(int(first[-1]), self.terms + 1, np.int64)
        for t, at in zip(texts, first.tolist(), strict=False):
            flat[at : at + len(t)] = np.where(t < 0, self.terms, t)
        return flat, first

    def block_sums(self, values: np.ndarray, step: int) -> np.ndarray:
        """Sums over the windows that begin at each block of ``step`` values."""
        sums = values.reshape(-1, step).sum(axis=1)
        padded = np.concatenate((sums, np.zeros(WINDOW // step, sums.dtype)))
        return sum(padded[k : k + len(sums)] for k in range(WINDOW // step))


def spans(texts: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Neighbouring texts up to SPAN words together, with the number of the first; a longer text stands alone."""
    start = total = 0
    for k, t in enumerate(texts):
        if total and total + len(t) > SPAN:
            yield start, texts[start:k]
            start, total = k, 0
        total += len(t)
    if start < len(texts):
        yield start, texts[start:]


def gram_product(texts: list[np.ndarray], weights: Weights, omega: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, rows) of A'(A omega), A being the unit TF-IDF rows of all windows of the texts."""
    flat, _ = weights.layout(texts, STEP)
    norm2 = weights.block_sums(weights.mass[flat], STEP)
    at = np.flatnonzero(flat < weights.terms)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros((0, omega.shape[1]), np.float32)
    term, block = flat[at], at // STEP
    w = weights.known[term][:, None]
    begins = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    sums = np.zeros((len(norm2) + 1, omega.shape[1]), np.float32)
    sums[block[begins]] = np.add.reduceat(w * omega[term], begins, axis=0)
    projected = (sums[:-1] + sums[1:]) / np.maximum(norm2, 1e-9)[:, None]
    projected[1:] += projected[:-1].copy()  # a block lies in the window that begins there and in the one before
    order = np.argsort(term, kind="stable")
    ordered = term[order]
    begins = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[begins], np.add.reduceat(w[order] * projected[block[order]], begins, axis=0)


def numbered(source: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(id, words): the texts as word numbers of four bytes, written once."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [to_ids(text, vocabulary).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "words"])

    return durable(source.mapInArrow(number, f"id {source.schema['id'].dataType.simpleString()}, words binary"))


def read_numbers(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32) for x in column.to_pylist()]


def document_frequencies(corpus: DataFrame, terms: int) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and the number of documents, over the whole corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(terms + 1, np.int64)
        for batch in batches:
            seen[terms] += batch.num_rows
            for ids in read_numbers(batch.column(0)):
                if len(ids):
                    here = np.unique(ids)
                    seen[here[here >= 0]] += 1
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"term": pa.array(held), "n": pa.array(seen[held])})

    # at most one row for each word of the items
    rows = corpus.select("words").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(terms + 1)
    for row in rows:
        frequency[row.term] = row.n
    return frequency[:-1], int(frequency[-1])


def latent_basis(corpus: DataFrame, items: Items, weights: Weights) -> np.ndarray:
    """Orthonormal basis (terms x rank) of the leading right singular vectors of all passages of corpus and items."""
    rank = min(RANK, weights.terms)
    omega = np.random.default_rng(7).standard_normal((weights.terms, rank)).astype(np.float32)
    names = [f"z{k}" for k in range(rank)]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(omega.shape)
        for batch in batches:
            for _, texts in spans(read_numbers(batch.column(0))):
                held, rows = gram_product(texts, weights, omega)
                total[held] += rows
        rows = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows)] + [pa.array(total[rows, k]) for k in range(rank)], ["term", *names])

    parts = corpus.select("words").mapInArrow(multiply, "term bigint, " + ", ".join(f"{c} double" for c in names))
    total = np.zeros(omega.shape)
    held, rows = gram_product([np.array(t, np.int32) for t in items.words], weights, omega)
    total[held] += rows
    for row in parts.groupBy("term").agg(*[F.sum(c).alias(c) for c in names]).collect():  # one row for each word of the items
        total[row.term] += np.array(row[1:])
    return np.linalg.qr(total)[0].astype(np.float32)


def unit_sums(places: np.ndarray, weighted: np.ndarray) -> np.ndarray:
    """Unit vectors in the latent space of windows given by their word numbers."""
    out = np.zeros((len(places), weighted.shape[1]), np.float32)
    for k in range(places.shape[1]):
        out += weighted[places[:, k]]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Search:
    """Finds the items that texts give away; built once on the driver, its size follows the items of the block."""

    def __init__(self, items: Items, weights: Weights, basis: np.ndarray):
        self.items, self.weights = items, weights
        self.weighted = np.vstack([weights.known[:-2, None] * basis, np.zeros((2, basis.shape[1]), np.float32)])
        passages, owner = items.passages()
        padded = np.full((len(passages), WINDOW), weights.terms + 1, np.int64)
        for k, p in enumerate(passages):
            padded[k, : len(p)] = p
        self.vectors = unit_sums(padded, self.weighted)
        self.owner = np.array(owner)
        self.numbers = frozenset(k for w, k in items.vocabulary.items() if w.isdigit())

    def candidates(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, list[int], float]]:
        """(text, item, starts of the near windows, greatest cosine) of the pairs that are near in the latent space."""
        weights = self.weights
        flat, first = weights.layout(texts, SEARCH_STEP)
        known = weights.block_sums(weights.known[flat] ** 2, SEARCH_STEP)
        whole = weights.block_sums(weights.mass[flat], SEARCH_STEP)
        begins = np.flatnonzero((known > 0) & (known >= FULL_COSINE**2 * whole)) * SEARCH_STEP
        begins = begins[begins + WINDOW <= len(flat)]
        for low in range(0, len(begins), 2_000):
            some = begins[low : low + 2_000]
            cosines = unit_sums(flat[some[:, None] + np.arange(WINDOW)], self.weighted) @ self.vectors.T
            window, passage = np.divmod(np.flatnonzero(cosines >= COSINE), cosines.shape[1])
            text = np.searchsorted(first, some[window], side="right") - 1
            pairs: dict[tuple[int, int], tuple[set[int], float]] = {}
            for t, k, at, cosine in zip(text.tolist(), self.owner[passage].tolist(), (some[window] - first[text]).tolist(), cosines[window, passage].tolist(), strict=True):
                begun, best = pairs.get((t, k), (set(), 0.0))
                begun.add(at)
                pairs[t, k] = (begun, max(best, cosine))
            for (t, k), (begun, best) in pairs.items():
                yield t, k, sorted(begun), best

    def answered(self, item: list[int], window: list[int]) -> bool:
        """Whether the answer words of the item passage that the window is nearest to stand in the window."""
        there = set(window)
        passage = max((item[s : s + WINDOW] for s in starts(len(item), ITEM_STEP)), key=lambda p: len(there.intersection(p)))
        rare = sorted(set(passage), key=lambda w: (-self.weights.known[w], w))[:ANSWER_WORDS]
        answers = {w for w in passage if w in self.numbers}.union(rare)
        return len(answers & there) >= ANSWERED * len(answers)

    def evidence(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, str, float, int]]:
        """(text, item, kind, cosine, common words in order) of the candidates that the checks confirm."""
        items, lists = self.items, {}
        for t, k, begins, cosine in self.candidates(texts):
            item = items.words[k]
            if len(item) < LEAST_RUN:
                continue
            if t not in lists:
                lists = {t: texts[t].tolist()}
            whole = lists[t]
            common, s = max((common_subsequence(whole[s : s + WINDOW], items.places[k], len(item)), -s) for s in begins)
            if common < LEAST_SHARED:
                continue
            reach = len(item) + WINDOW
            near = whole[max(0, min(begins) - reach) : max(begins) + WINDOW + reach]
            # a run holds UNCHANGED words in a row as they are in the item, so without such a row there is none
            if not items.grams[k].isdisjoint(zip(*(near[j:] for j in range(UNCHANGED)), strict=False)) and shared_run(item, near):
                yield t, k, "run", cosine, common
            elif common >= PARAPHRASED and self.answered(item, whole[-s : -s + WINDOW]):
                yield t, k, "paraphrase", cosine, common


def blocks_of_items(benchmark: DataFrame) -> Iterator[Items]:
    """The items, ITEM_BLOCK at a time."""
    rows = narrow(benchmark, item_id="item_id", text="text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct().orderBy("item_id", "text").toLocalIterator()
    while some := [(r.item_id, r.text) for r in islice(rows, ITEM_BLOCK)]:
        items = Items(some)
        if items.vocabulary:
            yield items


def leak_evidence(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, kind, cosine, common) of every item that a document gives away or paraphrases."""
    source = narrow(documents, id=id_col, text=text_col).where("id IS NOT NULL AND text IS NOT NULL")
    id_type = source.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, item_id bigint, kind string, cosine double, common int"
    found = None
    for items in blocks_of_items(benchmark):
        corpus = numbered(source, items.vocabulary)
        weights = Weights(*document_frequencies(corpus, len(items.vocabulary)))
        search = Search(items, weights, latent_basis(corpus, items, weights))

        def look(batches: Iterator[pa.RecordBatch], search: Search = search) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), []
                for start, texts in spans(read_numbers(batch.column(1))):
                    rows += [(ids[start + t], search.items.ids[k], *rest) for t, k, *rest in search.evidence(texts)]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                types = [batch.column(0).type, pa.int64(), pa.string(), pa.float64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", "item_id", "kind", "cosine", "common"])

        part = corpus.mapInArrow(look, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = documents.sparkSession.createDataFrame([], schema)
    # a repeated row, or a pair of two spans of windows: the surest evidence counts, a run before a paraphrase
    best = F.max(F.struct((F.col("kind") == "run").alias("run"), "common", "cosine", "kind"))
    return found.groupBy("id", "item_id").agg(best.alias("b")).select(F.col("id").alias(id_col), "item_id", "b.kind", "b.cosine", "b.common")


def leaked_items(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id) of every document that gives away an item."""
    return leak_evidence(documents, benchmark, id_col, text_col).where("kind = 'run'").select(id_col, "item_id")


def leak_counts(leaks: DataFrame) -> DataFrame:
    """(item_id, documents): how many documents give each item away."""
    return leaks.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
