"""Encoding of a corpus with a public byte-level BPE vocabulary.

Words are cut by the vocabulary's pattern; the bytes of a word are merged with a segment tree
over the byte positions whose nodes keep the leftmost smallest pair rank. A merge updates the
live neighbours only, each in logarithmic time, so even a word of a million bytes is encoded
in n log n steps. Pieces seen before come from a cache of bounded size; the cache changes the
speed, never the result.

Defined results: null and empty texts give an empty list; strings that look like special
tokens are ordinary text; a repeated row gives a repeated result row.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import narrow

#: Where the public vocabulary files lie, unless the caller names another folder.
TOKENIZER_DIR = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")
#: Cached pieces per Python worker; the oldest half goes when it is full.
CACHE_PIECES = 400_000
#: Longer pieces are encoded each time and never kept.
CACHE_CHARS = 64
NONE = 1 << 60
#: The vocabulary's own splitting pattern (a fixed value of the public tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` vocabulary file."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: merge the leftmost pair of least rank until no pair has a rank."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    if n == 1:
        return [ranks[word]]
    size = 1
    while size < n:
        size *= 2
    # leaf i holds the rank of the pair that starts at byte i; a node holds rank * size + position,
    # so the smaller number is the smaller rank and, among equal ranks, the position further left
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        rank = ranks.get(word[i : i + 2])
        if rank is not None:
            tree[size + i] = rank * size + i
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    following = list(range(1, n + 1))  # start of the next live piece
    previous = list(range(-1, n))
    get, mask = ranks.get, size - 1
    while (top := tree[1]) < NONE:
        left = top & mask
        gone = following[left]
        after = following[left] = following[gone]
        previous[after] = left
        before = previous[left]
        changes = [(gone, NONE)]
        if after < n and (rank := get(word[left : following[after]])) is not None:
            changes.append((left, rank * size + left))
        else:
            changes.append((left, NONE))
        if before >= 0:
            rank = get(word[before:after])
            changes.append((before, NONE if rank is None else rank * size + before))
        for position, value in changes:
            node = size + position
            if tree[node] == value:
                continue
            tree[node] = value
            node >>= 1
            while node:
                x, y = tree[2 * node], tree[2 * node + 1]
                least = x if x < y else y
                if tree[node] == least:
                    break
                tree[node] = least
                node >>= 1
    ids, at = [], 0
    while at < n:
        ids.append(ranks[word[at : following[at]]])
        at = following[at]
    return ids


class Encoder:
    """Texts to ids as little-endian int32 bytes.

    A text is first cut at single spaces between two characters that are no white space: the
    pattern always begins a piece at such a space, so each part can be looked up by itself.
    """

    def __init__(self, ranks: dict[bytes, int]):
        import re

        import regex

        self.ranks = ranks
        self.words = regex.compile(PATTERN).findall
        self.parts = re.compile(r"(?<=\S) (?=\S)").split
        self.cache: dict[str, bytes] = {}
        self.word_cache: dict[str, bytes] = {}

    def keep(self, cache: dict[str, bytes], key: str, value: bytes) -> None:
        if len(key) <= CACHE_CHARS:
            if len(cache) >= CACHE_PIECES:
                for old in list(cache)[: CACHE_PIECES // 2]:
                    del cache[old]
            cache[key] = value

    def piece(self, text: str) -> bytes:
        import struct

        out = []
        for word in self.words(text):
            found = self.word_cache.get(word)
            if found is None:
                ids = merge_word(word.encode("utf-8", "replace"), self.ranks)
                found = struct.pack(f"<{len(ids)}i", *ids)
                self.keep(self.word_cache, word, found)
            out.append(found)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        first, *rest = self.parts(text)
        cache, out = self.cache, [self.piece(first)]
        for part in rest:
            found = cache.get(part)
            if found is None:
                found = self.piece(" " + part)
                self.keep(cache, part, found)
            out.append(found)
        return b"".join(out)


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_dir: str | None = None, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """One row (id, ids array<int>) for each row of ``df``; a map over the rows, no shuffle."""
    folder = tokenizer_dir or TOKENIZER_DIR
    source = narrow(df, id=id_col, text=text_col)
    id_type = source.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(load_ranks(f"{folder}/{vocabulary}.tiktoken"))
            parts = [encoder.encode(text) for text in batch.column(1).to_pylist()]
            offsets = np.zeros(len(parts) + 1, np.int32)
            np.cumsum([len(part) // 4 for part in parts], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    return source.mapInArrow(encode, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)
