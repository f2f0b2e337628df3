"""Texts above a size limit are cut into pieces under it, at natural boundaries, with overlap.

Each place between two characters has a strength: paragraph, line, sentence, clause, word. A
sparse table over the strengths of a text's boundaries answers which cut is the strongest in
the permissible window of lengths, the rightmost among equals; the next piece begins up to
``overlap`` before the cut, at a boundary where there is one. Lengths count UTF-16 units.

Defined results: null limits and null texts give no piece; a text within its limit is one
piece, the whole text, also when it is empty; a text without any boundary is cut at the
limit, never inside a surrogate pair, a CR LF pair or before a combining mark while another
place is permitted; a limit below 2, under which some characters do not fit, counts as 2; a
negative or null overlap counts as 0, one that leaves no room for another character counts as
two units less than the limit. With a large overlap a cut is looked for where at least
half of what the overlap leaves is new. A stop after a title or a single letter ("Dr. ",
"J. ") ends no sentence. The pieces without their overlaps, joined in order, are the text.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import narrow, small

#: Configurations up to this number are broadcast; more of them are joined by a shuffle.
MOST_CONFIGURATIONS = 10_000
#: Short words whose stop ends no sentence.
TITLES = frozenset("dr mr mrs ms prof st no vs etc fig eq approx ca e.g i.e z.b bzw nr inc ltd co jr sr".split())
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, CHARACTER = 6, 5, 4, 3, 2, 1


def boundaries(text: str):
    """Positions (code points) with a strength of at least WORD, their strengths, and UTF-16 offsets."""
    import numpy as np

    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    wide = cp > 0xFFFF
    units = None
    if wide.any():
        units = np.zeros(n + 1, np.int64)
        np.cumsum(1 + wide, out=units[1:])
    newline = (cp == 10) | ((cp == 13) & np.append(cp[1:] != 10, True)) | (cp == 0x2028) | (cp == 0x2029)
    space = newline | (cp == 32) | (cp == 9) | (cp == 0x0B) | (cp == 0x0C) | (cp == 0xA0) | (cp == 13) | (cp == 0x3000) | ((cp >= 0x2000) & (cp <= 0x200B))
    stop = np.isin(cp, np.array([46, 33, 63, 0x2026], np.uint32))
    wide_stop = np.isin(cp, np.array([0x3002, 0xFF01, 0xFF1F, 0x0964, 0x06D4, 0x061F], np.uint32))
    comma = np.isin(cp, np.array([44, 59, 58], np.uint32))
    wide_comma = np.isin(cp, np.array([0x3001, 0xFF0C, 0xFF1B, 0xFF1A], np.uint32))
    # strength[i]: a cut after character i
    strength = np.zeros(n, np.int8)
    strength[space] = WORD
    strength[wide_comma] = CLAUSE
    strength[wide_stop] = SENTENCE
    if n > 1:
        before = np.zeros(n, bool)
        before[1:] = space[1:] & comma[:-1]
        strength[before & ~newline] = CLAUSE
        before[1:] = space[1:] & stop[:-1]
        ends = before & ~newline
        for i in np.flatnonzero(ends & np.append(False, cp[:-1] == 46)).tolist():
            word = text[max(0, i - 8) : i - 1].rsplit(None, 1)[-1:] or [""]
            if word[0].lower() in TITLES or (len(word[0]) == 1 and word[0].isalpha()):
                ends[i] = False
        strength[ends] = SENTENCE
    strength[newline] = LINE
    lines = np.flatnonzero(newline)
    if len(lines) > 1:
        # a line end is a paragraph's end when only white space lies between it and the line end before
        filled = np.concatenate(([0], np.cumsum(~space)))
        empty = filled[lines[1:]] == filled[lines[:-1]]
        strength[lines[1:][empty]] = PARAGRAPH
    # white space that goes on after a cut stays with the piece before it
    inner = np.zeros(n, bool)
    inner[:-1] = space[1:] & ~newline[1:] & (strength[:-1] <= SENTENCE)
    strength[inner] = 0
    at = np.flatnonzero(strength[: n - 1]) if n else np.zeros(0, np.int64)
    return at + 1, strength[at], units


class SparseTable:
    """Range maximum in constant time; among equal strengths the rightmost place."""

    def __init__(self, strengths):
        import numpy as np

        n = len(strengths)
        # strength and place in one number: the greatest is the strongest, then the rightmost
        level = strengths.astype(np.int64) * (n + 1) + np.arange(n)
        self.n, self.levels = n, [level]
        width = 1
        while 2 * width <= n:
            level = np.maximum(level[:-width], level[width:])
            self.levels.append(level)
            width *= 2

    def strongest(self, low: int, high: int) -> int:
        """Index of the strongest entry of low..high (both included)."""
        k = (high - low + 1).bit_length() - 1
        level = self.levels[k]
        a, b = int(level[low]), int(level[high - (1 << k) + 1])
        return max(a, b) % (self.n + 1)


def mark(char: str) -> bool:
    import unicodedata

    return char == "‍" or char == "️" or unicodedata.combining(char) != 0


def cut_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces of ``text`` as (start, end) in code points, in order."""
    limit = max(2, limit)
    if len(text) * 2 <= limit or len(text) + sum(c > "￿" for c in text) <= limit:
        return [(0, len(text))]
    places, strengths, units = boundaries(text)
    table = SparseTable(strengths) if len(places) else None
    place = places.tolist()
    n = len(text)
    overlap = max(0, min(overlap, limit - 2))
    # a piece holds at least half of what its overlap leaves as new text, and half of the limit where the overlap is small
    room = max(limit // 2, overlap + (limit - overlap) // 2)
    offset = None if units is None else units.tolist()

    def unit(i: int) -> int:
        return i if offset is None else offset[i]

    def last_within(start_unit: int) -> int:
        """The furthest position whose offset is at most start_unit."""
        return min(n, start_unit) if offset is None else bisect_right(offset, start_unit) - 1

    def strongest(low: int, high: int) -> int | None:
        a, b = bisect_left(place, low), bisect_right(place, high) - 1
        return None if table is None or a > b else place[table.strongest(a, b)]

    out: list[tuple[int, int]] = []
    start = fresh = 0  # fresh: the end of what came out so far
    while True:
        end = last_within(unit(start) + limit)
        if end >= n:
            out.append((start, n))
            return out
        half = bisect_left(offset, unit(start) + room) if offset is not None else start + room
        cut = strongest(max(half, fresh + 1), end) or (strongest(fresh + 1, end) if 2 * overlap <= limit else None)
        if cut is None:
            cut = end
            while cut > max(half, fresh + 1) and (mark(text[cut]) or text[cut - 1] == "‍" or (text[cut - 1] == "\r" and text[cut] == "\n")):
                cut -= 1
        out.append((start, cut))
        fresh = cut
        if not overlap:
            start = cut
            continue
        # the overlap begins at the first boundary within reach, else exactly that far back
        back = cut - overlap if offset is None else bisect_left(offset, unit(cut) - overlap)
        k = bisect_left(place, max(back, start + 1))
        start = place[k] if k < len(place) and place[k] <= cut - (cut - back) // 2 and place[k] < cut else max(back, start + 1)


def bounds_udf():
    """Arrow UDF (text, limit, overlap) -> array of (start, end)."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def piece_bounds(text: pa.Array, limit: pa.Array, overlap: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        out = []
        for t, n, o in zip(text.to_pylist(), limit.to_pylist(), overlap.to_pylist(), strict=True):
            out.append([] if t is None or n is None else [{"start": a, "end": b} for a, b in cut_text(t, n, o or 0)])
        return pa.array(out, kind)

    return piece_bounds


def with_limits(inputs: DataFrame, configurations: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """Inputs with the limits of their configuration; rows without one are left out.

    The smaller limit counts should an id come twice.
    """
    limits = (
        narrow(configurations, config_id="config_id", max_chars="max_chunk_characters", overlap="overlap_characters")
        .where("config_id IS NOT NULL AND max_chars IS NOT NULL")
        .groupBy("config_id")
        .agg(F.min(F.struct("max_chars", "overlap")).alias("c"))
        .select("config_id", "c.max_chars", "c.overlap")
    )
    # without the hint a plan might shuffle the texts by a handful of keys
    return narrow(inputs, config_id="config_id", text="source_text", **{c: c for c in carry}).join(small(limits, MOST_CONFIGURATIONS), "config_id")


def split_inputs(inputs: DataFrame, configurations: DataFrame) -> DataFrame:
    """(input_id, piece_no, n_pieces, start, end, piece) of every text, cut by its configuration."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["input_id", "piece_no", "n_pieces", "start_char", "end_char", "piece"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            rows = []
            for i, text, limit, overlap in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if text is not None:
                    cuts = cut_text(text, limit, overlap or 0)
                    rows += [(i, k, len(cuts), a, b, text[a:b]) for k, (a, b) in enumerate(cuts)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    source = with_limits(inputs, configurations, ("input_id",)).select("input_id", "text", "max_chars", "overlap")
    return source.mapInArrow(pieces, "input_id bigint, piece_no int, n_pieces int, start_char int, end_char int, piece string")


def piece_checks(inputs: DataFrame, configurations: DataFrame) -> DataFrame:
    """(input_id, pieces_join, within_limit, overlap_kept, several) of every text: what its pieces have to satisfy.

    ``pieces_join`` is the MD5 of the pieces joined without their overlaps.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["input_id", "pieces_join", "within_limit", "overlap_kept", "several"]
        types = [pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]
        for batch in batches:
            rows = []
            for i, text, limit, overlap in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if text is None:
                    continue
                cuts, units = cut_text(text, limit, overlap or 0), lambda x: len(x.encode("utf-16-le", "surrogatepass")) // 2
                joined = "".join(text[max(a, before) : b] for (a, b), before in zip(cuts, [0, *(b for _, b in cuts)], strict=False))
                within = all(units(text[a:b]) <= limit for a, b in cuts)
                kept = all(a <= before and units(text[a:before]) <= max(0, overlap or 0) for (a, _), (_, before) in zip(cuts[1:], cuts, strict=False))
                rows.append((i, md5(joined.encode("utf-8", "surrogatepass")).hexdigest(), within, kept, len(cuts) > 1))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    source = with_limits(inputs, configurations, ("input_id",)).select("input_id", "text", "max_chars", "overlap")
    return source.mapInArrow(check, "input_id bigint, pieces_join string, within_limit boolean, overlap_kept boolean, several boolean")


def oversized(inputs: DataFrame, configurations: DataFrame) -> DataFrame:
    """(input_id) of the texts that came out of the splitter in more than one piece."""
    source = with_limits(inputs, configurations, ("input_id",))
    cut = bounds_udf()
    return source.where(F.size(cut("text", "max_chars", "overlap")) > 1).select("input_id").distinct()
