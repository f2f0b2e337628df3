"""Lines that many documents of one source share are found and removed from each document.

The key of a line is what its letters leave: lower case, without white space, signs and
digits. For each source and line the documents are stored as a compressed bitmap: of the bits
of all document ids only the words of 64 bits that hold one are kept, each a row with its
number. The bitmaps of a line's variants (other digits, signs, case) are united by a bitwise
or under their common key, map-side first; cardinalities are the exact bit counts, summed over
the words, so the documents of a hot line are spread over as many tasks as it has words. Lines
to delete are looked up: each line of a document reads the word of its key that its id falls
into, among the bitmaps that reach the threshold, and is deleted where the bit is set.

Defined results: null texts, null sources and null ids have no lines; lines without letters
never count; a line repeated within a document counts as one document; a row that repeats an
id counts once; the cleaned text keeps the order of the other lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import durable, narrow

#: Documents of one source that must share a line before it is removed.
THRESHOLD = 8
WORD_BITS = 6
KEY = ("high", "low")


def line_key(line):
    """The letters of a line in lower case."""
    return F.lower(F.regexp_replace(line, r"[^\p{L}\p{M}]+", ""))


def keyed_lines(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(high, low, word, bit, line_no): each line with letters, under a digest of 128 bits of its source and letters, and the place of its document."""
    base = narrow(df, id=id_col, source=source_col, text=text_col).where("id IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL")
    lines = base.select("id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lettered = lines.select("id", "line_no", "source", line_key(F.col("line")).alias("letters")).where("letters <> ''")
    return lettered.select(
        F.xxhash64("source", "letters").alias("high"), F.xxhash64(F.lit("millrace"), "letters", "source").alias("low"),
        F.shiftright("id", WORD_BITS).alias("word"), F.col("id").bitwiseAND((1 << WORD_BITS) - 1).cast("int").alias("bit"), F.col("line_no").cast("bigint").alias("line_no"),
    )


def bitmaps(lines: DataFrame) -> DataFrame:
    """(high, low, word, bits): the compressed bitmap of each line's documents, its variants united."""
    return lines.groupBy(*KEY, "word").agg(F.bit_or(F.expr("shiftleft(CAST(1 AS BIGINT), bit)")).alias("bits"))


def frequent_bitmaps(lines: DataFrame, threshold: int) -> DataFrame:
    """The bitmaps whose cardinality reaches the threshold."""
    stored = durable(bitmaps(lines))
    frequent = stored.groupBy(*KEY).agg(F.sum(F.bit_count("bits")).alias("documents")).where(F.col("documents") >= threshold)
    return stored.join(frequent.select(*KEY), list(KEY), "left_semi")


def repeated_lines(df: DataFrame, id_col: str = "source_document_id", source_col: str = "domain", text_col: str = "raw_content", threshold: int = THRESHOLD) -> DataFrame:
    """(id, line_no) of every line whose key occurs in at least ``threshold`` documents of its source."""
    lines = keyed_lines(df, id_col, source_col, text_col)
    found = lines.join(frequent_bitmaps(lines, threshold), [*KEY, "word"]).where("shiftrightunsigned(bits, bit) & 1 = 1")
    return found.select((F.shiftleft("word", WORD_BITS) + F.col("bit")).alias(id_col), "line_no").distinct()


def without_repeated_lines(df: DataFrame, id_col: str = "source_document_id", source_col: str = "domain", text_col: str = "raw_content", threshold: int = THRESHOLD) -> DataFrame:
    """(id, text, removed_lines): each text without its repeated lines; null texts stay null."""
    gone = repeated_lines(df, id_col, source_col, text_col, threshold).groupBy(id_col).agg(F.collect_set("line_no").alias("gone"))
    texts = narrow(df, **{id_col: id_col, "text": text_col})
    kept = F.expr(
        "CASE WHEN gone IS NULL THEN text ELSE array_join(filter(split(text, '\\n'), (line, i) -> NOT array_contains(gone, CAST(i AS BIGINT))), '\\n') END"
    )
    return texts.join(gone, id_col, "left").select(id_col, kept.alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed_lines"))
