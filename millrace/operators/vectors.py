"""Similar vectors: a query set met with all rows, block by block, as matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries that one block holds.
BLOCK = 1_000


def matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of vectors of one length; null vectors and vectors of no length give zeros."""
    rows = column.to_pylist()
    width = max((len(r) for r in rows if r is not None), default=0)
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        if r is not None and len(r) == width:
            out[k] = r
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms > 0, norms, 1.0)


def similar(rows: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """(query_id, id, similarity) of the rows (id, vector) whose cosine with a query reaches ``least``; a row does not meet itself.

    The queries are packed into blocks of BLOCK vectors; the rows' partitions are met with one
    block after the other, so no task holds more than a block and an Arrow batch.
    """
    numbered = queries.where("id IS NOT NULL AND vector IS NOT NULL").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-queries.count() // BLOCK)))))
    blocks = numbered.groupBy("block").agg(F.collect_list(F.struct("id", "vector")).alias("queries"))
    out = None
    for block in blocks.toLocalIterator():  # one block at a time reaches the driver
        ids = np.array([r.id for r in block.queries], np.int64)
        vectors = matrix(pa.array([r.vector for r in block.queries]))

        def meet(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, vectors: np.ndarray = vectors) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = matrix(batch.column(1))
                here = np.array(batch.column(0).to_pylist(), np.int64)
                near = own @ vectors.T if own.shape[1] == vectors.shape[1] else np.zeros((len(here), len(ids)))
                row, asked = np.nonzero(near >= least)
                keep = here[row] != ids[asked]
                row, asked = row[keep], asked[keep]
                yield pa.RecordBatch.from_arrays([pa.array(ids[asked]), pa.array(here[row]), pa.array(near[row, asked])], ["query_id", "id", "similarity"])

        part = rows.where("id IS NOT NULL AND vector IS NOT NULL").select("id", "vector").mapInArrow(meet, "query_id bigint, id bigint, similarity double")
        out = part if out is None else out.unionByName(part)
    return rows.sparkSession.createDataFrame([], "query_id bigint, id bigint, similarity double") if out is None else out
