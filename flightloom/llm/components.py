"""Connected components of an edge table: edges are merged within each partition, then by large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightloom.llm._io import discard, written
from flightloom.llm._text import tidy

#: Edges that are merged within a task before the steps begin.
MERGED = 200_000


def _merged(edges: DataFrame, parts: int) -> DataFrame:
    """Each partition's edges as stars: every node of the partition with the least node it reaches there."""

    def run(batches):
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        names, at = np.unique(np.concatenate([table.column(i).to_numpy() for i in (0, 1)]), return_inverse=True)
        i, j = np.split(at, 2)
        root = np.arange(len(names))
        while (root[i] != root[j]).any():
            least = np.minimum(root[i], root[j])
            for end in (i, j):
                np.minimum.at(root, root[end], least)
            while (root[root] != root).any():
                root = root[root]
        inner = np.flatnonzero(root != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[inner]), pa.array(names[root[inner]])], ["a", "b"])

    return edges.repartition(parts, "a").mapInArrow(tidy(run), edges.schema)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node points its larger (large) or smaller-or-equal (small) neighbours to the least of them; edges: a written table, deleted.

    The least neighbour comes from an aggregate, so a node with many neighbours is summed before the
    shuffle. It is written before the join back: Spark splits a hot node's rows only where both sides of a join are
    dealt out for the join itself, and broadcasts a table that it knows to be short.
    """
    if large:
        links = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        kept = links.where(F.col("b") > F.col("a"))
    else:
        links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        kept = links.unionByName(edges.select(F.greatest("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    least = written(least, "least")
    pairs = kept.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    made = written(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    discard(edges, least)
    return made


def _stars(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(edges: DataFrame):
    """Number and sum of hashes of the edges, by which a step that changes nothing is known."""
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (least node of its component) for every node of edges (a, b); a and b of one type.

    Null ends are dropped, loops and repeated edges don't matter, no edges give no rows. Each step is
    written to the shared folder. It ends when a step changes nothing.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    parts = max(1, -(-edges.count() // MERGED))
    given, edges = edges, written(_merged(edges, parts), "merged")
    discard(given)
    state = _state(edges)
    for _ in range(rounds):
        edges = _star(_star(edges, True), False)
        now = _state(edges)
        if now == state:
            return _stars(edges)
        state = now
    raise RuntimeError("components did not settle")
