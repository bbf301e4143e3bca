"""Approximate nearest neighbours by collision-counting hashing with query-centred windows.

Index. Vectors are lengthened by one coordinate that gives all the largest norm, which turns the largest inner
product into the smallest distance. Rows are dealt into shards of about `shard_rows`. A shard projects its
vectors on `projections` random lines and keeps one sorted array for each: that is the whole index.

Search. A query lies at the centre of a window on every line. The windows grow by the factor `growth` (virtual
rehashing: no array is built again, the next widths read further along the same ones) until enough vectors,
k and a share `verify` of the shard, have fallen into at least `threshold` of the windows. Those vectors
are verified by exact inner products in double precision. A shard's k best are merged over shards by query.

Queries are a stated set. Query blocks of `query_rows` meet every shard, as one task each; shards and blocks
have bounded sizes, so a task's memory does not depend on the table, and no side is broadcast.

Defined cases: vectors that are null, empty, zero, of another length than most, or holding a null or
non-finite component are neither queries nor candidates; repeated vectors are candidates each, ties in score go to the
smaller vec_id; rows with the query's own vec_id are no candidates; of several
query rows with one id the smallest vector is asked; with fewer candidates than k, all
are given; empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .work import query, table, written


def sound_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector of doubles) of the vectors that take part."""
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    given = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), doubles.alias("vector"))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return given.where(whole & F.exists("vector", lambda x: x != 0))


class Shard:
    """Sorted projections of some vectors, and each vector's place in every sorted array."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lines: np.ndarray, radius: float):
        self.ids, self.vectors = ids, vectors
        lift = np.sqrt(np.maximum(radius**2 - (vectors**2).sum(1), 0.0))
        places = (np.column_stack([vectors, lift]) @ lines).T
        order = np.argsort(places, 1, kind="stable")
        self.sorted = np.take_along_axis(places, order, 1)
        self.rank = np.empty(places.shape, np.uint16 if len(ids) < 1 << 16 else np.uint32)
        np.put_along_axis(self.rank, order, np.arange(len(ids), dtype=self.rank.dtype)[None, :], 1)

    def windows(self, centres: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """First place and length of every line's window around each centre (lines by queries)."""
        begin = np.stack([np.searchsorted(s, c - width, "left") for s, c in zip(self.sorted, centres)])
        end = np.stack([np.searchsorted(s, c + width, "right") for s, c in zip(self.sorted, centres)])
        return begin.astype(self.rank.dtype), (end - begin).astype(self.rank.dtype)

    def search(self, vectors: np.ndarray, own: np.ndarray, lines: np.ndarray, k: int, verify: float, threshold: float, width: float, growth: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of the k best verified vectors of every query, in the order of the queries."""
        n, m = len(self.ids), len(self.sorted)
        centres = (vectors @ lines[:-1]).T
        enough, need = min(n, k + 1 + int(np.ceil(verify * n))), int(np.ceil(threshold * m))
        counts = np.zeros((len(vectors), n), np.uint16)
        # A few queries find the width from the start; the others start one step below what these needed.
        few = min(8, len(vectors))
        open_, later = np.arange(few), np.arange(few, len(vectors))
        offset, inside = np.empty_like(self.rank), np.empty(self.rank.shape, bool)
        while len(open_):
            begin, length = self.windows(centres[:, open_], width)
            done = np.zeros(len(open_), bool)
            for j, q in enumerate(open_.tolist()):
                # A place below the window wraps round to a large number.
                np.less(np.subtract(self.rank, begin[:, j, None], out=offset), length[:, j, None], out=inside)
                counts[q] = np.add.reduce(inside.view(np.uint8), 0, dtype=np.uint8 if m < 256 else np.uint16)
                done[j] = np.count_nonzero(counts[q] >= need) >= enough or int(length[:, j].min()) == n
            open_ = open_[~done]
            if 2 * len(open_) <= few and len(later):
                open_, later = np.concatenate([open_, later]), later[:0]
            else:
                width *= growth
        for q, vector in enumerate(vectors):
            chosen = np.flatnonzero((counts[q] >= need) & (self.ids != own[q]))
            scores = self.vectors[chosen] @ vector
            if len(chosen) > k:
                bar = np.partition(scores, len(scores) - k)[len(scores) - k]
                chosen = chosen[scores >= bar - 1e-9 * abs(bar)]
            scores = (self.vectors[chosen] * vector).sum(1)  # equal vectors get equal sums
            best = np.lexsort((self.ids[chosen], -scores))[:k]
            yield self.ids[chosen[best]], scores[best]


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, projections: int = 128, verify: float = 0.04, threshold: float = 0.6,
    first: float = 0.75, growth: float = 1.15, shard_rows: int = 4_096, query_rows: int = 512, seed: int = 7,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest among `vectors` (both: vec_id, embedding)."""
    spark = vectors.sparkSession
    data = sound_vectors(vectors).withColumn("size", F.size("vector"))
    sizes = data.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda t, x: t + x * x)).alias("square"))
    most = sizes.orderBy(F.desc("n"), "size").first()
    schema = "query_id long, vec_id long, score double"
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, n_rows, radius = most["size"], most["n"], float(np.sqrt(most["square"]))
    n_shards = max(1, -(-n_rows // shard_rows))
    data = data.where(F.col("size") == width).select("vec_id", "vector")
    asked = sound_vectors(queries).where(F.size("vector") == width).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    n_blocks = max(1, -(-asked.count() // query_rows))

    lines = np.random.default_rng(seed).standard_normal((width + 1, projections))
    # Each shard meets every query block: a shard's copies and a block's copies are spread over the pairs.
    shards = data.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_shards))).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))
    )
    blocks = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(n_blocks))).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long")))
    )

    def matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(rows.column("vec_id").to_numpy(), kind="stable")
        flat = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return rows.column("vec_id").to_numpy()[order], flat.reshape(-1, width)[order]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            shard, (own, asked_) = Shard(*matrix(left), lines, radius), matrix(right)
            for name, (ids, scores) in zip(own, shard.search(asked_, own, lines, k, verify, threshold, first * radius, growth)):
                found.append((np.full(len(ids), name), ids, scores))
        parts = [np.concatenate(p) for p in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(parts[0], pa.int64()), "vec_id": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], pa.float64())})

    pairs = shards.groupBy("shard", "block").cogroup(blocks.groupBy("shard", "block")).applyInArrow(meet, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


@query()
def op2_nearest_neighbours(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
