"""Exact top-k by inner product over a bit-sliced index of quantised vectors.

Index. A shard of at most `shard_rows` vectors keeps, for every attribute and bit, a bitmap of the rows that have the bit in their
value above the shard's least one. Attributes that need more than `slice_bits` bits lose the lowest ones in the bitmaps,
not in the values, which lie beside them. Shards are cut from the partitions of one even repartition; the index is a
table with a row for each shard.

Search. A query's weights are added up by bitmap arithmetic: a bit j of a weight sends the attribute's bitmap b to place j + b
(the inverted one for a negative weight), and carry-save adders turn three bitmaps of one place into a sum there and a carry at the
next until one bitmap is left in each place. These are the slices of all rows' scores. The k-th best value is found from the
most significant slice downward, by counting bits. What the lost low bits could add widens it to a bar; rows at
the bar or above are boundary rows, and their scores are computed exactly from the values.

Scale. Every row meets every query, so the work is rows times queries, but little of it moves: an index task reads its shards
once for each block of `query_rows` queries, whose vectors are the only thing sent to all tasks (bounded by the block), and
gives k rows a query. Each block's rows are written before the next block starts.

Defined cases: vectors that are null, of another length than most, or hold a null or non-finite component are neither queries
nor candidates, nor are those with a component so large that an inner product of two could leave the range of a long;
zero vectors take part; repeated vectors are candidates each; rows with the query's own vec_id are no candidates; of several query
rows with one id the smallest vector is asked; ties go to the smaller vec_id; with fewer candidates than k, all are given;
rows without vec_id can't be named and are left out; empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .work import query, shared_folder, table, written

FOUND = "query_id long, vec_id long, score long"
SHARD = "n int, shift int, ids binary, values binary, least binary, slices binary"


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, quants) of rows that may take part, whatever their length; a null component fails the test."""
    given = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    sound = given.where((F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    quants = F.transform("vector", lambda x: F.floor(x * scale))
    limit = F.floor(F.sqrt(F.lit(float(1 << 62)) / F.size("quants")))
    return sound.select("vec_id", quants.alias("quants")).where(F.forall("quants", lambda x: x.between(-limit, limit)))


def added(places: list[list[np.ndarray]]) -> list[np.ndarray]:
    """One bitmap a place for the sum of bitmaps (stacked in rows) that stand at each place, least significant first."""
    out, at = [], 0
    while at < len(places):
        rows = places[at][0] if len(places[at]) == 1 else np.concatenate(places[at]) if places[at] else None
        if at + 1 == len(places) and rows is not None and len(rows) > 1:
            places.append([])
        while rows is not None and len(rows) > 1:
            third = len(rows) // 3
            if third:
                a, b, c = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third]
                both = a ^ b
                carry = (a & b) | (both & c)
                rows = np.concatenate([both ^ c, rows[3 * third :]])
            else:
                carry = rows[:1] & rows[1:]
                rows = rows[:1] ^ rows[1:]
            places[at + 1].append(carry)
        out.append(rows[0] if rows is not None else None)
        at += 1
    width = next((len(s) for s in out if s is not None), 0)
    return [np.zeros(width, np.uint64) if s is None else s for s in out]


def kth_value(slices: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """The k-th greatest value among the rows of a bitmap; 0 if there are fewer."""
    value, above, level = 0, 0, rows
    for place in reversed(range(len(slices))):
        ones = level & slices[place]
        n = int(np.bitwise_count(ones).sum())
        if above + n >= k:
            value |= 1 << place
            level = ones
        else:
            above += n
            level = level & ~slices[place]
    return value


def at_least(slices: list[np.ndarray], rows: np.ndarray, bar: int) -> np.ndarray:
    """The rows of a bitmap whose value is at least `bar`."""
    if bar <= 0:
        return rows
    if bar >> len(slices):
        return np.zeros_like(rows)
    greater, equal = np.zeros_like(rows), rows
    for place in reversed(range(len(slices))):
        if bar >> place & 1:
            equal = equal & slices[place]
        else:
            greater |= equal & slices[place]
            equal = equal & ~slices[place]
    return greater | equal


class Shard:
    """Bit slices and values of some vectors."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, least: np.ndarray, slices: np.ndarray, shift: int):
        """slices: attributes by bits by words."""
        self.ids, self.values, self.least, self.shift = ids, values, least, shift
        self.bits = slices.shape[1]
        self.signed = np.concatenate([slices, ~slices])
        self.rows = np.zeros(slices.shape[2] * 64, np.uint8)
        self.rows[: len(ids)] = 1
        self.rows = np.packbits(self.rows, bitorder="little").view(np.uint64)
        self.by_id = np.argsort(ids, kind="stable")
        self.sorted_ids = ids[self.by_id]

    @classmethod
    def built(cls, ids: np.ndarray, values: np.ndarray, slice_bits: int) -> Shard:
        least = values.min(0)
        above = values - least
        need = int(above.max()).bit_length()
        shift = max(0, need - slice_bits)
        above >>= shift
        words = -(-len(ids) // 64)
        slices = np.zeros((values.shape[1], max(1, need - shift), words), np.uint64)
        for bit in range(slices.shape[1]):
            flags = np.zeros((values.shape[1], words * 64), np.uint8)
            flags[:, : len(ids)] = ((above >> bit) & 1).T
            slices[:, bit] = np.packbits(flags, 1, bitorder="little").view(np.uint64)
        return cls(ids, values, least, slices, shift)

    def packed(self) -> tuple:
        return (len(self.ids), self.shift, self.ids.tobytes(), self.values.tobytes(), self.least.tobytes(), self.signed[: len(self.least)].tobytes())

    @classmethod
    def unpacked(cls, n: int, shift: int, ids: bytes, values: bytes, least: bytes, slices: bytes) -> Shard:
        low = np.frombuffer(least, np.int64)
        words = np.frombuffer(slices, np.uint64)
        return cls(np.frombuffer(ids, np.int64), np.frombuffer(values, np.int64).reshape(n, -1), low, words.reshape(len(low), -1, -(-n // 64)), shift)

    def scores(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices of every row's sum of |weight| x sliced value, inverted where the weight is negative."""
        size = np.abs(weights)
        top = int(size.max()).bit_length()
        places: list[list[np.ndarray]] = [[] for _ in range(max(1, top + self.bits - 1))]
        side = np.where(weights < 0, len(weights), 0) + np.arange(len(weights))
        for j in range(top):
            taken = self.signed[side[(size >> j) & 1 == 1]]
            if len(taken):
                for bit in range(self.bits):
                    places[j + bit].append(taken[:, bit])
        return added(places)

    def best(self, weights: np.ndarray, own: int, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of all rows that can be among the k best; `floor`: a score that k rows are known to reach."""
        rows = self.rows
        first, last = np.searchsorted(self.sorted_ids, [own, own + 1])
        if last > first:
            gone = np.zeros(len(rows) * 64, np.uint8)
            gone[self.by_id[first:last]] = 1
            rows = rows & ~np.packbits(gone, bitorder="little").view(np.uint64)
        if weights.any():
            slices, size = self.scores(weights), np.abs(weights)
            unit = 1 << self.shift
            lost, gained = int(size.sum()) * (unit - 1), int(size[weights > 0].sum()) * (unit - 1)
            bar = kth_value(slices, rows, k) - lost // unit
            if floor is not None:
                # A row's score is at most base + unit x value + gained.
                base = int(weights @ self.least) - unit * int(size[weights < 0].sum()) * ((1 << self.bits) - 1)
                bar = max(bar, -(-(floor - base - gained) // unit))
            rows = at_least(slices, rows, bar)
        chosen = np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little"))
        return self.ids[chosen], self.values[chosen] @ weights


def index(data: DataFrame, slice_bits: int, shard_rows: int) -> DataFrame:
    """Shards of (vec_id, quants), all of one length."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def made() -> pa.RecordBatch:
            ids, values = (np.concatenate(part) for part in zip(*held))
            row = Shard.built(ids, values, slice_bits).packed()
            return pa.RecordBatch.from_arrays(
                [pa.array([x], k) for x, k in zip(row, [pa.int32()] * 2 + [pa.binary()] * 4)], [f.split()[0] for f in SHARD.split(", ")]
            )

        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            if not len(ids):
                continue
            values = batch.column("quants").flatten().to_numpy().reshape(len(ids), -1)
            while len(ids):
                room = shard_rows - sum(len(part) for part, _ in held)
                held.append((ids[:room], values[:room]))
                ids, values = ids[room:], values[room:]
                if sum(len(part) for part, _ in held) == shard_rows:
                    yield made()
                    held.clear()
        if held:
            yield made()

    return data.mapInArrow(shards, SHARD)


def top(
    vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, slice_bits: int = 8, shard_rows: int = 16_384,
    task_rows: int = 1 << 18, query_rows: int = 8_192,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products of floor(scale x component), for each query."""
    spark = vectors.sparkSession
    data = written(quantised(vectors, scale), "quants")  # read again by the count and by the index
    sizes = data.groupBy(F.size("quants").alias("size")).count()
    most = sizes.orderBy(F.desc("count"), "size").first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = most["size"]
    asked = quantised(queries, scale).where(F.size("quants") == width).groupBy("vec_id").agg(F.min("quants").alias("quants"))
    asked = written(asked, "queries")
    n_blocks = max(1, -(-asked.count() // query_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)))
    parts = max(spark.sparkContext.defaultParallelism, -(-most["count"] // task_rows))
    shards = written(index(data.where(F.size("quants") == width).repartition(parts), slice_bits, shard_rows), "shards")
    path = f"{shared_folder(spark)}/llm/top-{uuid.uuid4().hex}"
    for block in range(n_blocks):
        rows = asked.where(F.col("block") == block).orderBy("vec_id").toArrow().combine_chunks()
        names = rows.column("vec_id").to_numpy()
        weights = rows.column("quants").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(names), width)
        sent = spark.sparkContext.broadcast((names, weights))
        _searched(shards, sent, k).write.parquet(f"{path}/block={block}")
        sent.destroy()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = spark.read.schema(FOUND).parquet(*(f"{path}/block={block}" for block in range(n_blocks)))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(shards: DataFrame, sent, k: int) -> DataFrame:
    """The k best of each index task for every query of a block."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = sent.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(names)
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard.unpacked(*(batch.column(c)[row].as_py() for c in range(batch.num_columns)))
                for q, name in enumerate(names.tolist()):
                    ids, scores = best[q]
                    floor = int(scores[-1]) if len(scores) == k else None
                    more, their = shard.best(weights[q], name, k, floor)
                    ids, scores = np.concatenate([ids, more]), np.concatenate([scores, their])
                    order = np.lexsort((ids, -scores))[:k]
                    best[q] = ids[order], scores[order]
        if len(names):
            lengths = [len(ids) for ids, _ in best]
            columns = [np.repeat(names, lengths), np.concatenate([b[0] for b in best]), np.concatenate([b[1] for b in best])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return shards.mapInArrow(search, FOUND)


SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as quants from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select a.vec_id as query_id, b.vec_id, list_inner_product(a.quants, b.quants)::bigint as score
    from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
)
select query_id, rank, vec_id, score from (
    select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored
) where rank <= 5
"""


@query(SQL)
def op11_exact_top(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return top(vectors, vectors.where(F.col("vec_id") % 50 == 0))
