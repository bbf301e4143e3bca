"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Every step is a DataFrame expression. Texts are read once, for their word counts; what is shuffled
afterwards is one short row per document.

1. Targets: sources share `share` times all words by weight; a target stops at `most` times its
   source's words and the excess is shared again by weight (`source_targets`).
2. Seats: the targets' words, in blocks of `block_words`, go to sources by the highest quotients
   target / (2k + 1), ties to the earlier source (`sainte_lague`).
3. The seats of a source go to its shards in the same way, by the shards' words.
4. In a shard, documents lie in seeded order and are cut into blocks. Every block is taken
   floor(quota / blocks) times; evenly spread ones from a seeded start are taken once more.

Defined cases: a null text has size 0; null is a source of its own, after all others; a document
without words is taken 0 times; repeated rows are documents of their own; an empty table gives no
rows. Extra columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .work import query, table, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARD_WORDS = 1 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, share: float, most: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, words) to (source, words, place, target): shares by weight, capped, the excess reshared.

    Resharing until none is above its cap ends at one level t with target = min(most * words, t * weight).
    Sources reach their caps in the order of cap / weight, so running sums find the level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    placed = sources.withColumn("place", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    capped = placed.withColumn("weight", weight).withColumn("cap", F.col("words") * F.lit(float(most)))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everywhere = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = F.sum("words").over(everywhere) * F.lit(float(share))
    level = (wanted - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    levels = capped.withColumn("level", level).withColumn("holds", F.col("level") * F.col("weight") <= F.col("cap"))
    first = F.min(F.when(F.col("holds"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(everywhere)
    target = F.coalesce(F.least("cap", first["level"] * F.col("weight")), F.col("cap"))
    return levels.select("source", "words", "place", target.alias("target"))


def sainte_lague(parties: DataFrame, groups: list[str], votes: str, order: str, seats: Column) -> DataFrame:
    """Give each group's `seats` to its parties by the highest quotients votes / (2k + 1); adds `quota`.

    Group and order columns are never null. With m parties, the last seat's quotient lies where all parties' rounded shares sum to between
    seats - m/2 and seats + m/2. Seats above that band are certain, and only those inside it, about
    2m a group, are laid out as rows and ranked.
    """
    whole = Window.partitionBy(*groups)
    sized = parties.withColumn("_v", F.col(votes).cast("double")).withColumns({
        "_seats": seats, "_all": F.sum("_v").over(whole), "_m": F.count(F.lit(1)).over(whole),
    })
    rounded = lambda total: F.floor(F.col("_v") * total / F.col("_all") + 0.5).cast("long")
    low = F.when((F.col("_all") > 0) & (F.col("_seats") > F.col("_m")), F.greatest(rounded(F.col("_seats") - F.col("_m") / 2) - 1, F.lit(0))).otherwise(0)
    high = F.when(F.col("_all") > 0, rounded(F.col("_seats") + F.col("_m") / 2) + 1).otherwise(0)
    banded = sized.withColumns({"_low": low.cast("long"), "_high": high})
    banded = banded.withColumn("_open", F.col("_seats") - F.sum("_low").over(whole))
    ks = F.when((F.col("_high") > F.col("_low")) & (F.col("_v") > 0), F.sequence(F.col("_low"), F.col("_high") - 1))
    quotients = banded.select(*groups, order, "_open", F.explode(ks).alias("_k"), "_v")
    ranked = Window.partitionBy(*groups).orderBy(F.desc(F.col("_v") / (2 * F.col("_k") + 1)), order, "_k")
    won = quotients.withColumn("_rank", F.row_number().over(ranked)).where("_rank <= _open").groupBy(*groups, order).agg(F.count(F.lit(1)).alias("_won"))
    won = won.select(*(F.col(name).alias(f"_won_{name}") for name in [*groups, order]), "_won")
    on = [F.col(name) == F.col(f"_won_{name}") for name in [*groups, order]]
    quota = F.col("_low") + F.coalesce("_won", F.lit(0))
    return banded.join(won, on, "left").select(*parties.columns, quota.alias("quota"))


def mix(
    documents: DataFrame, share: float = 1.5, most: float = 2.0, block_words: int = 32, seed: str = "mix",
    weights: tuple[int, ...] = WEIGHTS, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and `spans`, the word ranges taken with their counts."""
    named = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sizes = written(named, "sizes")
    sources = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("words")), share, most, weights)
    all_seats = F.round(F.sum("target").over(Window.partitionBy("_all_sources")) / block_words).cast("long")
    seated = sainte_lague(
        sources.withColumn("_all_sources", F.lit(0)).withColumn("all_seats", all_seats), ["_all_sources"], "target", "place", F.col("all_seats")
    ).select("source", "place", "target", F.col("words").alias("source_size"), F.col("quota").alias("source_quota"))
    seated = written(seated, "source_quotas")

    order = F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string")), 256)
    dealt = sizes.join(seated, sizes["source"].eqNullSafe(seated["source"]), "left").select(
        "doc_id", "size", "place", "target", "source_size", "source_quota", order.alias("_order"),
        F.pmod(F.conv(F.substring(order, 1, 12), 16, 10).cast("long"), F.ceil((F.col("source_size") + 1) / shard_words)).alias("shard"),
    )
    by_shard = dealt.groupBy("place", "shard", "source_quota").agg(F.sum("size").alias("shard_size"))
    shards = sainte_lague(by_shard, ["place"], "shard_size", "shard", F.col("source_quota")).select(
        "place", "shard", "shard_size", "quota"
    )
    shards = written(shards, "shard_quotas")
    lined = Window.partitionBy("place", "shard").orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("_end", F.sum("size").over(lined)).withColumn("_begin", F.col("_end") - F.col("size"))
    found = placed.join(shards, ["place", "shard"], "left")
    blocks = F.ceil(F.col("shard_size") / block_words)
    times = F.floor(F.col("quota") / F.greatest(blocks, F.lit(1)))
    extra = F.col("quota") - times * blocks
    found = found.withColumns({"_blocks": blocks, "_times": times, "_extra": extra})
    # Which blocks are taken once more: evenly spread ones, from a seeded start, so that no ranking is needed.
    start = F.pmod(F.xxhash64(F.lit(seed), "place", "shard"), F.greatest(F.col("_blocks"), F.lit(1)))
    chosen = lambda b: (  # noqa: E731  whether the evenly spread extra blocks, turned by the seed, hold block b
        F.floor((F.pmod(b + F.col("_start"), F.col("_blocks")) + 1) * F.col("_extra") / F.col("_blocks"))
        > F.floor(F.pmod(b + F.col("_start"), F.col("_blocks")) * F.col("_extra") / F.col("_blocks"))
    )
    numbers = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("_begin") / block_words), F.floor((F.col("_end") - 1) / block_words)))
    piece = lambda b: F.struct(
        F.greatest(b * block_words - F.col("_begin"), F.lit(0)).alias("begin"),
        F.least((b + 1) * block_words - F.col("_begin"), F.col("size")).alias("end"),
        F.least(F.col("_times") + F.when(chosen(b), 1).otherwise(0), F.lit(int(most))).alias("times"),
    )
    cut = found.withColumn("_start", start).withColumn(
        "spans", F.filter(F.transform(F.coalesce(numbers, F.array().cast("array<bigint>")), piece), lambda s: s["times"] > 0)
    )
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + (s["end"] - s["begin"]) * s["times"])
    return cut.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), taken.alias("taken"), "spans")


@query()
def op1_source_mix(spark, folder):
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")
