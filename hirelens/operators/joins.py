"""Joins of the reports: one-to-one, composite, best title match, similar postings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import as_column, title_tokens
from ..session import written

SPREAD_LANES = 1000
LANE_ROWS = 10_000
SALARY_COLUMNS = ("salary_min", "salary_max", "salary_currency", "salary_snippet")


def one_to_one_left(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that fails when either side repeats a key. An empty left side keeps the schema.

    The rows of a key are counted where the join brings them together, so building the query runs no job and each side is
    read once. A null key is a key as well for the check.
    """
    def once(side: DataFrame, name: str) -> DataFrame:
        rows = F.count(F.lit(1)).over(Window.partitionBy(key))
        failed = F.raise_error(F.concat(F.lit(f"{key} repeats on the {name} side: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
        return side.withColumn("_rows", rows).withColumn("_rows", F.when(F.col("_rows") > 1, failed.cast("bigint")).otherwise(F.col("_rows")))

    # Both counts are part of a filter that always holds, so that neither is pruned away.
    held = once(left, "left").join(once(right, "right").withColumnRenamed("_rows", "_others"), key, "left")
    return held.filter("_rows = 1 AND coalesce(_others, 1) = 1").drop("_rows", "_others")


def suffixed_left_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], suffixes: tuple[str, str]
) -> DataFrame:
    """Left join on several keys; columns that both sides have get their side's suffix."""
    shared = (set(left.columns) & set(right.columns)) - set(keys)

    def renamed(side: DataFrame, suffix: str) -> DataFrame:
        return side.withColumnsRenamed({name: name + suffix for name in shared})

    return renamed(left, suffixes[0]).join(renamed(right, suffixes[1]), list(keys), "left")


def best_title_match(titles: DataFrame, title: str, entries: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """For each distinct lower-cased title the best entry: (title_key, entry_ordinal, score) and the `carried` columns of the entry.

    Score is the number of shared tokens, plus one when either title holds the other; a match has a shared token and a score of
    two. Ties go to the lowest ordinal. Both sides are reduced to distinct titles first. Two routes find all pairs of that score:

    * Two shared tokens. With tokens ordered by how many titles have them, rarest first, such pairs share one that is not the last
      of either title. So the last, most frequent token is never joined, and one that every title has costs nothing.
    * One title inside the other. The inner one is looked up by the rarest of its three-letter pieces among the pieces of the others.

    Tokens and pieces that stay frequent are dealt into lanes of `LANE_ROWS` rows, one task each at most; the other side's
    rows are repeated for each lane.
    """
    wanted = titles.select(F.lower(title).alias("key")).filter("key IS NOT NULL").distinct().withColumn("tokens", title_tokens("key"))
    offered = entries.groupBy(F.lower("title_text").alias("key")).agg(F.min_by(F.struct("ordinal", *carried), "ordinal").alias("entry"))
    offered = offered.withColumn("tokens", title_tokens("key"))
    # Both are read several times below, and what they are made of may be costly.
    wanted = written(wanted.filter(F.size("tokens") > 0).select("key", F.struct("tokens").alias("row")), "titles")
    offered = written(offered.filter(F.size("tokens") > 0).select("key", F.struct("tokens", "entry").alias("row")), "entries")

    places = F.sequence(F.lit(1), F.length("key") - 2)
    pieces = F.array_distinct(F.transform(places, lambda at: F.substr("key", at, F.lit(3))))
    by_token, by_piece = _ranked(wanted, offered, F.col("row.tokens")), _ranked(wanted, offered, pieces)
    rare = [_items(side, F.size("ranked") - 1) for side in by_token]
    every = [_items(side, F.size("ranked")) for side in by_piece]
    rarest = [_items(side, F.lit(1)) for side in by_piece]
    inside, outside = F.contains("title_key", "entry_key"), F.contains("entry_key", "title_key")
    pairs = (
        _lane_join(rare[0], rare[1])
        .unionByName(_lane_join(every[0], rarest[1]).filter(inside))
        .unionByName(_lane_join(rarest[0], every[1]).filter(outside))
    )
    overlap = F.size(F.array_intersect("title.tokens", "entry.tokens"))
    scored = pairs.select("title_key", F.col("entry.entry").alias("entry"), overlap.alias("overlap"), (inside | outside).cast("int").alias("holds"))
    # The best entry of a title leaves a task once; a pair found on several routes changes nothing.
    best = scored.filter("overlap > 0 AND overlap + holds >= 2").groupBy("title_key").agg(
        F.max(F.struct((F.col("overlap") + F.col("holds")).alias("score"), (-F.col("entry.ordinal")).alias("rank"), "entry")).alias("best")
    )
    return best.select("title_key", F.col("best.entry.ordinal").alias("entry_ordinal"), F.col("best.score").alias("score"), *(F.col(f"best.entry.{name}") for name in carried))


def _ranked(left: DataFrame, right: DataFrame, items: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides (key, row) with `ranked`: the items of a key as (n, item), those with the fewest keys on both sides first."""
    exploded = [side.select("key", "row", F.explode(items).alias("item")) for side in (left, right)]
    counts = exploded[0].select("item").unionByName(exploded[1].select("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    left, right = (
        side.join(counts, "item").groupBy("key").agg(F.any_value("row").alias("row"), F.array_sort(F.collect_list(F.struct("n", "item"))).alias("ranked"))
        for side in exploded
    )
    return left, right


def _items(side: DataFrame, first: Column) -> DataFrame:
    """(key, row, n, item) of the first ranked items."""
    return side.select("key", "row", F.inline(F.slice("ranked", F.lit(1), F.greatest(first, F.lit(0)))))


def _lane_join(titles: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs of rows (key, row, n, item) with the same item; an item of n rows has a lane for every LANE_ROWS of them."""
    lanes = F.floor(F.col("n") / LANE_ROWS).cast("int")
    dealt = titles.select(F.col("key").alias("title_key"), F.col("row").alias("title"), "item", F.pmod(F.hash("key"), lanes + 1).alias("lane"))
    repeated = entries.select(F.col("key").alias("entry_key"), F.col("row").alias("entry"), "item", F.explode(F.sequence(F.lit(0), lanes)).alias("lane"))
    return dealt.join(repeated, ["item", "lane"]).drop("item", "lane")


def salary_with_fallback(
    postings: DataFrame, title: str, entries: DataFrame, fallback_tag: str,
    post_suffix: str = "_post", titles: DataFrame | None = None,
) -> DataFrame:
    """The posting's own salary, else that of the best matching entry, else nulls.

    All fields come from the same side. `titles` is a table with the same titles that is cheaper
    to scan than `postings`, whose texts need not be read again to match titles. Entries are read once: their salaries
    travel with the match.
    """
    matches = best_title_match(postings if titles is None else titles, title, entries, SALARY_COLUMNS)
    found = matches.select("title_key", *(F.col(name).alias(f"_entry_{name}") for name in SALARY_COLUMNS))
    own = F.col("salary_min" + post_suffix).isNotNull()
    # A posting with pay of its own, or without a title, looks nothing up: it gets a lane that no entry has, so
    # that such rows, the most of all, are spread over tasks instead of meeting in one.
    hashed = [name for name, kind in postings.dtypes if "map<" not in kind and "variant" not in kind]
    looks_up = ~own & F.lower(title).isNotNull()
    keyed = postings.withColumns({
        "_title_key": F.when(looks_up, F.lower(title)).otherwise(""),
        "_lane": F.when(looks_up, F.lit(0).cast("bigint")).otherwise(1 + F.pmod(F.xxhash64(*hashed), F.lit(SPREAD_LANES))),
    })
    found = found.withColumn("_entry_lane", F.lit(0).cast("bigint"))
    joined = keyed.join(found, (F.col("_title_key") == found["title_key"]) & (F.col("_lane") == F.col("_entry_lane")), "left")
    chosen = {
        name: F.when(own, F.col(name + post_suffix)).otherwise(F.col(f"_entry_{name}"))
        for name in SALARY_COLUMNS
    }
    source = F.when(own, "job_post").when(F.col("title_key").isNotNull(), fallback_tag)
    extra = [f"_entry_{name}" for name in SALARY_COLUMNS] + ["_title_key", "title_key", "_lane", "_entry_lane"]
    return joined.withColumns({**chosen, "salary_source": source}).drop(*extra)


def similar_postings(
    postings: DataFrame, key: str, category: str, ordinal: str, limit: int = 3
) -> DataFrame:
    """For every posting the first `limit` others of its category: (key, rank, similar key).

    Only the first `limit` + 1 of a category can ever be shown, so those travel to the postings,
    and nothing is paired within a category.
    """
    place = Window.partitionBy(category).orderBy(ordinal)
    # The rank filter is applied before the shuffle too, so a hot category sends few rows.
    leaders = (
        postings.select(category, ordinal, key)
        .withColumn("_place", F.row_number().over(place))
        .filter(F.col("_place") <= limit + 1)
        .groupBy(category)
        .agg(F.array_sort(F.collect_list(F.struct("_place", key))).alias("_leaders"))
    )
    paired = postings.select(key, category).join(leaders, category)
    others = F.slice(F.filter("_leaders", lambda item: item[key] != F.col(key)), 1, limit)
    return paired.select(key, F.posexplode(others).alias("position", "item")).select(
        key, (F.col("position") + 1).alias("similar_rank"), F.col(f"item.{key}").alias(f"similar_{key}")
    )


def with_company(postings: DataFrame, companies: DataFrame, key: str) -> DataFrame:
    """Company columns where the company is known; postings never disappear."""
    return postings.join(companies, key, "left")


def with_any_of(postings: DataFrame, bridge: DataFrame, key: str, wanted: Column) -> DataFrame:
    """Postings that have a bridge row satisfying a predicate (a facet)."""
    return postings.join(bridge.filter(wanted).select(key).distinct(), key, "left_semi")


def mapped_values(table: DataFrame, column: str, mapping: DataFrame, into: str) -> DataFrame:
    """Canonical values from a (original, canonical) table, original kept; lookup ignores case.

    Originals that differ in case or outer blanks only are one key: the smallest canonical value serves all.
    """
    pairs = mapping.groupBy(F.lower(F.trim("original")).alias("_from")).agg(F.min("canonical").alias("_to"))
    joined = table.withColumn("_key", F.lower(F.trim(as_column(column)))).join(pairs, F.col("_key") == F.col("_from"), "left")
    return joined.withColumn(into, F.coalesce("_to", F.col(column))).drop("_key", "_from", "_to")
