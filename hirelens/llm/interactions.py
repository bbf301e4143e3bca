"""Filter interaction audit: what each filter of a chain removes, in every order of the chain, by decision diagrams.

Masks. A document fails a set of filters, written as a mask of bits. Conditions of the text itself are column expressions;
"same text as a smaller id" joins each document with the smallest id of its text, found by a grouped minimum.
Rows of (part, mask) with counts are all that is kept of the documents.

Diagrams. A part's masks make a decision diagram with one level for each filter: the low edge of a node passes the filter, the
high edge fails it, equal subdiagrams are one node, an empty one is node 0, and every node carries the counts of the documents
below it (all, good, toxic). Its all-pass path, low edges from the root, tells the counts after each step of the order of
its levels, and the high edges on the way what each step removes. Orders are visited by swaps of adjacent levels, each of
which rewrites the nodes of two levels in place; no order is counted anew from documents or masks.

Scale. Texts are read once. The smallest id of a text is combined before its shuffle, and documents meet it by text and id, so a
text with a third of all rows gathers nowhere. A part is reduced to at most 2^filters rows before it reaches its task.

Defined cases: a null text is empty; a null part is the empty string; a null id fails no comparison of ids and repeats of one
id with one text do not fail each other; a document without labels, or with null labels, is neither good nor toxic,
and with several label rows it is what any of them says; empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .work import query, table, written

MEASURES = ("n", "good", "toxic")
Counts = tuple[int, ...]


class Diagram:
    """A count-weighted decision diagram over masks; `order` names the filters from the first level to the last."""

    def __init__(self, masks: dict[int, Counts], filters: int):
        self.order = list(range(filters))
        self.low, self.high = [0], [0]
        zero: Counts = (0,) * len(next(iter(masks.values()), MEASURES))
        self.weight: list[Counts] = [zero]
        self.levels: list[dict[tuple[int, int], int]] = [{} for _ in range(filters)]
        # Leaves are nodes below the last level, one for each distinct counts.
        leaves: dict[Counts, int] = {zero: 0}
        below = {}
        for mask, counts in masks.items():
            if counts not in leaves:
                leaves[counts] = self._add(0, 0, counts)
            below[mask] = leaves[counts]
        for level in reversed(range(filters)):
            bit = 1 << level
            above = {mask & ~bit for mask in below}
            below = {mask: self._node(level, below.get(mask, 0), below.get(mask | bit, 0)) for mask in above}
        self.root = below.get(0, 0)

    def _add(self, low: int, high: int, weight: Counts) -> int:
        self.low.append(low)
        self.high.append(high)
        self.weight.append(weight)
        return len(self.low) - 1

    def _node(self, level: int, low: int, high: int) -> int:
        if low == high == 0:
            return 0
        key = (low, high)
        if key not in self.levels[level]:
            weight = tuple(a + b for a, b in zip(self.weight[low], self.weight[high]))
            self.levels[level][key] = self._add(low, high, weight)
        return self.levels[level][key]

    def swap(self, level: int) -> None:
        """Exchange a level with the next. Nodes above see the same nodes as before, with new children."""
        upper, self.levels[level], self.levels[level + 1] = self.levels[level], {}, {}
        low, high = self.low, self.high
        for node in upper.values():
            a, b = low[node], high[node]
            kept = self._node(level + 1, low[a], low[b])
            failed = self._node(level + 1, high[a], high[b])
            low[node], high[node] = kept, failed
            self.levels[level][kept, failed] = node
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def passes(self) -> list[tuple[int, Counts, Counts]]:
        """Filter, counts kept and counts removed of each step along the all-pass path."""
        node, steps = self.root, []
        for name in self.order:
            steps.append((name, self.weight[self.low[node]], self.weight[self.high[node]]))
            node = self.low[node]
        return steps


def adjacent_swaps(n: int) -> list[int]:
    """Levels whose swaps with the next one lead through all orders of n levels, each met once.

    The last item wanders through all places in every order of the others.
    """
    if n < 2:
        return []
    walk = list(range(n - 2, -1, -1))
    out, down = list(walk), False
    for level in adjacent_swaps(n - 1):
        # The wanderer stands at the front after a walk down, and shifts the others by one.
        out.append(level + (0 if down else 1))
        out += walk if down else walk[::-1]
        down = not down
    return out


def audit(masks: dict[int, Counts], names: str) -> list[tuple]:
    """order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for every order and step."""
    diagram = Diagram(masks, len(names))
    fails, alone, shapley = [0] * len(names), [0] * len(names), [0] * len(names)
    runs = []
    for level in [None, *adjacent_swaps(len(names))]:
        if level is not None:
            diagram.swap(level)
        steps = diagram.passes()
        fails[steps[0][0]] = steps[0][2][0]
        alone[steps[-1][0]] = steps[-1][2][0]
        for name, _, removed in steps:
            shapley[name] += removed[0]
        runs.append(steps)
    return [
        ("".join(names[name] for name, _, _ in steps), step, kept[0], removed[0], fails[name] - removed[0], alone[name], removed[1], removed[2], shapley[name])
        for steps in runs
        for step, (name, kept, removed) in enumerate(steps, 1)
    ]


def repeats_of_smaller_id(facts: DataFrame) -> DataFrame:
    """Adds `repeated` to (doc_id, text_key, ...): whether any smaller id has the same text.

    A row is no repeat if it is the first of its text. Text and id together are the join key, so copies of a text do not meet.
    """
    first = facts.where("doc_id is not null").groupBy(F.col("text_key").alias("_key")).agg(F.min("doc_id").alias("_first"))
    joined = facts.join(first, (facts["text_key"] == first["_key"]) & (facts["doc_id"] == first["_first"]), "left")
    return joined.withColumn("repeated", F.col("doc_id").isNotNull() & F.col("_first").isNull()).drop("_key", "_first")


def interactions(facts: DataFrame, failures: list[Column], names: str) -> DataFrame:
    """Every order and step of the filters `names` (one letter each) per part, for rows (part, is_good, is_toxic, ...)."""
    mask = reduce(lambda a, b: a + b, (F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(failures)))
    counts = facts.groupBy("part", mask.alias("mask")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_good").alias("good"), F.count_if("is_toxic").alias("toxic")
    )
    schema = (
        "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
        "good_lost long, toxic_lost long, shapley long"
    )

    def one_part(rows: pa.Table) -> pa.Table:
        masks = {r["mask"]: tuple(r[m] for m in MEASURES) for r in rows.to_pylist()}
        found = audit(masks, names)
        part = rows.column("part")[0].as_py()
        columns = [[part] * len(found), *(list(c) for c in zip(*found))]
        kinds = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7
        fields = [piece.split()[0] for piece in schema.split(",")]
        return pa.table({f: pa.array(c, k) for f, c, k in zip(fields, columns, kinds)})

    return counts.groupBy("part").applyInArrow(one_part, schema)


def text_facts(documents: DataFrame, least_words: int = 200, least_distinct: int = 50, most_capitals: int = 2, marks: str = r"[#$%&*|]") -> DataFrame:
    """doc_id, part, text_key and the failures a to d of the text, for every document."""
    text = F.coalesce("text", F.lit(""))
    named = documents.select(F.col("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    # Blanks at the ends give empty pieces, which are no words.
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = named.select(
        "doc_id", "part", F.md5("text").alias("text_key"), F.length("text").alias("points"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).alias("capitals"), F.col("text").rlike(marks).alias("d"), words.alias("words"),
    )
    counted = cut.select("*", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct"))
    return counted.select(
        "doc_id", "part", "text_key", (F.col("n_words") < least_words).alias("a"),
        (100 * F.col("n_distinct").cast("long") < least_distinct * F.col("n_words").cast("long")).alias("b"),
        (100 * F.col("capitals").cast("long") > most_capitals * F.col("points").cast("long")).alias("c"), "d",
    )


def document_filters(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of five filters over documents: short, repetitive, capitals, marks, repeated text."""
    facts = repeats_of_smaller_id(written(text_facts(documents), "facts"))
    marked = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").alias("_labelled")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("_good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("_toxic")
    )
    joined = facts.join(marked, facts["doc_id"] == marked["_labelled"], "left")
    flagged = joined.withColumns({"is_good": F.coalesce("_good", F.lit(False)), "is_toxic": F.coalesce("_toxic", F.lit(False))})
    return interactions(flagged, [F.col(c) for c in ("a", "b", "c", "d", "repeated")], "ABCDE")


SQL = r"""
with d as (
    select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words
    from documents
), firsts as (
    select text, min(doc_id) as first_id from d group by text
), flags as (
    select d.part,
        [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
         100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 2 * length(d.text),
         regexp_matches(d.text, '[#$%&*|]'), coalesce(d.doc_id > firsts.first_id, false)] as fails,
        coalesce(l.good, false) as good, coalesce(l.toxic, false) as toxic
    from d join firsts on d.text = firsts.text
    left join (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id) l on l.doc_id = d.doc_id
), masks as (
    select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from flags group by part, fails
), letters as (
    select * from (values ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)) t(letter, place)
), orders as (
    select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.place, b.place, c.place, d.place, e.place] as places
    from letters a, letters b, letters c, letters d, letters e
    where len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5
), steps as (
    select filter_order, step::int as step, places[step] as own, places[:step - 1] as earlier from orders, range(1, 6) s(step)
), counted as (
    select part, filter_order, step, own,
        sum(n) filter (not own_fails and not gone) as kept,
        sum(n) filter (own_fails and not gone) as removed,
        sum(n) filter (own_fails and gone) as redundant,
        sum(n) filter (own_fails and n_fails = 1) as unique_fails,
        sum(good) filter (own_fails and not gone) as good_lost,
        sum(toxic) filter (own_fails and not gone) as toxic_lost
    from (
        select steps.*, masks.*, fails[own] as own_fails, len(list_filter(earlier, lambda p: fails[p])) > 0 as gone,
            len(list_filter(fails, lambda f: f)) as n_fails
        from steps, masks
    )
    group by part, filter_order, step, own
)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
    coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
    (coalesce(sum(removed) over (partition by part, own), 0))::bigint as shapley
from counted
"""


@query(SQL)
def op13_filter_interactions(spark, folder):
    return document_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))
