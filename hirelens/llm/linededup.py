"""Line deduplication by pairwise alignment.

1. Each document's distinct line hashes are counted over all documents; a line's owner is the first
   document (smallest doc_id) that holds it. Counting combines before the shuffle.
2. A document is paired with the owners of all its shared lines, however many documents hold them. A document has one
   pair for each owner and lines are never paired among all their holders, so pairs grow with the lines.
3. Patience diff aligns the pair: equal beginnings and ends, then the lines that occur once in both, in the
   longest common order, then the stretches between these in the same way.
4. Blocks of aligned lines are deleted from the later document, unless all of a block's lines are blank.

The first document with a line always keeps it, so each line survives somewhere. Only line hashes (64 bits) are
shuffled for pairs; a hot owner's pairs are spread by adaptive skew splitting, since each joins one row.

Defined cases: a null text or doc_id takes no part and is returned as it is; an empty text has one blank line;
rows that repeat doc_id and text are one document and get the same result; documents with one doc_id are ordered by text
hash; lines end at U+000A only; an empty table gives no rows. Extra columns of the input are returned
unchanged; columns named like the added ones are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .tokens import give_back
from .work import query, table, written


def _unique_places(lines: list[int], low: int, high: int) -> dict[int, int]:
    places: dict[int, int] = {}
    for i in range(low, high):
        places[lines[i]] = -1 if lines[i] in places else i
    return {line: i for line, i in places.items() if i >= 0}


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned (place in a, place in b), increasing in both."""
    found: list[tuple[int, int]] = []
    open_ = [(0, len(a), 0, len(b))]
    while open_:
        i, m, j, n = open_.pop()
        while i < m and j < n and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            found.append((m, n))
        if i == m or j == n:
            continue
        in_a, in_b = _unique_places(a, i, m), _unique_places(b, j, n)
        common = sorted((in_a[line], at) for line, at in in_b.items() if line in in_a)
        # The longest run of common lines whose places rise in b as well: tops of sorted piles, then back links.
        tops: list[int] = []
        held: list[int] = []
        back: list[int] = []
        for k, (_, at) in enumerate(common):
            pile = bisect_left(tops, at)
            back.append(held[pile - 1] if pile else -1)
            if pile == len(tops):
                tops.append(at)
                held.append(k)
            else:
                tops[pile], held[pile] = at, k
        chain: list[tuple[int, int]] = []
        k = held[-1] if held else -1
        while k >= 0:
            chain.append(common[k])
            k = back[k]
        chain.reverse()
        if chain:
            found += chain
            for (p, q), (r, s) in zip([(i - 1, j - 1), *chain], [*chain, (m, n)]):
                open_.append((p + 1, r, q + 1, s))
    return sorted(found)


def common_blocks(first: list[int], later: list[int], blank: set[int]) -> list[int]:
    """Lines of `later` in aligned blocks that are not all blank."""
    kept: list[int] = []
    block: list[int] = []
    before = (-2, -2)
    for pair in [*patience(first, later), (-9, -9)]:
        if pair != (before[0] + 1, before[1] + 1):
            if any(later[j] not in blank for j in block):
                kept += block
            block = []
        block.append(pair[1])
        before = pair
    return kept


BLANK = 0


def line_hashes(text):
    """One hash a line; 0 for a blank one."""
    return F.transform(F.split(text, "\n"), lambda line: F.when(line.rlike(r"^\s*$"), F.lit(BLANK).cast("long")).otherwise(F.xxhash64(line)))


def _sliced(*columns: pa.Array, rows: int = 1_000) -> Iterator[tuple]:
    """Rows of several columns as Python values, so many at a time."""
    for first in range(0, len(columns[0]), rows):
        yield from zip(*(column.slice(first, rows).to_pylist() for column in columns))
    give_back()


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _aligned(firsts: pa.Array, laters: pa.Array) -> pa.Array:
    return pa.array([common_blocks(a, b, {BLANK}) for a, b in _sliced(firsts, laters)], pa.list_(pa.int32()))


@F.arrow_udf(T.StringType())
def _without(texts: pa.Array, removed: pa.Array) -> pa.Array:
    out = []
    for text, gone in _sliced(texts, removed):
        if text is None or gone is None:
            out.append(None)
            continue
        cut = set(gone)
        out.append("\n".join(line for i, line in enumerate(text.split("\n")) if i not in cut))
    return pa.array(out, pa.string())


def removable_lines(documents: DataFrame) -> DataFrame:
    """(_doc, _text, n_partners, removed): the lines to delete from each document that has any, counted from 0."""
    marked = documents.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("_text"), line_hashes(F.col("text")).alias("_lines"))
    marked = written(marked.dropDuplicates(["doc_id", "_text"]), "line_hashes")
    document = F.struct("doc_id", "_text").alias("document")
    held = marked.select(document, F.explode(F.array_distinct("_lines")).alias("line")).where(F.col("line") != BLANK)
    shared = held.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min("document").alias("owner")).where("n > 1").drop("n")
    pairs = held.join(shared, "line").where("owner <> document").select("document", "owner").distinct()
    lines = marked.select(document, "_lines")
    both = pairs.join(lines, "document").withColumnsRenamed({"_lines": "later", "document": "_document"})
    both = both.join(lines.withColumnsRenamed({"_lines": "first", "document": "owner"}), "owner")
    aligned = both.select("_document", "owner", _aligned("first", "later").alias("removed")).where(F.size("removed") > 0)
    found = aligned.groupBy("_document").agg(F.countDistinct("owner").alias("n_partners"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("removed")))).alias("removed"))
    return found.select(F.col("_document.doc_id").alias("_doc"), F.col("_document._text").alias("_text"), "n_partners", "removed")


def dedup_lines(documents: DataFrame) -> DataFrame:
    """The given rows with `text` after deletion, and n_lines, n_removed, n_partners, removed added."""
    added = ["n_lines", "n_removed", "n_partners", "removed"]
    kept = documents.drop(*added)
    removable = removable_lines(documents).withColumnRenamed("_text", "_cut_text")
    joined = kept.withColumn("_hash", F.xxhash64("text")).join(removable, (F.col("doc_id") == F.col("_doc")) & (F.col("_hash") == F.col("_cut_text")), "left")
    cut = F.coalesce(_without(F.when(F.col("removed").isNotNull(), F.col("text")), F.col("removed")), F.col("text"))
    columns = [cut.alias("text") if name == "text" else F.col(name) for name in kept.columns]
    return joined.select(
        *columns, F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"),
        F.coalesce("n_partners", F.lit(0)).cast("int").alias("n_partners"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )


@query()
def op9_line_dedup(spark, folder):
    out = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "n_lines", "n_removed", "n_partners", "removed")
