"""Posting search, facets, ordering and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ..functions.text import contains_keyword
from ..session import ensure_checkpoint_dir

PAGE_SIZE = 12
#: Keys sampled at a time to close in on a page, and rows that are simply sorted.
PAGE_SAMPLE = 4_000


def search_postings(
    postings: DataFrame, keyword: str, category: str, columns: Sequence[str], category_column: str
) -> DataFrame:
    found = postings.filter(contains_keyword(keyword, *columns))
    return found if category == "All" else found.filter(F.col(category_column) == category)


def facets(postings: DataFrame, equal: dict[str, object] | None = None,
           skills: Sequence[str] = (), skill_column: str = "skills",
           keyword: str = "", keyword_columns: Sequence[str | Column] = ()) -> DataFrame:
    """AND of the given filters; each is optional. Every wanted skill must be held."""
    found = postings
    for column, value in (equal or {}).items():
        found = found.filter(F.col(column) == F.lit(value))
    for skill in skills:
        found = found.filter(F.array_contains(skill_column, skill))
    return found.filter(contains_keyword(keyword, *keyword_columns)) if keyword.strip() else found


def with_salary(postings: DataFrame, column: str = "salary_min") -> DataFrame:
    return postings.filter(F.col(column).isNotNull())


def salary_order(key: str) -> list[Column]:
    """Currency, then the higher minimum first, missing values last; the key settles ties."""
    return [F.asc_nulls_last("salary_currency"), F.desc_nulls_last("salary_min"), F.asc(key)]


def sort_extracted(table: DataFrame, order: Sequence[Column | str], key: str) -> DataFrame:
    """Sort a small result of costly work, doing that work once.

    A global sort first samples its input, which would read every text a second time. Handing the
    extracted rows over by key lets the sample read those instead.
    """
    return table.repartition(key).orderBy(*order)


def newest_first(date: str, ordinal: str) -> list[Column]:
    return [F.desc_nulls_last(date), F.asc(ordinal)]


def head(table: DataFrame, order: Sequence[Column | str], rows: int) -> DataFrame:
    """The first rows of an order: a top-k, not a full sort."""
    return table.orderBy(*order).limit(rows)


def sample_or_any(postings: DataFrame, wanted: Column, order: Sequence[Column | str], rows: int) -> DataFrame:
    """The first rows that are wanted; when none is, the first rows of all."""
    any_wanted = postings.agg(F.coalesce(F.bool_or(wanted), F.lit(False)).alias("any")).scalar()
    return head(postings.filter(wanted | ~any_wanted), order, rows)


def page(
    table: DataFrame, order: Sequence[str], number: int, size: float | None = PAGE_SIZE, sample: int = PAGE_SAMPLE,
) -> DataFrame:
    """One page of an order, the number clamped to the pages there are. `order` names columns, `-name` for descending; nulls last.

    The rows about the page are closed in by pairs of keys: a sample of the keys between the last pair gives the next one, a count of
    the rows before each says whether it still holds the page, and so on until about `sample` rows are left to sort. No
    task sees more rows, whichever page is asked for, and the last reading takes the bounds to the scan. Only `sample`
    keys at a time come to the driver. The order should end in a unique column; rows that tie in all keys can't be parted.
    """
    rows = max(1, int(size or 1))
    total = table.count()
    pages = max(1, -(-total // rows))
    start = (min(max(1, number), pages) - 1) * rows
    names = [name.lstrip("-") for name in order]
    sorting = [F.desc_nulls_last(n) if o.startswith("-") else F.asc_nulls_last(n) for n, o in zip(names, order)]
    low = high = None
    before, inside = 0, total
    while inside > max(sample, 2 * rows):
        part, want = _between(table, order, low, high), start - before
        picks = part.select(*names).sample(fraction=min(1.0, sample / inside), seed=total).orderBy(*sorting).limit(2 * sample).collect()
        slack = 1.5 * len(picks) ** 0.5 + 1
        first, last = int(want / inside * len(picks) - slack), int((want + rows) / inside * len(picks) + slack) + 1
        lower = picks[first] if 0 <= first < len(picks) else None
        upper = picks[last] if last < len(picks) else None
        n_lower, n_upper = part.agg(
            F.count_if(F.lit(False) if lower is None else _precedes(order, lower)), F.lit(inside) if upper is None else F.count_if(_precedes(order, upper))
        ).first()
        # A bound that the sample has misplaced is dropped, and the old one stays.
        if lower is None or n_lower > want:
            lower, n_lower = low, 0
        if upper is None or n_upper < min(want + rows, inside):
            upper, n_upper = high, inside
        if n_upper - n_lower == inside:
            break
        low, high, before, inside = lower, upper, before + n_lower, n_upper - n_lower
    return _between(table, order, low, high).orderBy(*sorting).offset(start - before).limit(rows)


def _precedes(order: Sequence[str], bound: Row) -> Column:
    """Whether a row comes before a row of order columns."""
    test, same = F.lit(False), F.lit(True)
    for place, key in enumerate(order):
        column, value = F.col(key.lstrip("-")), bound[place]
        if value is None:
            earlier = column.isNotNull()
        else:
            earlier = F.coalesce(column > F.lit(value) if key.startswith("-") else column < F.lit(value), F.lit(False))
        test, same = test | (same & earlier), same & column.eqNullSafe(F.lit(value))
    return test


def _between(table: DataFrame, order: Sequence[str], low: Row | None, high: Row | None) -> DataFrame:
    """Rows from `low` on and before `high`. The first key's part is said apart, in a form that scans can use."""
    key = order[0].lstrip("-")
    for bound, upper in ((low, False), (high, True)):
        if bound is not None:
            test = _precedes(order, bound)
            table = table.filter(test if upper else ~test)
            if bound[0] is not None and (upper or order[0].startswith("-")):
                # Nulls come last, so only an upper bound keeps them out.
                wide = F.col(key) >= F.lit(bound[0]) if order[0].startswith("-") else F.col(key) <= F.lit(bound[0])
                table = table.filter(wide) if upper else table.filter((F.col(key) <= F.lit(bound[0])) | F.col(key).isNull())
            elif bound[0] is not None:
                table = table.filter((F.col(key) >= F.lit(bound[0])) | F.col(key).isNull())
    return table


def with_global_place(table: DataFrame, order: Sequence[Column | str], into: str) -> DataFrame:
    """Number all rows of an order without bringing them together.

    Rows are range-partitioned by the order; each range is numbered on its own and shifted by the
    rows of the ranges before it. The ranges are checkpointed, so counts and rows agree even when
    an executor is lost. The order should end in a unique column, which keeps ranges even.
    """
    spark = table.sparkSession
    ensure_checkpoint_dir(spark)
    numbered = (
        table.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        # Partition in the upper bits, row in the lower 33; fixed by the checkpoint.
        .withColumn("_id", F.monotonically_increasing_id())
        .checkpoint()
    )
    placed = numbered.withColumns({
        "_range": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    }).drop("_id")
    # One row per range, and so no more than there are shuffle partitions: safe to broadcast.
    counts = placed.groupBy("_range").agg(F.max("_row").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return (
        placed.join(F.broadcast(shifts), "_range")
        .withColumn(into, F.col("_row") + F.col("_shift"))
        .drop("_range", "_row", "_shift")
    )
