"""Computing a column once.

Catalyst moves filters below projections and merges projections, copying expressions as it goes.
For a cheap expression that is what one wants. A regular expression over a long text would then
run once per copy. Emitting the values from a one-row generator keeps them where they are; filters
on other columns still move below it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def computed_once(table: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add or replace columns whose expressions are evaluated exactly once per row."""
    kept = [name for name in table.columns if name not in columns]
    row = F.struct(*(value.alias(name) for name, value in columns.items()))
    return table.select(*kept, F.inline(F.array(row)))
