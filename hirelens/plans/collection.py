"""One collection run over the landings of many companies: postings of those that went well, a log row for each.

Landings lie in folders `ats=<platform>/company=<name>/run=<run>`. One scan a platform reads all its companies, and company, run and
place travel with every posting. A company is judged by what its own payloads hold; one that fails loses its postings of
the run and gets a log row with the first thing that is wrong, and no other company notices.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..fixed_values import REQUIRED_FIELDS
from ..operators.quality import missing_fields
from ..schemas import POSTING
from ..session import written
from ..sources import adapters, greenhouse, landed, lever, smartrecruiters
from ..sources.variants import CORRUPT
from .maintenance import failed_run_log, run_log

RUN_COLUMNS = ("company", "run", "ordinal")
READERS: dict[str, Callable[..., DataFrame]] = {
    lever.ATS: landed.read_lever,
    greenhouse.ATS: landed.read_greenhouse,
    smartrecruiters.ATS: landed.read_smartrecruiters_details,
}
#: What can be wrong with a company's run, in the order in which it is told.
UNREADABLE, ODD_ITEM, WRONG_TOTAL, NOTHING, INCOMPLETE, REPEATED = range(6)


def _faults(rows: DataFrame, kind: int, place: Column | str, text: Column) -> DataFrame:
    """(company, kind, place, error)."""
    return rows.select("company", F.lit(kind).alias("kind"), (F.lit(0) if place is None else place).cast("bigint").alias("place"), text.alias("error"))


def _reading_faults(raw: DataFrame) -> DataFrame:
    """What `_faults` gives for payloads and items that cannot be read and for wrong totals, in one scan of the landings."""

    def fault(kind: int, place: Column, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), place.cast("bigint").alias("place"), text.alias("error"))

    unreadable = F.concat(F.lit("not the payload that was expected: "), F.substring(CORRUPT, 1, 80))
    found = F.when(F.col(CORRUPT).isNotNull(), F.array(fault(UNREADABLE, F.lit(0), unreadable)))
    if "odd_items" in raw.columns:
        odd = F.transform("odd_items", lambda item: fault(ODD_ITEM, item["place"], F.concat(F.lit("item "), item["place"] + 1, F.lit(" is no object"))))
        declared, held = F.col("meta.total"), F.coalesce(F.array_size("jobs"), F.lit(0))
        total = fault(WRONG_TOTAL, F.lit(0), F.concat(declared, F.lit(" postings declared, "), held, F.lit(" held")))
        wrong = F.when(declared != held, F.array(total))
        none = F.array().cast("array<struct<kind:int,place:bigint,error:string>>")
        found = F.coalesce(found, F.concat(F.coalesce(odd, none), F.coalesce(wrong, none)))
    return raw.select("company", found.alias("_found")).select("company", F.inline("_found"))


def _platform(spark: SparkSession, root: str, ats: str, run: str, collected_at: str, multi_line: bool) -> tuple[DataFrame, list[DataFrame]]:
    """Normalised postings of a platform's companies with their faults in reading."""
    raw = READERS[ats](spark, f"{root}/ats={ats}", multi_line).filter(F.col("run") == run)
    good = raw.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    faults = [_reading_faults(raw)]
    adapter = adapters.ADAPTERS[ats]
    postings = adapter.normalise(adapter.explode(good), F.col("company"), F.lit(collected_at), ("run", "ordinal"))
    whole = [F.col(f.name) if f.name in postings.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(POSTING)]
    return postings.select(*whole, "run", "ordinal"), faults


def collect_run(
    spark: SparkSession, root: str, companies: DataFrame, run: str, collected_at: str, multi_line: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(postings, log) of a run. `companies` (company, ats) are the ones that should have landed; all of them are logged.

    Texts are read once: normalised postings are written, and the checks and the result read those. Faults leave a task as one row a
    company.
    """
    platforms = sorted(row["ats"] for row in companies.select("ats").distinct().collect())
    read = [_platform(spark, root, ats, run, collected_at, multi_line) for ats in platforms if _has_folder(spark, f"{root}/ats={ats}")]
    faults = [fault for _, found in read for fault in found]
    expected = companies.select("company").distinct()
    if read:
        staged = written(reduce(DataFrame.unionByName, [postings for postings, _ in read]).join(expected, "company", "left_semi"), "run")
        lacking = staged.select("company", "ordinal", missing_fields(staged, REQUIRED_FIELDS).alias("fields")).filter(F.size("fields") > 0)
        faults.append(_faults(lacking, INCOMPLETE, F.col("ordinal"), F.concat(F.lit("posting "), F.col("ordinal") + 1, F.lit(" is missing: "), F.array_join("fields", ", "))))
        repeated = staged.groupBy("company", "job_id").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("place")).filter("n > 1")
        faults.append(_faults(repeated, REPEATED, F.col("place"), F.concat(F.lit("duplicate job id: "), F.col("job_id"))))
    else:
        staged = spark.createDataFrame([], f"{POSTING}, run STRING, ordinal INT")
    empty = expected.join(staged.select("company").distinct(), "company", "left_anti")
    faults.append(_faults(empty, NOTHING, None, F.lit("the source returned no postings")))
    first = reduce(DataFrame.unionByName, faults).join(expected, "company", "left_semi").groupBy("company").agg(F.min(F.struct("kind", "place", "error")).alias("fault"))
    failed = written(first.select("company", F.col("fault.error").alias("error")), "failed")
    postings = staged.join(failed.select("company"), "company", "left_anti")
    date = F.to_date(F.substring(F.lit(collected_at), 1, 10))
    log = run_log(postings, "company", date, F.lit(run)).unionByName(failed_run_log(failed, "company", "error", date, F.lit(run)))
    return postings, log


def _has_folder(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
