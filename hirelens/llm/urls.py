"""URL filters: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

A list entry is a host and the beginning of a path, with a verdict; it fits the host and its subdomains.
A URL's possible entries are its host's suffixes with its path's beginnings, at the lengths that the
list has. Their hashes are tested against the filter: one block of 512 bits and eight bits in it for each
entry. Possible hits go to a hash join with the list, which removes false positives; of the entries that
remain the longest wins (longer text, then `block`). A URL that no entry fits gets `otherwise`.

The filter has a fixed largest size (`most_blocks` of 64 bytes), whatever the list's length; a fuller one passes
more keys to the join and changes no result. URLs that canonicalise alike are judged once.

Defined cases: a null url and one without `://` have an empty host and path; entries with a null part are
ignored; an empty list lets all pass; repeated rows each get a row. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .work import query, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHAPE = r"(?s)^.*?://([^/?#]*)([^?#]*)"
BITS_PER_ENTRY, PROBES = 16, 8


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, SHAPE, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SHAPE, 2), F.lit(""))


def _bit(key: Column, probe: int) -> Column:
    return F.pmod(F.shiftright(key, 7 * probe + 1), F.lit(512))


def bloom_blocks(entries: DataFrame, most_blocks: int) -> np.ndarray:
    """The filter as (blocks, 8) words; at most `most_blocks` rows reach the driver."""
    count = entries.count()
    n = 1
    while n < most_blocks and n * 512 < count * BITS_PER_ENTRY:
        n *= 2
    keyed = entries.select(F.xxhash64(F.lit(1), "key").alias("_k"), F.pmod(F.xxhash64("key"), F.lit(n)).alias("block"))
    words = [
        F.bit_or(_sum_bits([F.when(F.floor(_bit(F.col("_k"), p) / 64) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (_bit(F.col("_k"), p) % 64).cast("int"))) for p in range(PROBES)])).alias(f"w{w}")
        for w in range(8)
    ]
    out = np.zeros((n, 8), np.int64)
    for row in keyed.groupBy("block").agg(*words).toLocalIterator():
        out[row[0]] = row[1:]
    return out.view(np.uint64)


def _sum_bits(columns: list[Column]) -> Column:
    total = F.lit(0).cast("long")
    for column in columns:
        total = total.bitwiseOR(F.coalesce(column, F.lit(0).cast("long")))
    return total


def may_hold(blocks: np.ndarray, key: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Whether all probed bits of each key are set in its block."""
    held = np.ones(len(key), bool)
    for p in range(PROBES):
        bit = (key >> np.int64(7 * p + 1)) % 512
        held &= (blocks[block, bit // 64] >> (bit % 64).astype(np.uint64)) & np.uint64(1) == 1
    return held


def judge_urls(pages: DataFrame, entries: DataFrame, otherwise: str = "allow", most_blocks: int = 1 << 15) -> DataFrame:
    """page_id, host, path, rule (the entry that decided, else null), verdict. `entries`: host, path, verdict."""
    listed = entries.where("host is not null and path is not null and verdict is not null").select(
        F.concat(F.translate("host", UPPER, LOWER), "path").alias("key"), F.length("path").alias("n"), "verdict"
    ).groupBy("key").agg(F.max("verdict").alias("verdict"), F.max("n").alias("n"))
    lengths = sorted(row["n"] for row in listed.select("n").distinct().toLocalIterator())
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not lengths:
        return split.select("*", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))

    filled = bloom_blocks(listed, most_blocks)
    shared = pages.sparkSession.sparkContext.broadcast(filled)
    n_blocks = len(filled)

    @F.arrow_udf("array<boolean>")
    def possible(keys: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for key, block in keys:
            held = may_hold(shared.value, key.flatten().to_numpy(), block.flatten().to_numpy())
            sizes = key.value_lengths().to_numpy(zero_copy_only=False)
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(held))

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    begins = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: F.length("path") >= n), lambda n: F.substr(F.col("path"), F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(begins, lambda b: F.concat(s, b))))
    urls = split.select("host", "path").where("host <> ''").distinct().withColumn("keys", keys)
    tested = urls.withColumn(
        "maybe", possible(F.transform("keys", lambda k: F.xxhash64(F.lit(1), k)), F.transform("keys", lambda k: F.pmod(F.xxhash64(k), F.lit(n_blocks))))
    )
    hits = tested.select("host", "path", F.explode(F.filter(F.arrays_zip("keys", "maybe"), lambda z: z["maybe"])["keys"]).alias("key"))
    exact = hits.join(listed, "key").groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), "verdict", "key")).alias("_best"))
    return split.join(exact, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("_best.key").alias("rule"), F.coalesce("_best.verdict", F.lit(otherwise)).alias("verdict")
    )


#: Host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

_RULES_SQL = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in RULES)
ORACLE = rf"""
WITH r(rh, rp, v) AS (VALUES {_RULES_SQL}),
     p AS (SELECT row_number() OVER () i, page_id,
                  coalesce(translate(regexp_extract(url, '{SHAPE}', 1), '{UPPER}', '{LOWER}'), '') host,
                  coalesce(regexp_extract(url, '{SHAPE}', 2), '') path FROM pages),
     best AS (SELECT i, arg_max(rh || rp, length(rh || rp)) rule, arg_max(v, length(rh || rp)) v
              FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(v, 'allow') verdict FROM p LEFT JOIN best USING (i)
"""


@query(ORACLE)
def op4_url_filter(spark, folder):
    entries = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, folder, "pages"), entries)
