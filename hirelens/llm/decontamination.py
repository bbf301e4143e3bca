"""Benchmark decontamination by winnowing, with DataFrame expressions only.

A window is 13 consecutive words of an item, or the whole of a shorter one. In each 13-word stretch
of a text the smallest of its nine 5-gram hashes is kept. A stretch that a document shares with an
item keeps the same hash in both, so joining the kept hashes misses no document: every shared
span of 13 words or more is found. Hits are then extended: the documents found have all their windows
compared, word for word, with the items' windows. Shorter items are looked up by the hash of the
whole item, at the lengths that occur.

A document's hashes and word count are written once as a small table; its text is read again only if
a hash was found. Item windows are broadcast if their number is within `broadcast_windows`; otherwise
the same joins shuffle. Nothing is grouped by a hash, so a passage in many documents makes no large
group; each document's hits come together by document.

Defined cases: a null or wordless text has no words and no hits; items with a null id or without words
are ignored; rows with the same item id count as one item; repeated documents each get a row; an empty
table on either side gives no hits or no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .work import query, table, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, GRAM = 13, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _split(text: Column) -> Column:
    """The stretches between separators, without the empty ones that a split leaves at the ends."""
    def inner(parts: Column) -> Column:
        first = F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
        last = F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
        return F.slice(parts, first + 1, F.greatest(F.size(parts) - first - last, F.lit(0)))

    return F.coalesce(let(F.split(text, SEPARATORS), inner), F.array().cast("array<string>"))


def item_words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; none for null."""
    return _split(F.translate(text, UPPER, LOWER))


def loose_words(text: Column) -> Column:
    """As many words, with all letters lower-cased: equal wherever `item_words` are, and faster. Only for finding."""
    return _split(F.lower(text))


def _beside(left: Column, right: Column, step: int, join: Callable[[Column, Column], Column]) -> Column:
    """join(left[i], right[i + step]) for every i that has both."""
    size = F.greatest(F.least(F.size(left), F.size(right) - step), F.lit(0))
    return F.zip_with(F.slice(left, F.lit(1), size), F.slice(right, F.lit(1 + step), size), join)


def gram_hashes(hashes: Column, size: int) -> Column:
    """Hashes of all runs of `size` words, from the words' hashes, by doubling."""
    def grow(run: Column, have: int) -> Column:
        if have == size:
            return run
        step = min(have, size - have)
        if step == have:
            return let(_beside(run, run, have, lambda a, b: F.xxhash64(a, b)), lambda longer: grow(longer, 2 * have))
        return let(gram_hashes(hashes, step), lambda rest: grow(_beside(run, rest, have, lambda a, b: F.xxhash64(a, b)), have + step))

    return grow(hashes, 1)


def winnowed(words: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """The distinct smallest gram hashes of all stretches of `window` words; none for fewer words."""
    def least(run: Column, have: int, need: int) -> Column:
        if have == need:
            return run
        step = min(have, need - have)
        return let(_beside(run, run, step, lambda a, b: F.least(a, b)), lambda longer: least(longer, have + step, need))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: let(gram_hashes(h, gram), lambda g: F.array_distinct(least(g, 1, window - gram + 1))))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id, n, words): the windows of all items, words joined by blanks."""
    split = items.where("item_id is not null").select("item_id", item_words(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    n = F.least(F.size("_w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("_w") - n + 1)
    each = split.select("item_id", n.alias("n"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("_w", i, n), " "))).alias("words"))
    return each.distinct()


def _small(frame: DataFrame, is_small: bool) -> DataFrame:
    return F.broadcast(frame) if is_small else frame


def find_hits(documents: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast_windows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(doc_id, _text, n_words) of every row, and (doc_id, _text, begin, n, item_id) of every window found; begin from 0."""
    windows = written(item_windows(items, window), "item_windows")
    lengths = {row["n"]: row["rows"] for row in windows.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).collect()}
    is_small = sum(lengths.values()) <= broadcast_windows
    short = sorted(n for n in lengths if n < window)

    text_key = F.xxhash64("text").alias("_text")
    marked = documents.select("doc_id", text_key, let(loose_words(F.col("text")), lambda w: F.struct(F.size(w).alias("n_words"), winnowed(w, window, gram).alias("kept"))).alias("_f"))
    marked = written(marked, "document_hashes")
    counts = marked.select("doc_id", "_text", F.col("_f.n_words").cast("long").alias("n_words"))

    item_kept = windows.where(F.col("n") == window).select(F.explode(winnowed(F.split(F.lower("words"), " "), window, gram)).alias("kept")).distinct()
    found = marked.select("doc_id", "_text", F.explode("_f.kept").alias("kept")).join(_small(item_kept, is_small), "kept", "left_semi").select("doc_id", "_text")
    if short:
        word_hashes = lambda words: F.transform(words, lambda w: F.xxhash64(w))
        runs = let(word_hashes(loose_words(F.col("text"))), lambda h: F.array_distinct(F.concat(*(gram_hashes(h, n) for n in short))))
        whole = F.lit(None).cast("array<bigint>")
        for n in short:
            whole = F.when(F.col("n") == n, gram_hashes(word_hashes(F.split(F.lower("words"), " ")), n)).otherwise(whole)
        keys = windows.where(F.col("n") < window).select(F.explode(whole).alias("kept")).distinct()
        by_run = documents.select("doc_id", text_key, F.explode(runs).alias("kept")).join(_small(keys, is_small), "kept", "left_semi")
        found = found.union(by_run.select("doc_id", "_text"))
    found = written(found.distinct().withColumnsRenamed({"doc_id": "_id", "_text": "_key"}), "documents_found")

    texts = documents.select("doc_id", text_key, "text").join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), "left_semi")
    texts = texts.dropDuplicates(["doc_id", "_text"]) if not documents.isStreaming else texts
    split = texts.select("doc_id", "_text", item_words(F.col("text")).alias("_w"))

    def runs_of(n: int) -> Column:
        starts = F.when(F.size("_w") >= n, F.sequence(F.lit(1), F.size("_w") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct((i - 1).alias("begin"), F.lit(n).alias("n"), F.array_join(F.slice("_w", i, n), " ").alias("words")))

    every = [runs_of(n) for n in sorted(lengths) or [window]]
    stretches = split.select("doc_id", "_text", F.inline(F.concat(*every)))
    return counts, stretches.join(_small(windows, is_small), ["n", "words"]).select("doc_id", "_text", "begin", "n", "item_id")


def contamination(documents: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, share: int = 20, broadcast_windows: int = 200_000) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, item_ids (sorted), spans hit, contaminated.

    A word inside any occurrence of a window is hit; a document is contaminated when one word in `share` is.
    """
    counts, hits = find_hits(documents, items, window, gram, broadcast_windows)
    by_text = hits.groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_key")).agg(
        F.sort_array(F.collect_set(F.struct("begin", (F.col("begin") + F.col("n")).alias("end")))).alias("_hit"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"),
    )
    # Overlapping and touching stretches become one span, in the order of their beginnings.
    merged = F.aggregate(
        "_hit", F.array().cast("array<struct<begin:int,end:int>>"),
        lambda spans, s: F.when(
            (F.size(spans) > 0) & (F.element_at(spans, -1)["end"] >= s["begin"]),
            F.concat(
                F.slice(spans, F.lit(1), F.size(spans) - 1),
                F.array(F.struct(F.element_at(spans, -1)["begin"].alias("begin"), F.greatest(F.element_at(spans, -1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(spans, F.array(s))),
    )
    by_text = by_text.select("_id", "_key", "item_ids", merged.alias("spans"))
    joined = counts.join(by_text, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), "left")
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"]), F.lit(0).cast("long"))
    out = joined.select(
        "doc_id", "_text", "n_words", n_hit.alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("spans", F.array().cast("array<struct<begin:int,end:int>>")).alias("spans"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


ORACLE = rf"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') w
           FROM benchmark WHERE item_id IS NOT NULL),
     p AS (SELECT item_id, least(len(w), {WINDOW}) n, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) s FROM i WHERE len(w) > 0),
     windows AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') ws FROM p),
     d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+'), []) w FROM documents),
     sizes AS (SELECT DISTINCT n FROM windows),
     e AS (SELECT doc_id, w, sizes.n, unnest(range(1, len(w) - sizes.n + 2)) s FROM d, sizes),
     h AS (SELECT doc_id, s, e.n, item_id FROM (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') ws FROM e) e JOIN windows USING (n, ws)),
     words AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) p FROM h) GROUP BY doc_id),
     ids AS (SELECT doc_id, count(*) n_items, string_agg(id, ',' ORDER BY id) ids
             FROM (SELECT DISTINCT doc_id, item_id::VARCHAR id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


@query(ORACLE)
def op10_decontamination(spark, folder):
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )
