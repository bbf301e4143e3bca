"""Exact Jaccard similarity join of word shingles as a metric-space join.

1 - Jaccard is a metric. Documents with equal sets are one class, and one document stands for each.

Regions. In a corpus most documents share nothing and lie at distance 1 from each other and from any pivot: since
the similarities of disjoint sets to one pivot sum to 1 at most, a pivot tells only a few of them apart. So
the first regions come from the documents that a pivot shares something with: in the order from rare
to common, two sets within the threshold share e of their first n - ceil(t n) + e shingles, where e is the smaller of their
1 + n / 8. Documents that hold such a shingle, and whose sizes chain within the threshold, form a group; its smallest
member is the pivot, and all groups of one pivot are its region. If two linked documents share c shingles at most in any region,
a document's regions hold c or, where it has fewer there, these at most; together that must come to its own e. A document
stays in a region only if its count there is such a c. That keeps every link and drops the regions that a chance shingle or a short
passage led to.

Inside a region distances to the pivot are exact. A document within the threshold is linked to it and need not be a
pivot itself; the others become pivots in turn. A pair of which neither was a pivot can only link two
unconnected parts if its documents lie within twice the threshold of one pivot (triangle inequality): such boundary
documents are pivots as well. So no link between two parts is lost, and near copies in any number
cost one pass each, not one for each pair.

Regions over `leaf_rows` documents or `leaf_shingles` shingles are first split: their documents are dealt over tasks
with a copy of the pivot, and those not linked to it, with the linked ones inside the window, form the next,
smaller region. If a region stays large and does not shrink, in documents or in shingles, by a tenth (by half, if it makes few
blocks), its blocks meet in pairs, one task each. So the rounds grow with the logarithm of a region's size. The first round keeps
the texts of these documents, and later ones read no others.

Defined cases: a null, empty or wordless text has no shingle and no links; fewer than five words are one shingle;
rows with a null id have a null component; rows that repeat id and text are alike; different texts under one id
may count as linked; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frequency import count_classes, ordered, shingle_counts
from .graph import components
from .tokens import SHINGLE, blocks, give_back, mixed, shingles, slices, words
from .work import broadcast_if_small, query, table, written

LEAST, OF = 75, 100
EXTRA = 8
#: Blocks of a large region of which all pairs cost less than the rounds that would make it smaller bit by bit.
FEW_BLOCKS = 16


def extra(n):
    """Shingles that a set's prefix holds beyond the ones that make a first common one sure, counted with that one."""
    return 1 + n // EXTRA


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(place, sorted distinct shingle hashes) of every text."""
    for block in blocks(column):
        runs, at = shingles(words(block), size)
        for i in range(len(block)):
            yield block.first + i, np.unique(runs[at[i] : at[i + 1]])


def signatures(documents: DataFrame, size: int) -> DataFrame:
    """doc_id, _text, n_shingles and two sums that name the set."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = np.zeros((batch.num_rows, 3), np.int64)
            for i, own in shingle_sets(batch.column("text"), size):
                sums = mixed(own).sum(dtype=np.uint64), mixed(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                rows[i] = len(own), *np.array(sums, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_text"), *(pa.array(rows[:, k]) for k in range(3))], ["doc_id", "_text", "n_shingles", "set_a", "set_b"])

    given = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_text"), "text")
    return given.mapInArrow(sign, "doc_id long, _text long, n_shingles long, set_a long, set_b long")


def prefixes(documents: DataFrame, classes: np.ndarray, size: int, least: int, of: int, buckets: int) -> DataFrame:
    """Packed (shingle key, document, set size) of each set's first shingles, by bucket of the key."""
    shared = documents.sparkSession.sparkContext.broadcast(classes)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column("doc_id").to_numpy()
            keys, docs, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, own in shingle_sets(batch.column("text"), size):
                n = len(own)
                if n:
                    reach = min(n, n + (least * n // -of) + extra(n))
                    own = ordered(shared.value, own)
                    keys.append(np.partition(own, reach - 1)[:reach] if reach < n else own)
                    docs.append(np.full(reach, ids[i]))
                    sizes.append(np.full(reach, n))
            keys, docs, sizes = map(np.concatenate, (keys, docs, sizes))
            bucket = (mixed(keys) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            packed = [[x[order[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:]) if b > a] for x in (keys, docs, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(np.diff(cuts)), pa.int64()), *(pa.array(p, pa.binary()) for p in packed)], ["bucket", "keys", "docs", "sizes"])

    return documents.select("doc_id", "text").mapInArrow(first, "bucket long, keys binary, docs binary, sizes binary")


def group_members(batches: Iterator[pa.RecordBatch], least: int, of: int, lanes: int) -> Iterator[pa.RecordBatch]:
    """Packed (region, doc_id, set size, shingles shared) of one bucket, by lane of the document: the pivot and members of each
    group of two or more."""
    parts: list[list[np.ndarray]] = [[], [], []]
    for batch in batches:
        for part, name, kind in zip(parts, ("keys", "docs", "sizes"), (np.uint64, np.int64, np.int64)):
            part += [np.frombuffer(x, kind) for x in batch.column(name).to_pylist()]
    keys, docs, sizes = map(np.concatenate, parts)
    order = np.lexsort((docs, sizes, keys))
    keys, docs, sizes = keys[order], docs[order], sizes[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (of * sizes[:-1] < least * sizes[1:])
    group = np.cumsum(new) - 1
    pivot = np.minimum.reduceat(docs, np.flatnonzero(new))
    keep = (np.bincount(group) > 1)[group]
    at = np.lexsort((docs[keep], pivot[group[keep]]))
    region, doc, size = pivot[group[keep]][at], docs[keep][at], sizes[keep][at]
    starts = np.flatnonzero(np.concatenate([[True], (region[1:] != region[:-1]) | (doc[1:] != doc[:-1])])[: len(at)])
    found = [region[starts], doc[starts], size[starts], np.diff(np.append(starts, len(at)))]
    lane = (mixed(found[1].view(np.uint64)) % np.uint64(lanes)).astype(np.int64)
    order = np.argsort(lane, kind="stable")
    cuts = np.searchsorted(lane[order], np.arange(lanes + 1))
    full = np.flatnonzero(np.diff(cuts))
    packed = [pa.array([column[order[cuts[k] : cuts[k + 1]]].tobytes() for k in full], pa.binary()) for column in found]
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), *packed], ["lane", *MEMBERSHIP])


MEMBERSHIP = ("regions", "docs", "sizes", "shared")


def kept_members(batches: Iterator[pa.RecordBatch], least: int, of: int) -> Iterator[pa.RecordBatch]:
    """(region, doc_id, n) of the documents of one lane, in the regions where they have the shingles that a link needs."""
    parts: list[list[np.ndarray]] = [[] for _ in MEMBERSHIP]
    for batch in batches:
        for part, name in zip(parts, MEMBERSHIP):
            part += [np.frombuffer(x, np.int64) for x in batch.column(name).to_pylist()]
    region, doc, size, shared = map(np.concatenate, parts)
    order = np.lexsort((region, doc))
    region, doc, size, shared = (column[order] for column in (region, doc, size, shared))
    starts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (region[1:] != region[:-1])])[: len(doc)])
    region, doc, size, shared = region[starts], doc[starts], size[starts], np.add.reduceat(shared, starts)
    # From each document's smallest count to its largest: what the regions hold if none holds more than this one.
    order = np.lexsort((shared, doc))
    region, doc, size, shared = (column[order] for column in (region, doc, size, shared))
    firsts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])[: len(doc)])
    ends = np.append(firsts[1:], len(doc))
    below = np.cumsum(shared) - shared
    most = below - np.repeat(below[firsts], ends - firsts) + (np.repeat(ends, ends - firsts) - np.arange(len(doc))) * shared
    keep = most >= extra(-(-size * least // of))
    yield pa.RecordBatch.from_arrays([pa.array(column[keep]) for column in (region, doc, size)], ["region", "doc_id", "n"])


def near(common: np.ndarray, a: np.ndarray, b: np.ndarray, least: int, of: int) -> np.ndarray:
    return of * common >= least * (a + b - common)


def region_links(ids: np.ndarray, sets: list[np.ndarray], least: int, of: int) -> list[tuple[int, int]]:
    """Links that connect what the region's documents connect: at most one fewer than documents."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    member = np.repeat(np.arange(n), sizes)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    member, flat = member[order], flat[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    token, ends = flat[starts], np.append(starts[1:], len(flat))
    part = np.arange(n)
    links: list[tuple[int, int]] = []
    ring = np.full(n, -1)  # the pivot each document is linked to, by place
    distance: dict[int, np.ndarray] = {}

    def measure(p: int) -> None:
        at = np.searchsorted(token, sets[p])
        spans = [member[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        common = np.bincount(np.concatenate(spans), minlength=n)
        linked = np.flatnonzero(near(common, sizes, sizes[p], least, of))
        ring[linked[ring[linked] < 0]] = p
        distance[p] = 1 - common / (sizes + sizes[p] - common)
        for other in linked:
            if part[other] != part[p]:
                links.append((int(ids[p]), int(ids[other])))
                part[part == part[other]] = part[p]

    for p in np.argsort(ids, kind="stable"):
        if ring[p] < 0:
            measure(int(p))
    reach = 2 * (1 - least / of) + 1e-9
    waiting = True
    while waiting:
        waiting = False
        for p in list(distance):
            close = np.flatnonzero(distance[p] <= reach)
            for z in close[part[close] != part[p]].tolist():
                if z not in distance and part[z] != part[p] and (ring == p).sum() > 1:
                    measure(z)
                    waiting = True
    return links


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    return rows.column("doc_id").to_numpy(), [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]


def sets_in_groups(texts: DataFrame, members: DataFrame, key: list[str], size: int, broadcast_rows: int) -> DataFrame:
    """(*key, doc_id, n, shingles) for the members (*key, doc_id): a text is cut into shingles once, then copied to its keys.

    Up to `broadcast_rows` members go to where the texts are; more of them meet the texts in a shuffle join.
    """
    own = members.groupBy(F.col("doc_id").alias("_member")).agg(F.collect_set(F.struct(*key)).alias("_keys"))
    own = written(own, "members")
    own = F.broadcast(own) if members.count() <= broadcast_rows else own
    kinds = own.schema["_keys"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [found for _, found in shingle_sets(batch.column("text"), size)]
            columns = [batch.column("doc_id"), batch.column("_keys"), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_keys", "n", "shingles"])

    joined = texts.join(own, F.col("doc_id") == F.col("_member")).select("doc_id", "text", "_keys")
    packed = joined.mapInArrow(pack, f"doc_id long, _keys {kinds}, n long, shingles binary").where("n > 0")
    return packed.select("doc_id", "n", "shingles", F.inline("_keys"))


def region_join(regions: DataFrame, texts: DataFrame, least: int, of: int, size: int, leaf_rows: int, leaf_shingles: int, broadcast_rows: int = 1 << 20) -> DataFrame:
    """Links (a, b) that connect what is connected inside the regions (region, doc_id, n)."""
    found = regions.sparkSession.createDataFrame([], "a long, b long")
    first = regions.groupBy(F.col("region").alias("_region")).agg(F.min("doc_id").alias("pivot"))
    open_ = regions.join(first, F.col("region") == F.col("_region")).drop("_region")

    def leaf(rows: pa.Table) -> pa.Table:
        links = region_links(*_unpacked(rows), least, of)
        if rows.num_rows > 1000:
            give_back()
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    def joined(members: DataFrame, key: list[str]) -> DataFrame:
        return sets_in_groups(texts, members, key, size, broadcast_rows).groupBy(*key).applyInArrow(leaf, "a long, b long")

    @F.arrow_udf("struct<common: long, linked: boolean>")
    def against(pivots: pa.Array, members: pa.Array) -> pa.Array:
        common, linked = [], []
        for p, x in zip(pivots.to_pylist(), members.to_pylist()):
            p, x = np.frombuffer(p, np.uint64), np.frombuffer(x, np.uint64)
            c = len(np.intersect1d(p, x, assume_unique=True))
            common.append(c)
            linked.append(bool(near(c, len(p), len(x), least, of)))
        return pa.StructArray.from_arrays([pa.array(common, pa.int64()), pa.array(linked)], ["common", "linked"])

    narrowed = False
    while True:
        weights = open_.groupBy("region").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("weight"))
        weights = written(weights.where("rows > 1"), "region_sizes")
        large = (F.col("rows") > leaf_rows) | (F.col("weight") > leaf_shingles)
        small = open_.join(weights.where(~large), "region").select("region", "doc_id")
        found = found.union(joined(small, ["region"]))
        if weights.where(large).isEmpty():
            return found
        oversize = open_.join(weights.where(large), "region")
        if not narrowed:
            # The documents of large regions are few; the rounds and block pairs below read their texts only.
            wanted = written(oversize.select(F.col("doc_id").alias("_wanted")).distinct(), "wanted")
            texts = written(texts.join(broadcast_if_small(wanted, broadcast_rows), F.col("doc_id") == F.col("_wanted")).drop("_wanted"), "region_texts")
            narrowed = True
        sets = written(sets_in_groups(texts, oversize.select("region", "doc_id"), ["region"], size, broadcast_rows), "region_sets")
        heads = oversize.select("region", "pivot").distinct().withColumnsRenamed({"region": "_region"})
        heads = heads.join(sets, (F.col("_region") == F.col("region")) & (F.col("pivot") == F.col("doc_id")))
        heads = heads.select("_region", "pivot", F.col("n").alias("pivot_n"), F.col("shingles").alias("pivot_shingles")).dropDuplicates(["_region"])
        measured = sets.join(heads, F.col("region") == F.col("_region")).select(
            "region", "pivot", "doc_id", "n", "pivot_n", against("pivot_shingles", "shingles").alias("m")
        )
        distance = 1 - F.col("m.common") / (F.col("n") + F.col("pivot_n") - F.col("m.common"))
        measured = written(measured.select("region", "pivot", "doc_id", "n", F.col("m.linked").alias("linked"), distance.alias("d")).distinct(), "region_distances")
        found = found.union(measured.where("linked and doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")))
        nearest = measured.where(~F.col("linked")).groupBy("region").agg(F.min("d").alias("near"), F.min("doc_id").alias("next"))
        step = 1 - least / of + 1e-9
        # Linked documents stay only inside the window: no nearer to the pivot than the closest open one by the threshold.
        rest = measured.join(nearest, "region").where(~F.col("linked") | ((F.col("d") >= F.col("near") - step) & (F.col("near") <= 2 * step)))
        rest = written(rest.where("doc_id <> pivot").select("region", F.col("next").alias("pivot"), "doc_id", "n"), "regions_left")
        now = rest.groupBy("region").agg(F.count(F.lit(1)).alias("now"), F.sum("n").alias("now_weight")).join(weights, "region")
        n_blocks = F.ceil(2 * F.greatest(F.col("now") / leaf_rows, F.col("now_weight") / leaf_shingles))
        kept = rest.join(now.withColumn("n_blocks", n_blocks), "region")
        shrunk = F.when(F.col("n_blocks") <= FEW_BLOCKS, 0.5).otherwise(0.9)
        still = ((F.col("now") > leaf_rows) & (F.col("now") > shrunk * F.col("rows"))) | (
            (F.col("now_weight") > leaf_shingles) & (F.col("now_weight") > shrunk * F.col("weight"))
        )
        found = found.union(joined(_block_pairs(kept.where(still)), ["region", "i", "j"]))
        open_ = written(kept.where(~still).select("region", "pivot", "doc_id", "n"), "regions")


def _block_pairs(rows: DataFrame) -> DataFrame:
    """Every two blocks of a region together: (region, i, j, doc_id)."""
    own = rows.select("region", "doc_id", "n_blocks", F.pmod(F.xxhash64("doc_id"), F.col("n_blocks")).alias("block"))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    return each.select("region", "doc_id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def near_duplicates(
    documents: DataFrame, least: int = LEAST, of: int = OF, size: int = SHINGLE, bucket_postings: int = 1 << 18, leaf_rows: int = 4096, leaf_shingles: int = 1 << 20,
) -> DataFrame:
    """Per document: doc_id, _text (its hash), n_shingles, class_id (smallest doc_id with an equal set), component_id."""
    named = documents.select("doc_id", "text")
    signed = written(signatures(named, size), "signatures")
    equal = signed.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("class_id"))
    classed = signed.join(equal.withColumnsRenamed({"n_shingles": "_n", "set_a": "_a", "set_b": "_b"}), (F.col("n_shingles") == F.col("_n")) & (F.col("set_a") == F.col("_a")) & (F.col("set_b") == F.col("_b")), "left")
    classed = written(classed.select("doc_id", "_text", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id")), "classes")

    classes = count_classes(shingle_counts(named))
    copies = written(classed.where("doc_id <> class_id").select(F.col("doc_id").alias("_copy"), F.col("_text").alias("_copy_text")), "copies")
    texts = named.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_text"))
    standing = texts.join(broadcast_if_small(copies), (F.col("doc_id") == F.col("_copy")) & (F.col("_text") == F.col("_copy_text")), "left_anti")
    total = classed.where("doc_id = class_id").agg(F.sum(F.col("n_shingles") * ((of - least) / of + 1 / EXTRA) + 2)).first()[0] or 0
    buckets = max(1, int(total) // bucket_postings + 1)
    packed = prefixes(standing, classes, size, least, of, buckets)

    def grouped(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from group_members(rows, least, of, buckets)
        give_back()

    def kept(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kept_members(rows, least, of)
        give_back()

    members = packed.groupBy("bucket").applyInArrow(grouped, "lane long, " + ", ".join(f"{name} binary" for name in MEMBERSHIP))
    regions = written(members.groupBy("lane").applyInArrow(kept, "region long, doc_id long, n long"), "regions")
    links = written(region_join(regions, standing.select("doc_id", "text"), least, of, size, leaf_rows, leaf_shingles), "region_links")
    parts = components(links)
    joined = classed.join(parts, classed["class_id"] == parts["node"], "left")
    return joined.select("doc_id", "_text", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
     r AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) s FROM w WHERE len(w) > 0),
     sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') g FROM r),
     n AS (SELECT doc_id, count(*) n FROM sh GROUP BY doc_id),
     pairs AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
     links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
     reach AS (SELECT doc_id a, doc_id b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query(ORACLE)
def op7_jaccard_join(spark, folder):
    return near_duplicates(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")
