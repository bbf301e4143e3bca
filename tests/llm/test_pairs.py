"""Joins, searches and duplicates against brute force."""
from __future__ import annotations

import random
import re

import numpy as np
import pytest

from hirelens.llm import decontamination, graph, jaccard, linededup, neighbours, substrings, urls


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts: dict) -> dict:
    sets = {d: shingle_set(t) for d, t in texts.items()}
    part = {d: d for d in texts}
    for a in texts:
        for b in texts:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                old, new = max(part[a], part[b]), min(part[a], part[b])
                part = {d: new if p == old else p for d, p in part.items()}
    return part


def edited(text: str, seed: int, edits: int) -> str:
    rng, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def families():
    """Exact copies, chains of edits, a large group of near copies, a line in every document, short and empty texts."""
    rng = random.Random(11)
    make = lambda n: " ".join(f"w{rng.randrange(800)}" for _ in range(n))
    texts, line = {}, "this very common line of eight words stands everywhere"
    base = [make(60 + 10 * k) for k in range(12)]
    for k, text in enumerate(base):
        chain = text
        for step in range(5):
            texts[len(texts)] = chain
            chain = edited(chain, 100 * k + step, 1 + k % 4)
    big = make(120)
    for k in range(70):
        texts[len(texts)] = edited(big, 5000 + k, k % 5)
    for k in range(30):
        texts[len(texts)] = f"{make(12)}\n{line}"
    for k in range(20):
        texts[len(texts)] = f"{line}\n{line} w{k // 2} end"
    for text in ("", None, "a b", "A  b", "a b c d e", "one", base[0].upper(), base[0]):
        texts[len(texts)] = text
    return {(d * 37) % 1009: t for d, t in texts.items()}


@pytest.mark.parametrize("leaf_rows, leaf_shingles", [(4096, 1 << 22), (12, 1 << 22), (4096, 2000)])
def test_jaccard_join_gives_the_components_of_all_pairs(families, documents, leaf_rows, leaf_shingles):
    rows = jaccard.near_duplicates(documents(families), bucket_postings=500, leaf_rows=leaf_rows, leaf_shingles=leaf_shingles).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute_components(families)
    assert all(r["n_shingles"] == len(shingle_set(families[r["doc_id"]])) for r in rows)


def test_region_links_connect_what_pairs_connect():
    rng = np.random.default_rng(5)
    for trial in range(60):
        pool = rng.integers(0, 2**62, 60, dtype=np.int64).astype(np.uint64)
        sets = [np.unique(rng.choice(pool, rng.integers(8, 16))) for _ in range(14)]
        sets += [np.unique(np.concatenate([s[1:], pool[:1]])) for s in sets[:7]]
        ids = rng.permutation(1000)[: len(sets)]
        texts = {int(i): s for i, s in zip(ids, sets)}
        part = {i: i for i in texts}
        for a in texts:
            for b in texts:
                both = len(np.intersect1d(texts[a], texts[b]))
                if a < b and 100 * both >= 60 * (len(texts[a]) + len(texts[b]) - both):
                    old, new = max(part[a], part[b]), min(part[a], part[b])
                    part = {d: new if p == old else p for d, p in part.items()}
        got = {i: i for i in texts}
        links = jaccard.region_links(ids, sets, 60, 100)
        assert len(links) < len(ids)
        for a, b in links:
            old, new = max(got[a], got[b]), min(got[a], got[b])
            got = {d: new if p == old else p for d, p in got.items()}
        assert got == part


def test_components_of_paths_stars_and_loops(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(500, i) for i in range(501, 560)] + [(3, 530)]
    links = [*path, *star, (7, 7), (9, 8), (8, 9)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 3 for i in [3, 500, *range(501, 560)]}, 8: 8, 9: 8}


def test_jaccard_join_of_odd_and_empty_tables(odd_documents, no_documents):
    rows = jaccard.near_duplicates(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    found = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in rows}
    assert found[6, 10] == 5 and found[5, 10] == 5 and found[1, 0] == 1 and found[2, 0] == 2 and found[None, 10] is None
    assert jaccard.near_duplicates(no_documents).collect() == []


@pytest.mark.parametrize("leaf_rows", [1 << 15, 6])
def test_repeated_passages_are_found_and_others_are_not(documents, prose, leaf_rows):
    passage, near, short = prose(1, 60), prose(2, 120), prose(3, 40)
    texts = {i: f"{prose(100 + i, 90)} {passage} {prose(200 + i, 30)}" for i in range(12)}
    texts |= {20 + i: f"{prose(300 + i, 50)} {edited(near, i, 1)} {prose(400 + i, 70)}" for i in range(4)}
    texts |= {30 + i: f"{prose(500 + i, 80)} {short} {prose(600 + i, 80)}" for i in range(15)}
    texts |= {50: prose(7, 200), 51: prose(7, 200), 52: prose(8, 20), 53: prose(8, 20), 54: None, 55: ""}
    rows = substrings.near_passages(documents(texts), leaf_rows=leaf_rows, bucket_windows=200).collect()
    holders = {r["doc_id"] for r in rows} | {r["other_id"] for r in rows}
    assert holders == {*range(12), *range(20, 24), 50, 51}
    links = [(r["doc_id"], r["other_id"]) for r in rows]
    assert all(a > b for a, b in links)
    assert {a for a, b in links if a < 12} == set(range(1, 12))
    for r in rows:
        if r["doc_id"] < 12:
            assert texts[r["doc_id"]].split()[r["begin"] : r["end"]] == texts[r["other_id"]].split()[r["other_begin"] : r["other_end"]]
            assert set(passage.split()) <= set(texts[r["doc_id"]].split()[r["begin"] : r["end"]])
        assert r["similarity"] >= 0.75 and r["end"] - r["begin"] >= 50


def test_compact_windows_are_the_windows_of_all_passages():
    rng = np.random.default_rng(2)
    for width in (1, 3, 5):
        offsets = np.array([0, 0, 7, 8, 30])
        priority = rng.permutation(np.arange(1, 31)).astype(np.uint64)
        got = {(int(c), int(b), int(e)) for c, b, e, _ in zip(*substrings.compact_windows(priority, offsets, width))}
        want = set()
        for low, high in zip(offsets[:-1], offsets[1:]):
            for i in range(low, high):
                for j in range(i + width, high + 1):
                    c = i + int(priority[i:j].argmin())
                    b = max([p + 1 for p in range(low, c) if priority[p] < priority[c]], default=low)
                    e = min([p for p in range(c, high) if priority[p] < priority[c]], default=high)
                    want.add((c, int(b), int(e)))
        assert got == want


def test_passages_of_odd_and_empty_tables(odd_documents, no_documents):
    assert substrings.near_passages(odd_documents).collect() == []
    rows = substrings.near_passages(odd_documents, min_words=10).collect()
    assert [(r["doc_id"], r["other_id"], r["begin"], r["end"]) for r in rows] == [(6, 5, 0, 14)]
    assert substrings.near_passages(no_documents).collect() == []


@pytest.mark.parametrize("copies, hot_count, leaf_rows", [(2, 64, 1 << 15), (12, 64, 1 << 15), (60, 8, 1 << 15), (60, 8, 300)])
def test_passages_with_an_edit_of_their_own_in_the_middle_are_linked(documents, prose, copies, hot_count, leaf_rows):
    passage = prose(1, 60).split()
    texts = {i: " ".join([prose(100 + i, 70), *passage[:30], f"name{i}", *passage[31:], prose(900 + i, 70)]) for i in range(copies)}
    texts |= {1000 + i: f"{prose(2000 + i, 60)} {prose(2, 18)} {prose(3000 + i, 60)}" for i in range(copies)}
    rows = substrings.near_passages(documents(texts), hot_count=hot_count, leaf_rows=leaf_rows, bucket_windows=500).collect()
    part = {i: i for i in texts}
    for r in rows:
        old, new = part[r["doc_id"]], part[r["other_id"]]
        part = {d: new if p == old else p for d, p in part.items()}
    assert len({part[i] for i in range(copies)}) == 1
    assert not any(r["doc_id"] >= 1000 for r in rows)


@pytest.mark.parametrize("times", [3, 50])
def test_every_copy_of_a_passage_repeated_in_one_document_is_found(documents, prose, times):
    passage = prose(1, 55)
    texts = {1: f"{prose(2, 60)} {passage} {prose(3, 60)}", 2: " ".join(f"{passage} {prose(10 + i, 3)}" for i in range(times))}
    covered = set()
    for r in substrings.near_passages(documents(texts)).collect():
        assert (r["doc_id"], r["other_id"]) == (2, 1)
        covered |= set(range(r["begin"], r["end"]))
    assert covered >= {58 * k + i for k in range(times) for i in range(55)}


def test_hot_centres_are_told_apart_without_losing_windows_that_agree_in_half_of_the_grid():
    rng = np.random.default_rng(8)
    for width in (2, 6, 46):
        for _ in range(200):
            a = rng.integers(1, 1 << 50, 3 * width).astype(np.uint64)
            b = a.copy()
            centre = np.array([int(rng.integers(width, 2 * width))])
            begin = int(rng.integers(centre[0] - width + 1, centre[0] + 1))
            outside = np.ones(len(b), bool)
            outside[begin : begin + width] = False
            b[outside] = rng.integers(1, 1 << 50, outside.sum()).astype(np.uint64)
            keys = []
            for text, (low, high) in ((a, (begin, 3 * width)), (b, (0, begin + width))):
                _, places = substrings.hot_keys(centre, np.array([low]), np.array([high]), text, width)
                keys.append({(int(p), int(text[p])) for p in places})
            assert keys[0] & keys[1]


def lcs_is_common(a, b, pairs):
    return all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_patience_alignment_is_common_increasing_and_holds_unique_lines():
    rng = random.Random(4)
    for _ in range(400):
        a = [rng.randrange(12) for _ in range(rng.randrange(14))]
        b = [rng.randrange(12) for _ in range(rng.randrange(14))]
        pairs = linededup.patience(a, b)
        assert lcs_is_common(a, b, pairs)
        assert linededup.patience(a, a) == [(i, i) for i in range(len(a))]
    assert linededup.patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]


def test_aligned_lines_go_from_the_later_document_only(documents):
    block = [f"shared line number {i}" for i in range(6)]
    texts = {
        1: "\n".join(["own a", *block, "own b"]),
        2: "\n".join(["first", *block[:3], "middle", *block[3:], "last"]),
        3: "\n".join(reversed(block)),
        4: "nothing shared\nat all\n",
        **{10 + i: f"document {i}\nboilerplate" for i in range(30)},
        **{50 + i: "copy\nof copy" for i in range(30)},
        90: None, 91: "", 92: "\n\n",
    }
    rows = {r["doc_id"]: r for r in linededup.dedup_lines(documents(texts)).collect()}
    assert rows.keys() == texts.keys()
    assert rows[1]["text"] == texts[1] and rows[4]["text"] == texts[4]
    assert rows[2]["text"] == "first\nmiddle\nlast" and rows[2]["removed"] == [1, 2, 3, 5, 6, 7] and rows[2]["n_partners"] == 1
    assert rows[3]["n_removed"] == 1  # a turned block shares no two lines in order
    assert rows[10]["text"] == texts[10] and all(rows[10 + i]["text"] == f"document {i}" for i in range(1, 30))
    assert rows[50]["text"] == texts[50] and all(rows[50 + i]["text"] == "" for i in range(1, 30))
    assert rows[90]["text"] is None and rows[91]["text"] == "" and rows[92]["text"] == "\n\n"
    before = {line for t in texts.values() for line in (t or "").split("\n")}
    after = {line for r in rows.values() for line in (r["text"] or "").split("\n")}
    assert after == before


def test_frequent_blocks_go_from_documents_that_share_rarer_lines_too(documents):
    block = [f"boilerplate {i}" for i in range(5)]
    texts = {i: "\n".join([f"document {i}", *block]) for i in range(40)}
    texts |= {100 + i: "\n".join([f"page {i}", "footer", f"end {i}"]) for i in range(30)}
    texts |= {200: "one\nseldom seen\ntwo", 201: "\n".join(["seldom seen", "own", *block, "more", "footer"])}
    rows = {r["doc_id"]: r for r in linededup.dedup_lines(documents(texts)).collect()}
    assert rows[201]["text"] == "own\nmore" and rows[201]["n_partners"] == 3
    assert all(rows[i]["text"] == f"document {i}" for i in range(1, 40))


def test_line_dedup_of_odd_and_empty_tables(odd_documents, no_documents):
    out = linededup.dedup_lines(odd_documents)
    assert set(odd_documents.columns) <= set(out.columns)
    rows = out.collect()
    assert len(rows) == odd_documents.count()
    assert [r["text"] for r in rows if r["doc_id"] == 6] == [""]
    assert all(r["n_removed"] == 0 for r in rows if r["doc_id"] != 6)
    assert linededup.dedup_lines(no_documents).collect() == []


def brute_hits(texts: dict, items: dict):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows: dict = {}
    for item, text in items.items():
        words = split(text)
        n = min(13, len(words))
        for i in range(len(words) - n + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add(str(item))
    out = {}
    for doc, text in texts.items():
        words, hit, ids = split(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                found = windows.get(tuple(words[i : i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    ids |= found
        out[doc] = (len(words), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(words))
    return out


@pytest.mark.parametrize("broadcast_windows", [200_000, 0])
def test_decontamination_finds_exactly_the_words_in_windows(spark, documents, prose, broadcast_windows):
    items = {1: prose(1, 30, 60), 2: prose(2, 13, 60), 11: "Short Item", 12: prose(3, 5, 60), 13: "One", 14: "", 15: None, 3: prose(1, 30, 60)}
    texts = {i: prose(50 + i, 60, 60) for i in range(25)}
    texts |= {30: prose(9, 20, 60) + " ... " + items[1].upper() + "!", 31: " ".join(items[1].split()[4:17]), 32: " ".join(items[1].split()[4:16]), 33: "short, ITEM short item", 34: "one", 35: "", 36: None}
    texts |= {37: " ".join(prose(9, 400, 60).split() + items[2].split()), 38: items[2] + " " + items[2] + " " + items[2][3:], 39: "Ớne K short Ítem shortKitem"}
    bench = spark.createDataFrame([*items.items(), (None, prose(50, 60, 60))], "item_id long, text string")
    rows = decontamination.contamination(documents(texts), bench, broadcast_windows=broadcast_windows).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in rows}
    assert got == brute_hits(texts, items)
    for r in rows:
        assert sum(s["end"] - s["begin"] for s in r["spans"]) == r["n_hit"]


def test_decontamination_of_odd_and_empty_tables(spark, odd_documents, no_documents):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten second line of", "x"), (None, "x", "x"), (2, None, "x")], "item_id long, text string, n_words string")
    rows = decontamination.contamination(odd_documents, bench).collect()
    assert len(rows) == odd_documents.count()
    assert sorted((r["n_hit"], r["contaminated"]) for r in rows if r["n_hit"]) == [(13, True)] * 4
    assert all(r["n_hit"] == 0 for r in decontamination.contamination(odd_documents, bench.where("false")).collect())
    assert decontamination.contamination(no_documents, bench).collect() == []
    assert "Python" not in decontamination.contamination(odd_documents, bench)._jdf.queryExecution().toString()


def brute_nearest(vectors: dict, queries, k):
    out = {}
    for q in queries:
        scored = sorted((-(vectors[q] * v).sum(), i) for i, v in vectors.items() if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_neighbours_reach_the_recall_and_give_exact_scores(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((20, 24)) * 2
    vectors = {i: centres[i % 20] + rng.standard_normal(24) * (0.5 + i % 3) for i in range(1500)}
    vectors[3] = vectors[4] = vectors[60]
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in vectors.items()], "vec_id long, embedding array<double>, label int")
    queries = [i for i in vectors if i % 20 == 0]
    rows = neighbours.nearest(frame, frame.where("vec_id % 20 = 0"), shard_rows=400, query_rows=30).collect()
    want, hits = brute_nearest(vectors, queries, 20), 0
    for q in queries:
        own = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and all(r["vec_id"] != q for r in own)
        assert all(r["score"] == (vectors[q] * vectors[r["vec_id"]]).sum() for r in own)
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        hits += len({r["vec_id"] for r in own} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 20 * len(queries)


def test_neighbours_of_odd_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0]), (9, [0.5, 0.5]), (9, [0.5, 0.5]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows], "vec_id long, embedding array<float>, score double, shard int")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(frame, frame.where("vec_id % 20 = 0")).collect()]
    assert sorted(got) == [(0, 1, 1, 0.5), (0, 2, 9, 0.5), (0, 3, 9, 0.5)]
    assert neighbours.nearest(frame.where("false"), frame).collect() == []
    assert neighbours.nearest(frame, frame.where("false")).collect() == []


def brute_verdict(url, rules):
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
    fits = [(len(h + p), v, h + p) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, "allow", None))
    return host, path, best[2], best[1]


@pytest.mark.parametrize("most_blocks", [1, 1 << 15])
def test_url_verdicts_match_trying_every_rule(spark, most_blocks):
    rng = random.Random(6)
    hosts = ["a.org", "example.org", "WWW.Example.org", "notexample.org", "x.com", "org", "com", "b.net", "", "é.org", "..org"]
    paths = ["/", "/es/", "/es", "/en/1", "/en/12", "/fr/x", "/de/?q=/fr/", "", "#/de/", "/de/://x.org/es/"]
    urls_ = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)] + [None, "", "no scheme/", "http:/x.com/de/"]
    rules = [*urls.RULES, ("EXAMPLE.org", "/es/", "allow"), (None, "/", "block"), ("net", None, "block")]
    rules += [(f"h{i}.test", f"/p{i}", "block") for i in range(500)]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls_)], "page_id long, url string, host string, rule string")
    entries = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages, entries, most_blocks=most_blocks).collect()}
    sound = [(h.lower(), p, v) for h, p, v in rules if h and p]
    assert got == {i: brute_verdict(u, sound) for i, u in enumerate(urls_)}
    assert all(r["verdict"] == "allow" and r["rule"] is None for r in urls.judge_urls(pages, entries.where("false")).collect())
    assert urls.judge_urls(pages.where("false"), entries).collect() == []


def test_the_filter_holds_all_entries_and_few_others(spark):
    from pyspark.sql import functions as F

    entries = spark.range(2000).select(F.concat(F.lit("host"), F.col("id"), F.lit("/")).alias("key"))
    blocks = urls.bloom_blocks(entries, 1 << 15)
    hashes = lambda frame: frame.select(F.xxhash64(F.lit(1), "key").alias("k"), F.pmod(F.xxhash64("key"), F.lit(len(blocks))).alias("b")).toPandas()
    own, other = hashes(entries), hashes(entries.withColumn("key", F.concat("key", F.lit("x"))))
    assert urls.may_hold(blocks, own["k"].to_numpy(), own["b"].to_numpy()).all()
    assert urls.may_hold(blocks, other["k"].to_numpy(), other["b"].to_numpy()).mean() < 0.02




def test_every_shared_run_of_fifty_words_is_in_a_passage(documents, prose):
    rng = random.Random(11)
    texts = {i: prose(3000 + i, rng.choice([0, 20, 70, 200]), 100_000).split() for i in range(40)}
    for k in range(9):
        passage = prose(4000 + k, rng.choice([50, 51, 64, 130]), 100_000).split()
        for i in rng.sample(range(40), (2, 3, 20)[k % 3]):
            at = rng.choice([0, len(texts[i])])
            # Words of its own part the passages of a document, so that no two make a longer one.
            texts[i] = texts[i][:at] + [f"x{i}"] + passage + [f"y{i}"] + texts[i][at:]
    rows = substrings.near_passages(documents({i: " ".join(w) for i, w in texts.items()}), bucket_windows=300).collect()
    spans: dict[int, list] = {i: [] for i in texts}
    for r in rows:
        spans[r["doc_id"]].append((r["begin"], r["end"]))
        spans[r["other_id"]].append((r["other_begin"], r["other_end"]))
        assert r["similarity"] >= 0.75 and r["other_id"] < r["doc_id"]
    held: dict[tuple, set] = {}
    for i, w in texts.items():
        for at in range(len(w) - 49):
            held.setdefault(tuple(w[at : at + 50]), set()).add(i)
    for i, w in texts.items():
        for at in range(len(w) - 49):
            if len(held[tuple(w[at : at + 50])]) > 1:
                assert any(b <= at and at + 50 <= e for b, e in spans[i])


def test_many_holders_of_a_short_line_cost_little(documents, prose):
    texts = {i: f"{prose(5000 + i, 60)} {prose(1, 40)} {prose(90_000 + i, 60)}" for i in range(600)}
    texts |= {1000 + i: f"{prose(8000 + i, 40)} {prose(1, 40)} {prose(2, 40)} {prose(9000 + i, 40)}" for i in range(30)}
    rows = substrings.near_passages(documents(texts)).collect()
    assert {r["doc_id"] for r in rows} == set(range(1001, 1030)) and {r["other_id"] for r in rows} == {1000}


@pytest.mark.parametrize("holders", [4, 100, 400])
def test_recall_of_passages_with_edits_of_their_own(documents, prose, holders):
    """Substitutions, an insertion or a deletion in each copy; a copy counts as found if any row links it."""
    rng = random.Random(holders)
    texts = {}
    for i in range(holders):
        words = prose(1, 90).split()
        for at in rng.sample(range(15, 75), 1):
            words[at : at + 1] = rng.choice([[f"n{i}"], [words[at], f"n{i}"], []])
        texts[i] = " ".join([prose(10_000 + i, 60), *words, prose(20_000 + i, 60)])
    rows = substrings.near_passages(documents(texts)).collect()
    part = {i: i for i in texts}
    for r in rows:
        old, new = part[r["doc_id"]], part[r["other_id"]]
        if old != new:
            part = {d: new if p == old else p for d, p in part.items()}
    largest = max(list(part.values()).count(p) for p in set(part.values()))
    assert largest >= 0.9 * holders


def test_deleted_lines_are_those_that_plain_loops_delete(documents, prose):
    rng = random.Random(6)
    lines = [prose(k, 6) for k in range(25)] + [""]
    texts = {i: "\n".join(rng.choice(lines) if rng.random() < 0.6 else prose(1000 * i + k, 5) for k in range(rng.randrange(1, 14))) for i in range(40)}
    frame = documents(texts)
    hashed = {r["doc_id"]: r["h"] for r in frame.select("doc_id", linededup.line_hashes(frame["text"]).alias("h")).collect()}
    owner: dict[int, int] = {}
    for i in sorted(hashed):
        for line in hashed[i]:
            owner.setdefault(line, i)
    want = {}
    for i, own in hashed.items():
        gone: set[int] = set()
        for first in {owner[line] for line in own if line != linededup.BLANK} - {i}:
            gone |= set(linededup.common_blocks(hashed[first], own, {linededup.BLANK}))
        want[i] = "\n".join(line for k, line in enumerate(texts[i].split("\n")) if k not in gone)
    assert {r["doc_id"]: r["text"] for r in linededup.dedup_lines(frame).collect()} == want
