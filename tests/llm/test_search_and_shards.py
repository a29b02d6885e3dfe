import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from latentspark.llm import sharding, topk_search


def brute(rows, k):
    """Sorted (query_id, rank, vec_id, score) by comparing each row with each other row."""
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, x) in enumerate(whole):
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), c) for other, (c, y) in enumerate(whole) if other != at)[:k]
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(best)]
    return sorted(out)


def searched(df, k=10):
    return sorted(map(tuple, topk_search.top_k(topk_search.quantised(df), F.col("vec_id") % 100 == 0, k).collect()))


@pytest.mark.parametrize("block,queries,ranges,group", [(8192, 512, 4096, 16), (40, 2, 3, 2)])
def test_exact_top_k(spark, monkeypatch, block, queries, ranges, group):
    for name, value in (("BLOCK", block), ("QUERIES", queries), ("RANGES", ranges), ("GROUP", group)):
        monkeypatch.setattr(topk_search, name, value)
    rng = np.random.default_rng(0)
    rows = [(int(i), rng.normal(size=8).tolist()) for i in range(400)]
    rows += [(int(i), rows[7][1]) for i in range(400, 520)]  # ties
    rows += [(600, None), (601, [float("nan")] * 8), (602, [None] * 8), (603, [float("inf")] * 8), (700, [0.0] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS v", "1 AS score", "2 AS uid")
    assert searched(df) == brute(rows, 10)


@pytest.mark.parametrize("block", [8192, 5])
def test_rows_of_one_id_are_candidates_each(spark, monkeypatch, block):
    monkeypatch.setattr(topk_search, "BLOCK", block)
    rows = [(0, [1.0, 0.5])] + [(5, [9.0, float(i % 4)]) for i in range(12)] + [(i, [8.0 - i / 8, 1.0]) for i in range(10, 38)] + [(100, [1.0, 1.0])] * 3
    got = searched(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert got == brute(rows, 10) and [r[2] for r in got if r[0] == 0] == [5] * 10 and len(got) == 40


def test_large_components_are_exact(spark):
    rows = [(0, [1e6, 1.0, -2.0]), (1, [3.0, 1e6, 0.5]), (2, [5e5, 2.0, 1e6]), (3, [-1e6, 7.0, 1.0]), (4, [20000.0, 1.0, 0.0]), (5, [30000.0, 1.0, 0.0]), (100, [4e6, 0.25, 3.0])]  # 100 by itself is beyond 64 bits, and no score
    assert searched(spark.createDataFrame(rows, "vec_id long, embedding array<float>")) == brute(rows, 10)
    for big in ([(0, [4e6]), (1, [4e6])], [(0, [1e30]), (1, [1.0])]):
        with pytest.raises(Exception, match="(?i)too large|beyond 64 bits"):
            searched(spark.createDataFrame(big, "vec_id long, embedding array<float>"))


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [])], "vec_id long, embedding array<float>")
    assert searched(df) == [(0, 1, 1, 1024 * 1024), (0, 2, 1, 1024 * 1024), (0, 3, 2, 0)]
    assert searched(df.limit(0)) == [] and searched(df.filter("vec_id = 0")) == []


def test_blocks_and_bounds_save_work(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8))
    rows = [(i, (centres[rng.integers(0, 20)] + rng.normal(size=8) / 50).tolist()) for i in range(4000)]
    met = []
    own = topk_search._reachable
    monkeypatch.setattr(topk_search, "BLOCK", 10)
    monkeypatch.setattr(topk_search, "QUERIES", 1)
    monkeypatch.setattr(topk_search, "_reachable", lambda asked, cand, longest: met.append((asked.select("qb").distinct().count() * cand.select("cb").distinct().count(), own(asked, cand, longest).count())) or own(asked, cand, longest))
    assert searched(spark.createDataFrame(rows, "vec_id long, embedding array<float>")) == brute(rows, 10)
    assert met[0][1] < 0.9 * met[0][0]
    c = np.array([[math.floor(1024 * x) for x in v] for _, v in rows], float)
    longest = float((c * c).sum(1).max())
    pivots = topk_search.chosen_pivots(c[:500], longest, 24)
    far, mine = topk_search.distances(c, pivots, longest, False), topk_search.distances(c[:5], pivots, longest, True)
    ids = np.arange(4000)
    assert sum(topk_search.search_block(c[i], mine[i], i, -np.inf, c, far, ids, ids, longest, 10)[3] for i in range(5)) < 5 * 4000 / 2


def test_shards(spark):
    texts = ["same"] * 30 + ["pair"] * 2 + ["trio"] * 3 + [None, "", "é"] + [f"doc {i}" for i in range(162)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, shard int").repartition(5)
    got = sharding.shard_documents(docs, shards=8).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(200))
    slots = defaultdict(list)
    for r in got:
        t = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 8, zlib.crc32(t), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert sorted(len(s) for s in slots.values()) == [25] * 8 and all(sorted(s) == list(range(25)) for s in slots.values())
    at = defaultdict(Counter)
    for r in got:
        at[texts[r["doc_id"]]][r["shard"]] += 1
    assert len(at["pair"]) == 1 and len(at["trio"]) == 1
    assert len(at["same"]) == 2 and max(at["same"].values()) >= 20  # 30 don't fit one shard of 25


def test_pairs_meet_where_no_shard_has_room(spark):
    """Every text occurs twice and shards are full: without swaps next to nothing could move. The optimum keeps all pairs."""
    docs = spark.createDataFrame([(i, f"text {i // 2}") for i in range(800)], "doc_id long, text string")
    got = sharding.shard_documents(docs, shards=8).collect()
    at = defaultdict(set)
    for r in got:
        at[r["doc_id"] // 2].add(r["shard"])
    assert sorted(Counter(r["shard"] for r in got).values()) == [100] * 8
    assert sum(len(s) == 1 for s in at.values()) > 0.85 * 400


def test_quotas_keep_capacity():
    rng = np.random.default_rng(0)
    for _ in range(200):
        asked = [(s, kind, int(rng.integers(1, 20)), kind + int(rng.integers(0, 3))) for s in range(5) for kind in range(1, 9) if rng.random() < 0.5]
        room = {s: int(rng.integers(0, 60)) for s in range(5)}
        got = sharding.quotas(asked, room)
        assert all(0 <= got[s, kind] <= n for s, kind, n, _ in asked)
        for s in range(5):
            mine = [(kind, n, largest) for t, kind, n, largest in asked if t == s]
            used = sum(got[s, kind] * largest for kind, _, largest in mine)
            assert used <= room[s]
            # What is refused would not have fitted.
            assert all(got[s, kind] == n or largest > room[s] - sum(got[s, k] * m for k, _, m in mine if k >= kind) for kind, n, largest in mine)


def kept_links(spark, sizes, shards):
    """Share of linked pairs in one shard, and of groups that are whole."""
    texts = [f"group {g}" for g, n in enumerate(sizes) for _ in range(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    at, counts = defaultdict(Counter), Counter()
    for r in sharding.shard_documents(docs, shards=shards).collect():
        at[texts[r["doc_id"]]][r["shard"]] += 1
        counts[r["shard"]] += 1
    assert sorted(counts.values()) == sorted(len(texts) // shards + (s < len(texts) % shards) for s in range(shards))
    pairs = lambda n: n * (n - 1) // 2
    return sum(pairs(n) for c in at.values() for n in c.values()) / max(1, sum(map(pairs, sizes))), sum(len(c) == 1 for c in at.values()) / len(sizes)


@pytest.mark.parametrize("sizes", [[40] * 120, [4] * 1200])
def test_groups_that_fit_exactly_stay_whole(spark, sizes):
    links, whole = kept_links(spark, sizes, 24)
    assert links >= 0.99 and whole >= 0.99


def test_mixed_groups_stay_together(spark):
    rng = np.random.default_rng(5)
    sizes = [900, 150, 149, *rng.integers(60, 120, 8).tolist(), *rng.integers(2, 12, 200).tolist(), *[1] * 300]  # the first is larger than three shards
    links, whole = kept_links(spark, sizes, 12)
    best = (sum(n * (n - 1) for n in sizes[1:]) + sum(p * (p - 1) for p in [sum(sizes) // 12] * (900 // (sum(sizes) // 12)) + [900 % (sum(sizes) // 12)])) / sum(n * (n - 1) for n in sizes)
    assert links >= 0.97 * best and whole >= 0.98


def test_small_tables_against_the_best_placement(spark):
    """All placements of 8 rows over 2 shards of 4, by brute force: propagation, a heuristic, keeps half of the links that can be kept, or more."""
    for seed in range(3):
        texts = np.random.default_rng(seed).integers(0, 3, 8).tolist()
        kept = lambda place: sum(texts[i] == texts[j] and place[i] == place[j] for i, j in itertools.combinations(range(8), 2))
        best = max(kept([int(i in c) for i in range(8)]) for c in itertools.combinations(range(8), 4))
        docs = spark.createDataFrame([(i, f"t{t}") for i, t in enumerate(texts)], "doc_id long, text string")
        got = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, shards=2).collect()}
        assert sorted(Counter(got.values()).values()) == [4, 4] and kept(got) >= best / 2


def test_shards_of_repeated_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a")] * 7 + [(None, "b")] * 2, "doc_id long, text string")
    got = sharding.shard_documents(docs, shards=4).collect()
    assert len(got) == 9 and sorted(Counter(r["shard"] for r in got).values()) == [2, 2, 2, 3]
    assert sharding.shard_documents(docs.limit(0), shards=4).count() == 0


def test_tables_that_grow_with_the_groups_are_not_broadcast(spark):
    """Spark takes the copies of a group's row for one, so far more than its threshold would reach the driver."""
    members = spark.range(400).select(F.col("id").alias("uid"), F.concat(F.lit("g"), F.col("id") % 50).alias("group"))
    joined = sharding._salted_votes(members, members.groupBy("group").agg(F.max("uid").alias("n")), ["group"])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(joined) and "SortMergeJoin" in plan(joined)
    assert sorted((r["uid"], r["group"], r["n"]) for r in joined.collect()) == [(i, f"g{i % 50}", 350 + i % 50) for i in range(400)]
    docs = spark.createDataFrame([(i, f"text {i // 2}") for i in range(40)], "doc_id long, text string")
    whole = plan(sharding.shard_documents(docs, shards=4))
    assert not [line for line in whole.splitlines() if "BroadcastHashJoin" in line and "LeftAnti" in line] and "LeftAnti" in whole
