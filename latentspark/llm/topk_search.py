"""Exact top-k by inner product with a pivot table.

All vectors are lifted by one coordinate to a common length, so that a larger inner product is a smaller
distance. The table of distances to the pivots is computed once and stored; the largest of the differences of
two rows of it bounds a distance from below, so a score from above. Candidates are dealt to blocks by their nearest pivot.
A first bounded block gives each query a k-th score; then a block goes only to queries that its
ranges of distances let reach that score, there the bounds order its candidates, and evaluation stops where none can reach
the k-th score any more. Scores are integers; bounds have a margin above their rounding errors.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from latentspark.llm.common import stored

#: Rows of a block of candidates and of queries (about); candidate blocks and query blocks whose bounds a task compares at a time.
BLOCK, QUERIES, RANGES, GROUP = 8192, 1024, 4096, 8
#: So many pairs of blocks are searched at once, without a first block.
PAIRS = 4
#: Pivots, and the rows that they are chosen from.
PIVOTS, POOL = 24, 512
_FLOATS = np.dtype("<f8")


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id, v (array of long: floor(scale * x), x as double), for vectors that are neither null nor hold a null or
    non-finite component; an empty vector is all zeros. A component whose floor does not fit 64 bits is an error."""
    x = F.col(embedding)
    whole = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = lambda c: c.cast("double") * scale
    held = lambda c: F.when(F.abs(scaled(c)) < float(1 << 63), F.floor(scaled(c)).cast("long")).otherwise(F.raise_error(F.lit("component beyond 64 bits")).cast("long"))
    return vectors.filter(F.col(vec_id).isNotNull() & whole).select(F.col(vec_id).alias("vec_id"), F.transform(x, held).alias("v"))


def _matrix(rows, dim: int) -> np.ndarray:
    """Vectors as float64 rows; shorter ones end in zeros. Sums of their products stay exact, see `_exact`."""
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: in floating point where every sum stays below 2**53, in 64 bits where none can pass them, else
    in whole numbers of any size; a product beyond 64 bits is an error."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2**52:
        return np.rint(a @ b.T).astype(np.int64)
    if most >= 2**62:
        whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
        return (whole(a) @ whole(b).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def chosen_pivots(pool: np.ndarray, longest: float, n: int) -> np.ndarray:
    """n lifted rows of the pool, each the farthest from those before it."""
    lifted = np.column_stack([pool, np.sqrt(np.maximum(longest - (pool * pool).sum(1), 0))])
    far, out = np.full(len(pool), np.inf), []
    for _ in range(min(n, len(pool))):
        out.append(int(far.argmax()))
        far = np.minimum(far, ((lifted - lifted[out[-1]]) ** 2).sum(1))
    return lifted[out]


def distances(x: np.ndarray, pivots: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Rows of the pivot table: from lifted vectors to the pivots; a query's last coordinate is 0."""
    norm = (x * x).sum(1)
    rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest - norm, 0))
    lift = np.column_stack([x, rest])
    square = (lift * lift).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * lift @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def highest(low: np.ndarray, norm: float, longest: float) -> np.ndarray:
    """The highest scores that distances of at least `low` allow, above all rounding."""
    return (norm + longest - low * low) / 2 + 1e-6 * (norm + longest) + 1


def search_block(query: np.ndarray, far_q: np.ndarray, own: int, least: float, c: np.ndarray, far_c: np.ndarray, uid: np.ndarray, vec_id: np.ndarray, longest: float, k: int) -> tuple:
    """The k best candidates of a block for one query, of those with scores of at least `least` and another uid than `own`:
    uids, ids, scores, and how many were evaluated."""
    low = np.abs(far_c - far_q[None, :]).max(1, initial=0)
    high = highest(low, float((query * query).sum()), longest)
    order = np.flatnonzero(high >= least)
    order = order[np.argsort(-high[order])]
    best, scores, at, step, evaluated = np.empty(0, np.int64), np.empty(0, np.int64), 0, 256, 0
    while at < len(order):
        if len(scores) == k and high[order[at]] < scores[-1]:
            break  # no later bound reaches the k-th score
        part = order[at : at + step]
        evaluated += len(part)
        part = part[uid[part] != own]
        found = _dots(c[part], query[None, :])[:, 0]
        part, found = part[found >= least], found[found >= least]
        best, scores = np.concatenate([best, part]), np.concatenate([scores, found])
        first = np.lexsort((uid[best], vec_id[best], -scores))[:k]
        best, scores, at, step = best[first], scores[first], at + step, step * 2
    return uid[best], vec_id[best], scores, evaluated


_TABLE = "uid long, vec_id long, query boolean, near int, v array<long>, far binary, far_query binary"
_FOUND = "query_uid long, query_id long, uid long, vec_id long, score long"


def _stack(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), _FLOATS).reshape(len(column), -1)


def pivot_table(vectors: DataFrame, pivots: np.ndarray, longest: float) -> DataFrame:
    """vectors (uid, vec_id, query, v) with their distances to the pivots (of queries also unlifted) and the nearest one."""
    dim = pivots.shape[1] - 1

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _matrix(batch.v.to_list(), dim)
            far = distances(x, pivots, longest, False)
            asked = batch["query"].to_numpy()
            unlifted = iter(distances(x[asked], pivots, longest, True))
            yield batch.assign(near=far.argmin(1), far=[r.tobytes() for r in far], far_query=[next(unlifted).tobytes() if q else None for q in asked])

    return vectors.mapInPandas(rows, _TABLE)


def _dealt(counts: dict[int, int], size: int) -> tuple[Column, dict[int, int], int]:
    """The block of a row (uid, near): some `size` rows a block, rows of one nearest pivot in blocks that follow each other. And the
    first block of each pivot, and how many blocks there are. counts: rows by nearest pivot."""
    total = max(1, sum(counts.values()))
    blocks = -(-total // size)
    first, at, place = {}, 0, F.lit(0)
    for near, n in counts.items():
        if n:
            place = F.when(F.col("near") == near, F.lit(at) + F.pmod(F.xxhash64("uid"), F.lit(n))).otherwise(place)
            first[near] = at * blocks // total
            at += n
    return F.floor(place * F.lit(blocks) / F.lit(total)).cast("int"), first, blocks


def _reachable(asked: DataFrame, cand: DataFrame, longest: float) -> DataFrame:
    """qb, cb: blocks of queries (qb, v, far_query, least), and the candidate blocks that some query of theirs may need."""

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            far = _stack(batch.far)
            for cb, rows in batch.groupby("cb").indices.items():
                new = np.stack([far[rows].min(0), far[rows].max(0)])
                held[cb] = np.stack([np.minimum(held[cb][0], new[0]), np.maximum(held[cb][1], new[1])]) if cb in held else new
        yield pd.DataFrame({"cb": list(held), "low": [x[0].tobytes() for x in held.values()], "high": [x[1].tobytes() for x in held.values()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cb": pdf.cb[:1], "low": [_stack(pdf.low).min(0).tobytes()], "high": [_stack(pdf.high).max(0).tobytes()]})

    shape = "cb int, low binary, high binary"
    blocks = stored(cand.select("cb", "far").mapInPandas(ranges, shape).groupBy("cb").applyInPandas(merge, shape))
    parts = max(1, -(-blocks.count() // RANGES))
    asked = asked.withColumn("group", F.floor(F.col("qb") / GROUP).cast("int"))
    groups = max(1, -(-asked.agg(F.max("qb") + 1).first()[0] // GROUP))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    # Bounded parts of the ranges meet bounded groups of queries in tasks of their own.
    side_c = blocks.select(F.pmod("cb", F.lit(parts)).alias("part"), every(groups).alias("group"), "cb", "low", "high")
    side_q = asked.select("group", every(parts).alias("part"), "qb", "far_query", "least", norm.alias("norm"))

    def compare(queries: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(blocks):
            return pd.DataFrame({"qb": [], "cb": []})
        low, high, cb = _stack(blocks.low), _stack(blocks.high), blocks.cb.to_numpy()
        out = []
        for qb, mine in queries.groupby("qb"):
            need = np.zeros(len(blocks), bool)
            for far, least, norm in zip(_stack(mine.far_query), mine.least, mine.norm, strict=True):
                gap = np.maximum(low - far, far - high).max(1, initial=0)
                need |= highest(gap, norm, longest) >= least
            out.append(pd.DataFrame({"qb": qb, "cb": cb[need]}))
        return pd.concat(out)

    by = ["group", "part"]
    return side_q.groupBy(*by).cogroup(side_c.groupBy(*by)).applyInPandas(compare, "qb int, cb int")


def _search(pairs: DataFrame, cand: DataFrame, asked: DataFrame, dim: int, longest: float, k: int) -> DataFrame:
    """The best candidates of each pair (qb, cb) of blocks for each query of the block: a task holds two bounded blocks."""

    def pair(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        c, far_c = _matrix(block.v.to_list(), dim), _stack(block.far)
        q, far_q = _matrix(queries.v.to_list(), dim), _stack(queries.far_query)
        uid, vec_id, out = block.uid.to_numpy(), block.vec_id.to_numpy(), []
        for i, (own, query_id, least) in enumerate(zip(queries.uid, queries.vec_id, queries.least, strict=True)):
            found = search_block(q[i], far_q[i], own, least, c, far_c, uid, vec_id, longest, k)
            out.append(np.stack([np.full(len(found[0]), own), np.full(len(found[0]), query_id), *found[:3]], 1))
        whole = np.concatenate(out) if out else np.empty((0, 5), np.int64)
        return pd.DataFrame(whole.astype(np.int64), columns=["query_uid", "query_id", "uid", "vec_id", "score"])

    side_q = pairs.join(asked, "qb").select("qb", "cb", "uid", "vec_id", "v", "far_query", "least")
    side_c = pairs.join(cand, "cb").select(*[F.col(a).alias(b) for a, b in (("qb", "to"), ("cb", "of"), ("uid", "uid"), ("vec_id", "vec_id"), ("v", "v"), ("far", "far"))])
    return side_q.groupBy("qb", "cb").cogroup(side_c.groupBy("to", "of")).applyInPandas(pair, _FOUND)


def top_k(vectors: DataFrame, query: Column, k: int = 10, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that the condition `query` selects, the k highest integer inner products among
    all other rows; ties go to the smaller vec_id.

    vectors holds vec_id and v as `quantised` gives them; further columns serve the condition and are left out. Vectors of unequal
    length are compared over what both have. Rows that repeat an id, or a whole row, are rows of their own: each is a
    candidate of all others, and each that is selected gets its own k rows. Fewer than k others give fewer rows, empty tables
    none. A score beyond 64 bits is an error."""
    spark = vectors.sparkSession
    rows = stored(vectors.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(query, F.lit(False)).alias("query"), "v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    n, asked, dim, longest = rows.agg(F.count("*"), F.count_if("query"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(norm), F.lit(0.0))).first()
    if not asked or n < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Pivots come from a bounded number of rows, whatever the table's size.
    pool = rows.orderBy(F.xxhash64("vec_id"), "uid").limit(POOL).collect()
    table = stored(pivot_table(rows, chosen_pivots(_matrix([r["v"] for r in pool], dim), longest, pivots), longest))
    near = table.groupBy("near").agg(F.count("*").alias("n"), F.count_if("query").alias("asked")).orderBy("near").collect()  # as many rows as pivots
    cb, first, blocks = _dealt({r["near"]: r["n"] for r in near}, BLOCK)
    qb, _, q_blocks = _dealt({r["near"]: r["asked"] for r in near}, QUERIES)
    cand = table.withColumn("cb", cb)
    asked = table.filter("query").withColumn("qb", qb)
    anything = asked.withColumn("least", F.lit(-float("inf")))
    if blocks * q_blocks <= PAIRS:
        every = spark.createDataFrame([(i, j) for i in range(q_blocks) for j in range(blocks)], "qb int, cb int")
        found = _search(every, cand, anything, dim, longest, k)
    else:
        # The first block of a pivot that is the nearest to some queries of a block sets the score to reach.
        home = F.lit(0)
        for pivot, block in first.items():
            home = F.when(F.col("near") == pivot, block).otherwise(home)
        homes = stored(asked.groupBy("qb").agg(F.min(home).cast("int").alias("cb")))
        start = stored(_search(homes, cand, anything, dim, longest, k))
        reached = start.groupBy(F.col("query_uid").alias("uid")).agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least")).filter(F.col("n") >= k)
        bounded = stored(asked.join(reached.select("uid", "least"), "uid", "left").withColumn("least", F.coalesce("least", F.lit(-float("inf")))))
        pairs = stored(_reachable(bounded, cand, longest).join(homes, ["qb", "cb"], "left_anti"))
        found = start.unionByName(_search(pairs, cand, bounded, dim, longest, k))
    rank = F.row_number().over(W.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
