"""Row sets by counter-based keys: folds, splits, subsamples; and permutations by keyed bijections of the rows' ranks.

The key of a row in resample b is md5(seed:label:b:id), so draws do not depend on how rows are partitioned. Ranks
are taken in 256 ranges of keys whose sizes give each range its first rank; no task sorts a whole resample. Where only
the side of a cut matters (halves, folds), the key at the cut is found once for each draw, and each row then
tells by its own keys which sets it is in, without a shuffle.
"""

import hashlib
import itertools
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from latentspark.functions.kernels import fold_sizes
from latentspark.sources.frame import ID, Frame, Y


def resolve_seed(seed: int | None) -> int:
    return secrets.randbits(63) if seed is None else int(seed)


def key(seed: int, label: str, b: Column, row_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(label), b.cast("string"), row_id.cast("string")).cast("binary"))


def ranks(rows: DataFrame, seed: int, label: str, draws: int) -> DataFrame:
    """row_id, b (from 0), rank (from 0): the rows' order in each of `draws` random permutations."""
    keyed = rows.select(ID, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b")).withColumn("key", key(seed, label, F.col("b"), F.col(ID)))
    keyed = keyed.withColumn("range", F.substring("key", 1, 2))
    sizes = keyed.groupBy("b", "range").agg(F.count("*").alias("n"))
    first = sizes.select("b", "range", (F.sum("n").over(W.partitionBy("b").orderBy("range")) - F.col("n")).alias("first"))
    local = keyed.withColumn("local", F.row_number().over(W.partitionBy("b", "range").orderBy("key", ID)) - 1)
    return local.join(first, ["b", "range"]).select(ID, "b", (F.col("first") + F.col("local")).alias("rank"))


def cut_keys(rows: DataFrame, seed: int, label: str, draws: int, places: list[int]) -> list[list[str]]:
    """The keys of the rows with ranks `places` in each draw; beyond all keys where there is no such rank.

    Counts of 4096 ranges of keys tell which range holds the rank; only the rows of those ranges are shuffled and sorted."""
    keyed = rows.select(F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b"), F.col(ID)).select("b", key(seed, label, F.col("b"), F.col(ID)).alias("key"))
    keyed = keyed.withColumn("range", F.substring("key", 1, 3))
    sizes = keyed.groupBy("b", "range").agg(F.count("*").alias("n"))
    first = sizes.withColumn("first", F.sum("n").over(W.partitionBy("b").orderBy("range")) - F.col("n"))
    wanted = first.withColumn("place", F.explode(F.array(*map(F.lit, places)))).filter((F.col("place") >= F.col("first")) & (F.col("place") < F.col("first") + F.col("n")))
    held = wanted.groupBy("b", "range", "first").agg(F.collect_list("place").alias("places"))  # a row a draw and place
    there = keyed.join(F.broadcast(held), ["b", "range"])
    ranked = there.withColumn("rank", F.col("first") + F.row_number().over(W.partitionBy("b", "range").orderBy("key")) - 1)
    found = {(r["b"], r["rank"]): r["key"] for r in ranked.filter(F.array_contains("places", F.col("rank"))).select("b", "rank", "key").collect()}  # as many rows
    return [[found.get((b, place), "~") for place in places] for b in range(draws)]


def halves(rows: DataFrame, seed: int, label: str, draws: int, n_in: int, both: bool = True) -> Column:
    """The sets of a row as an array: 2b (it is among the first n_in rows of draw b) or 2b + 1 (among the others; left out without `both`)."""
    cuts = F.array(*[F.lit(c[0]) for c in cut_keys(rows, seed, label, draws, [n_in])])
    every = F.sequence(F.lit(0), F.lit(draws - 1))
    inside = lambda b: key(seed, label, b, F.col(ID)) < F.get(cuts, b)
    if not both:
        return F.transform(F.filter(every, inside), lambda b: 2 * b)
    return F.transform(every, lambda b: F.when(inside(b), 2 * b).otherwise(2 * b + 1))


def subsets(rows: DataFrame, seed: int, label: str, draws: int, n_in: int) -> Column:
    """The draws as an array in which a row is among the first n_in."""
    return F.transform(halves(rows, seed, label, draws, n_in, both=False), lambda s: F.floor(s / 2).cast("int"))


def fold_of(rank: Column, n: int, folds: int) -> Column:
    """The first n mod folds folds have one row more."""
    base, extra = divmod(n, folds)
    cut = extra * (base + 1)
    small = F.lit(extra) + F.floor((rank - cut) / max(base, 1))
    return F.when(rank < cut, F.floor(rank / (base + 1))).otherwise(small).cast("int")


def folds(rows: DataFrame, seed: int, n: int, n_folds: int, label: str = "fold") -> Column:
    """The sets of a row as an array: 2f + 1 (it is in fold f) or 2f (it is not), for each fold."""
    ends = list(itertools.accumulate(fold_sizes(n, n_folds)))[:-1]
    cuts = cut_keys(rows, seed, label, 1, ends)[0] if ends else []
    mine = key(seed, label, F.lit(0), F.col(ID))
    fold = sum(((mine >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    every = F.sequence(F.lit(0), F.lit(n_folds - 1))
    return F.transform(every, lambda f: F.when(f == fold, 2 * f + 1).otherwise(2 * f))


# ---- permutations

#: Odd multipliers of the hash in a round of the bijection.
MIX = (0x2C1B3C6D, 0x297A2D39)
#: Responses that are broadcast, 8 bytes each; more are joined.
SENT = 1 << 22


def bits_of(n: int) -> int:
    return max(2, int(n - 1).bit_length())


def rounds_of(n: int) -> int:
    """Halves of one or two bits need more rounds to make all orders of a few rows alike."""
    return 8 if bits_of(n) > 4 else 16


def round_keys(seed: int, label: str, draws: int, n: int) -> np.ndarray:
    """A row of keys for each draw."""
    word = lambda b, i: int(hashlib.md5(f"{seed}:{label}:{b}:{i}".encode()).hexdigest()[:8], 16)
    return np.array([[word(b, i) for i in range(rounds_of(n))] for b in range(draws)])


def bijection(ranks: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """Places from 0 to n - 1 of ranks from 0 to n - 1 in random orders, a row of the result for each row of `keys`.

    A Feistel network on the bits of n - 1: each half is changed by a keyed hash of the other, in turn. Places beyond n - 1 go through it again, which
    keeps it one to one."""
    bits = bits_of(n)
    kind = np.uint32 if bits <= 32 else np.uint64
    low, all_bits = kind(bits - bits // 2), kind(0xFFFFFFFF)
    masks = kind((1 << int(low)) - 1), kind((1 << bits // 2) - 1)
    steps = [(kind(m), kind(s)) for m, s in zip(MIX, (15, 13), strict=True)]

    def once(v: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        halves = [v & masks[0], v >> low]
        for i, key in enumerate(keys):
            h = halves[i % 2] ^ key
            for m, s in steps:
                h *= m
                if kind is np.uint64:
                    h &= all_bits
                h ^= h >> s
            h &= masks[1 - i % 2]
            halves[1 - i % 2] ^= h
        return halves[0] | halves[1] << low

    keys, start = keys.astype(kind), ranks.astype(kind)
    out = np.empty((len(keys), len(start)), np.int64)
    step = max(1, (1 << 15) // max(1, len(start)))  # draws together, as long as they stay in a core's cache
    for at in range(0, len(keys), step):
        some = keys[at : at + step]
        v = once(np.repeat(start[None], len(some), axis=0), [some[:, i : i + 1] for i in range(keys.shape[1])])
        while (outside := v >= n).any():
            again = np.nonzero(outside)[0]
            v[outside] = once(v[outside], [some[again, i] for i in range(keys.shape[1])])
        out[at : at + step] = v
    return out


def permuted(frame: Frame, seed: int, label: str, draws: int) -> Frame:
    """The frame with responses y, then y in `draws` random orders; x and weights stay where they are.

    Rows are ranked once, by a key; in draw b the row of rank r gets the response of the row whose rank is the draw's bijection of r. So rows
    are shuffled once, whatever the number of draws. Responses by rank are broadcast, 32 MB at most; beyond that they are joined by rank."""
    base = ranks(frame.rows, seed, f"{label}-base", 1).select(ID, "rank")
    rows = frame.rows.join(base, ID)
    n = frame.rows.count()
    keys = round_keys(seed, label, draws, n)
    names = frame.rows.columns
    if n <= SENT:
        found = rows.select("rank", F.get(Y, F.lit(0)).alias("value")).toArrow()
        values = np.empty(n)
        values[found.column("rank").to_numpy()] = found.column("value").to_numpy()
        shared = frame.rows.sparkSession.sparkContext.broadcast((values, keys))

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values, keys = shared.value
            for batch in batches:
                size = max(1, (1 << 22) // (1 + len(keys)))  # rows whose responses are made together
                for at in range(0, batch.num_rows, size):
                    part = batch.slice(at, size)
                    own = part.column(Y).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    order = bijection(part.column("rank").to_numpy(zero_copy_only=False), n, keys)
                    y = np.concatenate([own[:, :1], values[order].T], axis=1)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
                    yield pa.RecordBatch.from_arrays([lists if c == Y else part.column(c) for c in names], names)

        return frame.with_rows(rows.select(*names, "rank").mapInArrow(move, frame.rows.schema), q=1 + draws)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = bijection(batch.column("rank").to_numpy(zero_copy_only=False), n, keys)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(order.shape[1] + 1) * len(keys), pa.int32()), pa.array(order.T.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(ID), lists], [ID, "places"])

    kind = frame.rows.schema[ID].dataType.simpleString()
    asked = rows.select(ID, "rank").mapInArrow(places, f"{ID} {kind}, places array<long>").select(ID, F.posexplode("places").alias("b", "rank"))
    moved = asked.join(rows.select("rank", F.get(Y, F.lit(0)).alias("value")), "rank")
    lists = moved.groupBy(ID).agg(F.array_sort(F.collect_list(F.struct("b", "value"))).alias("moved"))
    both = frame.rows.join(lists, ID).withColumn(Y, F.concat(F.slice(Y, 1, 1), F.transform("moved", lambda s: s["value"]))).drop("moved")
    return frame.with_rows(both, q=1 + draws)
