"""Best-fit decreasing packing of token sequences.

Best fit looks only at lengths, and lengths are bounded by the sequence. So the decision is made once for
all pieces of a length: a segment tree over remaining capacities, holding how many bins are open at each, finds
the tightest one in logarithmic time, and as many pieces as fit go into as many bins of it as there are. The
plan that comes out (a few runs a length) is as large for 100 TB as for a megabyte; which piece gets which
place in a run follows from its rank among the pieces of its length, which Spark computes.
"""

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.llm.common import ranked, stored

PIECES = "doc_id string, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """Open bins by remaining capacity: a segment tree of counts, with the bins of a capacity as ranges of ids."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(self.leaves)]

    def add(self, capacity: int, first: int, n: int) -> None:
        if n and capacity:
            self.bins[capacity].append((first, n))
            self._change(capacity, n)

    def take(self, capacity: int) -> tuple[int, int]:
        first, n = self.bins[capacity].pop()
        self._change(capacity, -n)
        return first, n

    def _change(self, capacity: int, n: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += n
            node >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of an open bin that is at least `least`."""
        node = least + self.leaves
        if self.count[node]:
            return least
        while node > 1:
            if not node & 1 and self.count[node + 1]:  # a right sibling holds larger capacities
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit_runs(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over `histogram` (length to number of pieces).

    Runs (length, from_rank, to_rank, first_bin, per_bin, offset): the pieces of that length with ranks in the range
    fill bins from first_bin on, per_bin in each, from that offset. Equal to placing the pieces one at a time: a bin
    that has just taken a piece of this length is the tightest for the next as long as it still has room."""
    tree, runs, bins = CapacityTree(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = tree.take(room)
            per_bin = room // length
            used = min(n, -(-left // per_bin))
            placed = min(left, used * per_bin)
            runs.append((length, rank, rank + placed, first, per_bin, capacity - room))
            full, odd = divmod(placed, per_bin)
            tree.add(room, first + used, n - used)
            tree.add(room - per_bin * length, first, full)
            if odd:
                tree.add(room - odd * length, first + full, 1)
            rank, left = rank + placed, left - placed
    return runs


@lru_cache(maxsize=2)
def _encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_pieces(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], end_id: int, size: int) -> DataFrame:
    """One row a piece (doc_id, piece, start, length, ids_crc32): the token ids of each text and end_id, cut into pieces of at most `size`, the first
    piece being the shorter one. Special strings become their ids, as the tokenizer does by default."""

    def ids_of(enc: tiktoken.Encoding, text: str) -> np.ndarray:
        for mark, mark_id in special.items():
            if mark in text:
                parts = [ids_of(enc, part) for part in text.split(mark)]
                return np.concatenate([x for part in parts for x in (np.array([mark_id], np.uint32), part)][1:])
        return np.array(enc.encode_ordinary(text), np.uint32)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(ranks_path, pattern)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.doc_id, batch.text, strict=True):
                ids = np.append(ids_of(enc, text or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % size or size
                edges = [0, *range(first, len(ids) + 1, size)]
                out += [(doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    # Ids pass through Python as text: there, numbers with nulls among them would lose digits.
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(cut, PIECES).withColumn("doc_id", F.col("doc_id").cast("long"))


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """pieces, as `token_pieces` gives them, with sequence_id and offset: best-fit decreasing into sequences of at most `size` tokens."""
    pieces = stored(pieces)
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    runs = pieces.sparkSession.createDataFrame(best_fit_runs(histogram, size), "length long, from_rank long, to_rank long, first_bin long, per_bin long, base long")
    by_rank = ranked(pieces, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "rank").alias("p")
    fits = (F.col("p.length") == F.col("r.length")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    nth = F.col("rank") - F.col("from_rank")
    # The runs are few: their number depends on `size` alone.
    placed = by_rank.join(F.broadcast(runs.alias("r")), fits)
    return placed.select("doc_id", "piece", "start", "p.length", "ids_crc32", (F.col("first_bin") + F.floor(nth / F.col("per_bin"))).alias("sequence_id"), (F.col("base") + F.pmod(nth, F.col("per_bin")) * F.col("p.length")).alias("offset"))


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int] | None = None, end_id: int = 2, size: int = 1024) -> DataFrame:
    """Packs whole texts into sequences of at most `size` tokens: per piece doc_id, piece, start, length, ids_crc32,
    sequence_id and offset.

    Needs doc_id and text; further columns are left out. Null and empty texts are one piece of end_id alone.
    Repeated rows are packed each; ties in length are placed by a hash of the piece. No rows give none."""
    return pack(token_pieces(docs, ranks_path, pattern, special or {}, end_id, size), size)
