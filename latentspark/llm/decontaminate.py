"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short, documents long, so items are sketched and documents probed: an item's sketch is its smallest
hashed shingles, and the share of them that a document holds estimates containment. Items are partitioned by their
number of shingles, and each partition has the sketch length that keeps the chance of missing a
contained item below `miss`. A document that holds any sketch shingle of an item is a candidate, and exact
containment of all the item's shingles decides.

Items that fit one index are sent to the executors, and documents are judged where they are. More items than that stay in
tables, one folder for each size partition: documents' shingles are joined with sketches, and candidates' shingles with items'.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentspark.llm.common import drop, maybe_in, stored
from latentspark.llm.shingles import WordHashes, shingles

#: Items of an index and bytes of their texts, at most; an index is sent to the executors. Beyond either, items are joined.
ITEMS, BYTES = 20_000, 1 << 24
#: 64-bit words of the bitmap of shingles that documents are asked for in a join: 8 MB. Copies of a row that meets more than a thousandth of the other side.
WORDS, SALTS = 1 << 20, 32
#: Chance that the sketch of a contained item meets nothing.
MISS = 1e-9
MATCHES = "doc_id string, item_id string, n_item long, n_shared long, containment double"


def size_partition(n: int) -> int:
    """Items of up to 2 ** p shingles, and more than half of that, are partition p."""
    return math.ceil(math.log2(n)) if n > 1 else 0


def sketch_length(n: int, threshold: float, miss: float = MISS) -> int:
    """By the partition that n shingles belong to. A contained item lacks up to 1 - threshold of its
    shingles; that all k sketch shingles are among them has at most that chance to the power k."""
    largest = 1 << size_partition(n)
    lacking = math.floor((1 - threshold) * largest + 1e-9)
    if lacking == 0:
        return 1
    return min(largest, math.ceil(math.log(miss) / math.log(max(lacking / largest, 0.01))))


class ItemIndex:
    """Sketches and shingle sets of up to ITEMS test items."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int, threshold: float):
        words = WordHashes()
        self.size, self.threshold = size, threshold
        self.ids: list[str | None] = []
        self.sets: list[np.ndarray] = []
        #: The run length of each item: an item of fewer words than `size` is one run of all its words.
        self.runs: list[int] = []
        owner, probe = [], []
        for item_id, text in items:
            w = words.of(text)
            if not len(w):
                continue
            s = np.unique(shingles(w, size))
            least = sketch_length(len(s), threshold)
            owner += [len(self.ids)] * min(least, len(s))
            probe.append(s[:least])
            self.ids.append(item_id)
            self.sets.append(s)
            self.runs.append(min(size, len(w)))
        probes = np.concatenate(probe) if probe else np.empty(0, np.uint64)
        order = np.argsort(probes, kind="stable")
        self.probes, self.owner = probes[order], np.array(owner, np.int64)[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.probes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def matches(self, words: np.ndarray) -> Iterator[tuple[str | None, int, int]]:
        """item id, its number of shingles and how many of them the document holds, where enough."""
        hashes = {run: shingles(words, run) for run in set(self.runs) if run <= len(words)}
        for run, h in hashes.items():
            maybe = h[self.seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]]
            left = np.searchsorted(self.probes, maybe, "left")
            right = np.searchsorted(self.probes, maybe, "right")
            found = {int(o) for a, b in zip(left, right, strict=True) if b > a for o in self.owner[a:b]}
            found = [o for o in found if self.runs[o] == run]
            held = np.unique(h) if found else h
            for o in sorted(found):
                shared = int(np.isin(self.sets[o], held, assume_unique=True).sum())
                if shared >= self.threshold * len(self.sets[o]) - 1e-9:
                    yield self.ids[o], len(self.sets[o]), shared


def one_index(items: DataFrame, size: int, threshold: float) -> Broadcast | None:
    """The items, their ids as text, as a broadcast index; None if they are more than one holds."""
    n, volume = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if n > ITEMS or volume > BYTES:
        return None
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text").collect()
    return items.sparkSession.sparkContext.broadcast(ItemIndex([tuple(r) for r in rows], size, threshold))


def key_of(doc_id: Column, text: Column) -> Column:
    """One key for id and text, nulls told from empty ones."""
    known = lambda c: F.concat(F.when(c.isNull(), "0").otherwise("1"), F.coalesce(c.cast("string"), F.lit("")))
    return F.unhex(F.md5(F.concat(known(doc_id), F.lit("\0"), known(text)).cast("binary")))


def item_table(items: DataFrame, size: int, threshold: float) -> DataFrame:
    """Items with words: uid, item_id (as text), run (words of a shingle), n_item, all (their shingles, rising, so a sketch's come first), least
    (length of the sketch) and part, by which the table lies in folders."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            out = []
            for uid, item_id, text in zip(batch.uid, batch.item_id, batch.text, strict=True):
                w = words.of(text)
                if len(w):
                    s = np.unique(shingles(w, size))
                    out.append((uid, item_id, min(size, len(w)), len(s), s.view(np.int64), min(len(s), sketch_length(len(s), threshold)), size_partition(len(s))))
            yield pd.DataFrame(out, columns=["uid", "item_id", "run", "n_item", "all", "least", "part"])

    rows = items.select(F.monotonically_increasing_id().alias("uid"), F.col("item_id").cast("string").alias("item_id"), "text")
    return stored(rows.mapInPandas(read, "uid long, item_id string, run int, n_item long, all array<long>, least int, part int"), "part")


def bitmap(shingle: DataFrame) -> Broadcast:
    """Which of 64 * WORDS classes the values of column s fall in."""
    word, bit = F.shiftrightunsigned("s", 6).bitwiseAND(WORDS - 1), F.col("s").bitwiseAND(63).cast("int")
    rows = shingle.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toPandas()  # WORDS rows at most
    bits = np.zeros(WORDS, np.int64)
    bits[rows.word.to_numpy(np.int64)] = rows.bits
    return shingle.sparkSession.sparkContext.broadcast(bits.view(np.uint64))


def document_shingles(docs: DataFrame, asked: Broadcast, runs: list[int]) -> DataFrame:
    """key, run, s, n_doc: of each document (key, text) the distinct shingles, of each number of words in `runs`, that may be among those asked for, and
    how many distinct ones of that run it has."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, bits = WordHashes(), asked.value
        for batch in batches:
            for key, text in zip(batch.key, batch.text, strict=True):
                w = words.of(text)
                for run in [r for r in runs if r <= len(w)]:
                    s = np.unique(shingles(w, run))
                    held = s[(bits[(s >> np.uint64(6)) & np.uint64(WORDS - 1)] >> (s & np.uint64(63))) & np.uint64(1) == 1]
                    if len(held):
                        yield pd.DataFrame({"key": [key] * len(held), "run": run, "s": held.view(np.int64), "n_doc": len(s)})

    return docs.select("key", "text").mapInPandas(read, "key binary, run int, s long, n_doc long")


def salted_join(many: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join. Keys of more than a thousandth of the rows of `many`, a thousand at most, are dealt over SALTS tasks; the rows of `few`
    with such a key are copied to each."""
    n = many.count()
    hot = F.broadcast(stored(many.groupBy(*keys).count().filter(F.col("count") * 1000 > n).select(*keys, F.lit(SALTS).alias("_salts"))))
    dealt = many.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*many.columns), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    copied = few.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(copied, [*keys, "_salt"]).drop("_salt")


def joined_leaks(keyed: DataFrame, items: DataFrame, size: int, threshold: float) -> DataFrame:
    """key, item_id, n_item, n_shared for documents (key, text) and any number of items.

    Shingles of documents that may belong to a sketch meet the sketches; a document with too few shingles for an item is no candidate. Then the
    candidates' shingles meet those of their items and are counted. Nothing of the items but a bitmap passes through the driver."""
    table = item_table(items, size, threshold)
    sketches = table.select("uid", "run", "n_item", F.explode(F.slice("all", 1, F.col("least"))).alias("s"))
    runs = [r["run"] for r in table.select("run").distinct().collect()]  # `size` at most
    hits = stored(document_shingles(keyed, bitmap(sketches), runs).distinct())
    near = F.col("n_doc") >= threshold * F.col("n_item") - 1e-9
    pairs = stored(salted_join(hits, sketches, ["run", "s"]).filter(near).select("key", "uid").distinct())
    drop(hits)
    of_items = salted_join(pairs, table.select("uid", "item_id", "run", "n_item", "all"), ["uid"])
    wanted = stored(of_items.select("key", "uid", "item_id", "run", "n_item", F.explode("all").alias("s")))
    candidates, _ = maybe_in(keyed, pairs, ["key"])
    # A key and a shingle are one row here, so no task gets many rows of one shingle.
    held = document_shingles(candidates, bitmap(wanted), runs).select("key", "run", "s").distinct()
    shared = wanted.join(held, ["key", "run", "s"]).groupBy("key", "uid").agg(F.first("item_id").alias("item_id"), F.first("n_item").alias("n_item"), F.count("*").alias("n_shared"))
    leaks = stored(shared.filter(F.col("n_shared") >= threshold * F.col("n_item") - 1e-9).drop("uid"))
    drop(table, pairs, wanted)
    return leaks


def find_leaks(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row for each document and test item whose shingles the document holds to at least the threshold: doc_id, item_id,
    n_item (the item's distinct shingles), n_shared, containment.

    Needs doc_id and text, item_id and text; further columns are left out. Words are runs between white space, lower-cased,
    letters and digits only. Items without words, documents without words and nulls match nothing; items of fewer than `size`
    words match documents that hold all of them in a row. Repeated documents and items repeat their rows. Ids are of any type that text
    holds. With one index one pass over the documents, no shuffle; beyond it joins, with the same rows."""
    # Ids pass through Python as text: there, numbers with nulls among them would lose digits.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    index = one_index(items, size, threshold)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            out = [(d, i, n, k, k / n) for d, text in zip(batch.doc_id, batch.text, strict=True) for i, n, k in index.value.matches(words.of(text))]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_item", "n_shared", "containment"])

    if index:
        found = rows.mapInPandas(probe, MATCHES)
    else:
        keyed = rows.withColumn("key", key_of(F.col("doc_id"), F.col("text")))
        leaks = joined_leaks(keyed, items, size, threshold)
        # Rows of one id and text are judged once, and each has its leaks.
        there, _ = maybe_in(keyed.select("key", "doc_id"), leaks, ["key"])
        copies = there.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n"))
        each = leaks.join(copies, "key").withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n"))))
        found = each.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))
    return found.withColumns({"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "item_id": F.col("item_id").cast(items.schema["item_id"].dataType)})


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs without those that hold a test item, as `find_leaks` finds them; all columns stay, and so do documents without
    words. With one index a filter over the documents where they are, no shuffle; beyond it only documents that may be leaks are shuffled."""
    index = one_index(items, size, threshold)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            keep = [next(index.value.matches(words.of(text)), None) is None for text in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    if index:
        return docs.mapInArrow(clean, docs.schema)
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), "text", key_of(F.col("doc_id"), F.col("text")).alias("key"))
    leaks = joined_leaks(packed.select("key", "text"), items, size, threshold).select("key").distinct()
    asked, plain = maybe_in(packed, leaks, ["key"])
    return plain.select("row.*").unionByName(asked.join(leaks, "key", "left_anti").select("row.*"))
