"""Near-duplicate documents: a chosen-path join on word shingles.

In each run a set follows a path of sampled tokens (its smallest shingles under hash functions of that run); sets
that share the path share a bucket. A bucket is split by the next token of the path until it is small, and then
its sets are compared by sketches. Sets whose sketches come near the threshold are joined to candidate groups, in
which exact Jaccard similarity of all shingles decides every pair. Runs are repeated until a pair at the threshold is
missed with less than `1 - recall` even at the deepest level.

Documents with the same shingle set are one class from the start, with its size as weight. A bucket that is still large
at the deepest level (many documents share a passage or are near copies) is compared whole, by leaders: a set near
a leader stands for its neighbourhood, and only where that leaves a pair open are sketches compared one by one. Beyond
a task's size it is dealt into shares, and each share meets each, so no pair of a bucket is left out.
"""

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.llm.common import drop, hot_join, maybe_in, ranked, stored
from latentspark.llm.components import components
from latentspark.llm.shingles import WordHashes, shingles

#: Levels of a path; sketch positions; sets of a small bucket; sets of a
#: task's share of a large one; sets of a block; shares that a large bucket's sets are joined in.
DEPTH, SKETCH, SMALL, SHARE, BLOCK, SALTS = 3, 64, 128, 4096, 128, 32
#: Sketches that agree with a leader's in this share leave the comparison to it.
NEAR = 0.8
#: Sketches of sets at the threshold fall this many standard deviations short of it with a chance of some 1 in 10,000.
SLACK = 3.7
_ODD = np.random.default_rng(11).integers(1, 2**63, 2 * SKETCH, dtype=np.uint64) | np.uint64(1)


def runs_for(recall: float, threshold: float) -> int:
    """Runs after which a pair at the threshold shares a bucket of the deepest level with at least that chance. A signature has places for
    SKETCH // DEPTH of them; where that does not reach the recall, as at low thresholds, it is an error."""
    runs = math.ceil(math.log(1 - recall) / math.log(1 - threshold**DEPTH)) if threshold < 1 else 1
    if runs > SKETCH // DEPTH:
        raise ValueError(f"recall {recall} at similarity {threshold} takes {runs} runs; a signature has {SKETCH // DEPTH}")
    return runs


def signature(s: np.ndarray) -> np.ndarray:
    """SKETCH smallest values of the set, each under a hash function of its own."""
    out = np.full(SKETCH, np.uint64(2**64 - 1))
    for at in range(0, len(s), 1 << 13):
        h = s[None, at : at + (1 << 13)] * _ODD[:SKETCH, None]
        h ^= h >> np.uint64(32)
        h *= _ODD[SKETCH:, None]
        np.minimum(out, h.min(1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, set_key (of the whole shingle set; null: no words), signature, and its last bytes as the sketch."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            keys, signatures, sketches = [], [], []
            for text in batch.text:
                s = np.unique(shingles(words.of(text), size))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signatures.append(signature(s) if len(s) else None)
                sketches.append(signatures[-1].astype(np.uint8).tobytes() if len(s) else None)
            yield pd.DataFrame({"doc_id": batch.doc_id, "text_key": batch.text_key, "set_key": keys, "signature": signatures, "sketch": sketches})

    # Ids pass through Python as text: there, numbers with nulls among them would lose digits.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"), "text")
    read_rows = rows.mapInPandas(read, "doc_id string, text_key string, set_key binary, signature array<int>, sketch binary")
    return read_rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def _spanning(nodes: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges to the smallest node of each connected part of a small symmetric relation."""
    label = np.arange(len(nodes))
    while True:
        new = np.where(linked, label[None, :], len(nodes)).min(1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(nodes[i]), int(nodes[j])) for i, j in enumerate(label) if i != j]


def _agree(sketch: np.ndarray, others: np.ndarray) -> np.ndarray:
    return (sketch == others).mean(-1)


def _bucket_edges(nodes: np.ndarray, sketches: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges that connect all sets of a bucket whose sketches agree in a share of at least `least`, directly or by others.

    In a large bucket, sets that agree with a leader to NEAR or more are its own. A set that agrees to `least` with one of them
    agrees with the leader to least + NEAR - 1 or more; it is compared with all of the leader's own only if it falls below `least`."""
    if len(nodes) <= SMALL:
        return _spanning(nodes, _agree(sketches[:, None, :], sketches[None, :, :]) >= least)
    label, left = np.arange(len(nodes)), np.arange(len(nodes))
    while len(left):
        agree = _agree(sketches[left[0]], sketches)
        own = left[agree[left] >= max(NEAR, least)]
        near = agree >= least
        for i in np.flatnonzero(~near & (agree >= least + NEAR - 1)) if len(own) > 1 else ():
            near[i] = (_agree(sketches[i], sketches[own]) >= least).any()
        # All labels that meet here become the smallest of them.
        met = np.unique(label[near])
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
        left = left[agree[left] < max(NEAR, least)]
    return [(int(nodes[i]), int(nodes[j])) for i, j in enumerate(label) if i != j]


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows that follow each other with equal keys."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        new = np.zeros(len(batch), bool)
        for k in keys:
            v = batch[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        edges = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.iloc[a:b]
        held = batch.iloc[edges[-1] :]
    if held is not None and len(held):
        yield held


def candidate_edges(reps: DataFrame, runs: int, threshold: float) -> DataFrame:
    """Edges (a, b) between sets (node, signature, sketch) whose sketches say that they may be similar enough."""
    least = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / SKETCH)
    least += (1 - least) / 256  # bytes also agree by chance

    def path(run: int):
        steps = [F.xxhash64(F.lit(run), *[F.element_at("signature", run * DEPTH + d + 1) for d in range(level + 1)]) for level in range(DEPTH)]
        return F.array(*steps)

    open_ = reps.select("node", F.explode(F.array(*[path(r) for r in range(runs)])).alias("path"))
    leaves, temporary = [], []
    for level in range(1, DEPTH + 1):
        here = open_.withColumn("bucket", F.element_at("path", level))
        sizes = stored(here.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
        temporary.append(sizes)
        small = here.join(sizes.filter(F.col("n") <= SMALL), "bucket").select("node", "bucket", F.lit(0).alias("i"), F.lit(0).alias("j"))
        leaves.append(small)
        # Copies of a large bucket's size meet shares of its sets, so that no task gets all of them.
        copies = sizes.filter(F.col("n") > SMALL).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        large = here.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(SALTS)).cast("int")).join(copies, ["bucket", "salt"])
        if level < DEPTH:
            open_ = stored(large.select("node", "path"))
            temporary.append(open_)
        else:
            shares = F.ceil(F.col("n") / SHARE).cast("int")
            mine = large.select("node", "bucket", shares.alias("shares"), F.pmod(F.xxhash64("node", "bucket"), shares).cast("int").alias("mine"))
            # Each share meets each; most large buckets are one.
            meets = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
            leaves.append(meets.select("node", "bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")))
    members = leaves[0]
    for more in leaves[1:]:
        members = members.unionByName(more)
    members = stored(members)
    drop(*temporary)
    lit = members.join(reps.select("node", "sketch"), "node")

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                batch, last = held, True
            else:
                batch, last = batch if held is None else pd.concat([held, batch], ignore_index=True), False
            if batch is None or not len(batch):
                continue
            bucket, first, second, nodes = (batch[c].to_numpy() for c in ("bucket", "i", "j", "node"))
            sketches = np.frombuffer(b"".join(batch.sketch), np.uint8).reshape(len(batch), SKETCH)
            starts = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
            ends = np.append(starts[1:], len(batch))
            if not last:  # the last bucket may go on in the next batch
                held, starts, ends = batch.iloc[starts[-1] :], starts[:-1], ends[:-1]
            two = starts[ends - starts == 2]
            two = two[_agree(sketches[two], sketches[two + 1]) >= least]
            edges = list(zip(nodes[two].tolist(), nodes[two + 1].tolist(), strict=True))
            for a, b in zip(starts, ends, strict=True):
                if b - a > 2:
                    # Another order in each bucket: other leaders.
                    order = a + np.random.default_rng(abs(int(bucket[a]))).permutation(b - a)
                    edges += _bucket_edges(nodes[order], sketches[order], least)
            yield pd.DataFrame(edges, columns=["a", "b"])

    dealt = lit.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    edges = dealt.mapInPandas(link, "a long, b long")
    edges.stored_at = members.stored_at
    return edges


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    values, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = n[column] > 1
    row, column = row[shared], (np.cumsum(n > 1) - 1)[column[shared]]
    out = np.zeros((len(sets), len(sets)))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 1 << 14
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        out += part @ part.T
    return out


def verified(groups: DataFrame, docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """node, root, links from candidate groups (node, group, doc_id, text_key, weight, blocks): in each block the exact links, as
    the summed weight of a node's similar nodes, and the smallest node of those that it is linked with there."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"), "text")
    rows, _ = maybe_in(rows, groups, ["doc_id", "text_key"])  # texts outside of all groups stay where they are
    same = groups["doc_id"].eqNullSafe(rows["doc_id"]) & (groups["text_key"] == rows["text_key"])
    texts = groups.join(rows, same).select("node", "group", "weight", "blocks", "text")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            sets = [np.unique(shingles(words.of(t), size)).tobytes() for t in batch.text]
            yield batch.drop(columns="text").assign(shingles=sets)

    mine = F.pmod(F.xxhash64("node", F.lit(9)), F.col("blocks")).cast("int")
    sets = texts.mapInPandas(read, "node long, group long, weight long, blocks int, shingles binary").withColumn("block", mine)
    # Each block meets each: a set is copied once for each block of its group, most groups being one block.
    pairs = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "weight", "shingles")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _runs(batches, ["group", "i", "j"]):
            group = group.drop_duplicates("node")
            if len(group) < 2:
                continue
            sets = [np.frombuffer(s, np.uint64) for s in group.shingles]
            nodes, weight, block = group.node.to_numpy(), group.weight.to_numpy(), group.block.to_numpy()
            n = np.array([len(s) for s in sets])
            both = _overlaps(sets)
            linked = both >= threshold * (n[:, None] + n[None, :] - both) - 1e-9
            np.fill_diagonal(linked, False)
            if group.i.iloc[0] != group.j.iloc[0]:
                linked &= block[:, None] != block[None, :]
            root = {a: b for a, b in _spanning(nodes, linked)}
            out = [(int(a), root.get(int(a), int(a)), int(w)) for a, w in zip(nodes, linked @ weight, strict=True) if w]
            if out:
                yield pd.DataFrame(out, columns=["node", "root", "links"])

    dealt = pairs.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "node")
    return dealt.mapInPandas(compare, "node long, root long, links long")


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """One row a document: doc_id, text_key (md5 of the text), class_id (the smallest doc_id, null only if there is no other, that a chain of links of at least `threshold`
    joins it with) and n_links (how many other documents are that similar to it).

    Needs doc_id and text; further columns are left out. Words are runs between white space, lower-cased, letters and digits only;
    fewer words than `size` are one shingle. Documents without words, and nulls, are classes of their own without links.
    Repeated rows are documents that are linked. No rows give none. A recall that the signature cannot reach at the threshold is an error."""
    read = stored(_sets(docs, size))
    first = F.min_by(F.struct("doc_id", "text_key", "signature", "sketch"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    classes = read.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.count("*").alias("weight"), first.alias("f"))
    reps = stored(ranked(classes.select("set_key", "weight", "f.*"), [], ["set_key"], "node"))

    edges = candidate_edges(reps, runs_for(recall, threshold), threshold)
    near_label = components(edges)
    drop(edges)
    near = near_label.withColumnRenamed("label", "group")
    blocks = near.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    groups = stored(near.join(blocks, "group").join(reps.select("node", "doc_id", "text_key", "weight"), "node"))
    drop(near_label)
    links = stored(verified(groups, docs, size, threshold))
    drop(groups)
    total = links.groupBy("node").agg(F.sum("links").alias("links"))
    label = components(links.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))

    labelled = stored(reps.select("node", "set_key", "doc_id", "weight").join(label, "node", "left").join(total, "node", "left").withColumn("label", F.coalesce("label", "node")))
    drop(reps, links, label)
    smallest = labelled.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("sets"))
    known = stored(hot_join(labelled, smallest, "label", "sets", labelled.count()).select("set_key", "class_id", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    drop(labelled)
    # Null keys stay aside: they match nothing and would meet in one task.
    worded = read.filter("set_key IS NOT NULL").select("doc_id", "text_key", "set_key")
    with_words = hot_join(worded, known, "set_key", "weight", worded.count()).select("doc_id", "text_key", "class_id", "n_links")
    without = read.filter("set_key IS NULL").select("doc_id", "text_key", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    out = with_words.unionByName(without)
    out.tables = (read, known)
    return out


def deduplicate(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs, all columns, with one document of each class: the one with the smallest doc_id."""
    classes = near_duplicates(docs, size, threshold)
    found = stored(classes.select("doc_id", "text_key", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept")))
    drop(*classes.tables)
    gone = found.filter("NOT kept").select("doc_id", "text_key", F.lit(False).alias("again"))
    # Rows of one id and text are one document.
    again = found.filter("kept").groupBy("doc_id", "text_key").count().filter("count > 1").select("doc_id", "text_key", F.lit(True).alias("again"))
    special = stored(gone.unionByName(again).distinct())
    drop(found)
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"))
    # Only rows that may go or come again are shuffled; the others stay where they are.
    asked, plain = maybe_in(packed, special, ["doc_id", "text_key"])
    same = asked["doc_id"].eqNullSafe(special["doc_id"]) & (asked["text_key"] == special["text_key"])
    judged = asked.join(special, same, "left").select("row", asked["doc_id"], asked["text_key"], "again")
    out = plain.select("row.*").unionByName(judged.filter("again IS NULL").select("row.*"))
    if special.filter("again").isEmpty():
        return out
    return out.unionByName(judged.filter("again").dropDuplicates(["doc_id", "text_key"]).select("row.*"))
