"""Language-model scores of whole texts.

A word's chance is the mean of two distributions over words: its share of all words of the training documents, and
its chance under the causal self-attention model, which sees the tokens before it and gives the word's subword
ids one after the other and then that the word ends. Both sum to one over all words, so their mean does, and the score
is the log of a probability. Word and subword counts are gathered from all training documents; they also give the network
its first output biases. The network knows all ids of the tokenizer. Its weights start from a fit on some
documents; then each share of all training documents goes on from there, and the shares' weights are averaged,
each by the squared gradients that it met in the share. They are averaged once, so more documents make the average surer but take
the network no further than one share's walk; word and subword counts go on growing with the documents.

Texts are tokenised once, to a table of ids, with the counts of words. Words are told apart by 64-bit hashes of their
ids. The most frequent words' counts (a bounded number) go to the executors; occurrences of the others meet their counts
in a join.
"""

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.llm import attention_lm as net
from latentspark.llm.common import drop, most_frequent, stored
from latentspark.llm.langid import remainder
from latentspark.llm.shingles import mixed

#: Documents (about) that the network's first fit sees, and those of a share, which goes on from there.
TRAIN_DOCS, SHARE_DOCS = 1500, 4096
#: Words whose counts are sent to the executors, and places of their table.
HEAD, PLACES = 1 << 17, 1 << 20
#: Words that a task counts and texts that it remembers before it passes them on.
MEMO = 300_000
#: Weights of a row while shares are averaged; shares that a task learns at most, once every core has one; tasks' sums that are added at a time.
CHUNK, SHARES_A_TASK, FAN_IN = 1 << 15, 16, 64
#: Share of the network in a word's chance, and the smoothing of the base score's counts.
SHARE, ADD = 0.5, 0.1
#: Subword ids that are scored at a time, as long as a text ends there.
AT_ONCE = 1 << 19


@lru_cache(maxsize=2)
def _encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def begins(ranks_path: str, pattern: str) -> np.ndarray:
    """Which ids begin a word: those whose bytes begin with a space, and the end of a text, which is the last id."""
    encoding = _encoding(ranks_path, pattern)
    return np.array([encoding.decode_single_token_bytes(i).startswith(b" ") for i in range(encoding.n_vocab)] + [True])


def split_words(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


class Subwords(dict):
    """Words met so far, with their ids as bytes; each word is encoded with a space before it."""

    def __init__(self, ranks_path: str, pattern: str):
        super().__init__()
        self.encoding, self.begins = _encoding(ranks_path, pattern), begins(ranks_path, pattern)
        self.end = np.array([self.encoding.n_vocab], np.uint16).tobytes()

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, found in one call, as every word begins at the only spaces there are."""
        ids = self.encoding.encode_to_numpy(" " + b" ".join(words).decode()).astype(np.uint16)
        starts = np.flatnonzero(self.begins[ids])
        if len(starts) != len(words):  # unusual white space was drawn over a border
            return [np.array(self.encoding.encode_ordinary(" " + w.decode()), np.uint16).tobytes() for w in words]
        raw, cuts = ids.tobytes(), (2 * np.append(starts, len(ids))).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def of(self, texts) -> list[bytes]:
        """The ids of each text as 16-bit numbers, its end last."""
        words = [split_words(t) for t in texts]
        if len(self) > MEMO:
            self.clear()
        new = list({w for text in words for w in text}.difference(self))
        if new:
            self.update(zip(new, self.encode(new), strict=True))
        return [b"".join(map(self.__getitem__, text)) + self.end for text in words]


def word_hashes(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ids of each word; starts: where words begin in `ids`."""
    if not len(starts):
        return np.empty(0, np.int64)
    place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids)))) + 1
    return mixed(np.add.reduceat(mixed(ids.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(16))), starts)).view(np.int64)


#: Kinds of rows of the one pass over the texts.
TEXT, WORD, ID = 0, 1, 2
_READ = "kind int, key long, n long, doc_id string, held_out boolean, ids binary"


def read_texts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Of docs (uid, order, doc_id, held_out, text): a TEXT row each (uid, order, ids), and partial counts n of words by hash
    and of ids, from the texts that are not held out."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, first = Subwords(ranks_path, pattern), begins(ranks_path, pattern)
        ids_seen = np.zeros(len(first), np.int64)
        hashes, counts, due = [], [], 0

        def rows(kind: int, key: np.ndarray, n: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"kind": kind, "key": key, "n": n, "doc_id": None, "held_out": None, "ids": None})

        def fold() -> None:
            value, at = np.unique(np.concatenate(hashes), return_inverse=True)
            total = np.bincount(at, np.concatenate(counts), minlength=len(value)).astype(np.int64)
            hashes[:], counts[:] = [value], [total]

        for batch in batches:
            # Texts of some size at a time, whatever the batch.
            cuts = np.flatnonzero(np.diff(np.cumsum([len(t or "") for t in batch.text]) // (2 * AT_ONCE))) + 1
            for part in np.split(np.arange(len(batch)), cuts):
                mine = batch.iloc[part]
                ids = words.of(mine.text)
                yield pd.DataFrame({"kind": TEXT, "key": mine.uid.array, "n": mine.order.array, "doc_id": mine.doc_id.array, "held_out": mine.held_out.array, "ids": ids})
                flat = np.frombuffer(b"".join(i for i, held in zip(ids, mine.held_out, strict=True) if not held), np.uint16)
                if not len(flat):
                    continue
                ids_seen += np.bincount(flat, minlength=len(first))
                value, n = np.unique(word_hashes(flat, np.flatnonzero(first[flat])), return_counts=True)
                hashes.append(value)
                counts.append(n)
                due += len(value)
                if due > MEMO:
                    fold()
                    due = len(hashes[0])
                    if due > MEMO:
                        yield rows(WORD, hashes[0], counts[0])
                        hashes, counts, due = [], [], 0
        if hashes:
            fold()
            yield rows(WORD, hashes[0], counts[0])
        own = np.flatnonzero(ids_seen)
        yield rows(ID, own, ids_seen[own])

    return docs.select("uid", "order", "doc_id", "held_out", "text").mapInPandas(read, _READ)


def numbered(id_counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each id its number in the network: those that begin words come first, each kind by frequency."""
    known = np.empty(len(id_counts), np.int64)
    known[np.lexsort((-id_counts, ~first))] = np.arange(len(id_counts))
    return known


def untrained(id_counts: np.ndarray, first: np.ndarray) -> net.Weights:
    by_number = np.empty_like(id_counts)
    by_number[numbered(id_counts, first)] = id_counts
    return net.initial(by_number, int(first.sum()))


class Scorer:
    """What a task needs: the network, its numbers of the ids, and the frequent words' counts."""

    def __init__(self, weights: net.Weights, known: np.ndarray, first: np.ndarray, head: tuple[np.ndarray, np.ndarray], total: int, distinct: int):
        self.weights, self.known, self.first, self.total = weights, known, first, total
        self.scale = total + ADD * (distinct + 1)
        # One word a place; words that meet at a place but for the last are joined like rare ones.
        self.hashes, self.counts = np.zeros(PLACES, np.int64), np.full(PLACES, -1.0)
        at = head[0] & (PLACES - 1)
        self.hashes[at], self.counts[at] = head

    def frequent(self, hashes: np.ndarray) -> np.ndarray:
        """Counts of frequent words; -1 of others."""
        at = hashes & (PLACES - 1)
        return np.where(self.hashes[at] == hashes, self.counts[at], -1.0)

    def word_chances(self, ids: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Natural log of the network's chance of every word of the texts, one text after the other: its ids, the first
        one among those that begin words, and then that the word ends. A text's end is a word and needs no other."""
        kind, rest = net.log_chances(self.weights, self.known[ids], lengths, int(self.known[-1]))
        kind = kind.astype(np.float64)
        inside = np.add.reduceat(kind + rest, starts) - kind[starts]
        after = np.append(kind[starts[1:]], 0)
        after[np.searchsorted(starts, np.cumsum(lengths) - 1)] = 0
        return inside + after

    def score(self, batch: pd.DataFrame) -> pd.DataFrame:
        """Per text its sums over frequent words, and the hashes and network's chances of the others."""
        lengths = np.array([len(i) // 2 for i in batch.ids], np.int64)
        ids = np.frombuffer(b"".join(batch.ids), np.uint16)
        starts = np.flatnonzero(self.first[ids])
        chance = self.word_chances(ids, lengths, starts)
        hashes = word_hashes(ids, starts)
        count = self.frequent(hashes)
        rare = count < 0
        begin = np.searchsorted(starts, np.cumsum(lengths) - lengths)
        sums = lambda x: np.add.reduceat(np.where(rare, 0, x), begin)
        seen = np.maximum(count, 0)
        both = np.log10(SHARE * np.exp(chance) + ((1 - SHARE) / max(1, self.total)) * seen + 1e-300)
        cuts = np.append(0, np.cumsum(rare))[np.append(begin, len(starts))]
        cut = lambda x: [x[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        new = {"n_tokens": np.diff(np.append(begin, len(starts))), "n_known": sums((count > 0).astype(np.int64)), "base": sums(np.log10(seen + ADD)), "score": sums(both), "hashes": cut(hashes[rare]), "chances": cut(chance[rare].astype(np.float32))}
        return pd.DataFrame({"uid": batch.key.to_numpy(), "doc_id": batch.doc_id.array, "held_out": batch.held_out.to_numpy()} | new)


def first_fit(sample: list[np.ndarray], id_counts: np.ndarray, first: np.ndarray) -> net.Weights:
    known = numbered(id_counts, first)
    flat = known[np.concatenate(sample)] if sample else np.empty(0, np.int64)
    return net.train(untrained(id_counts, first), flat, np.array([len(t) for t in sample], np.int64), int(known[-1]), batch=128)


def added(sums: DataFrame) -> DataFrame:
    """Rows (task, chunk, top, weight) added up by task and chunk. Rows of one pair follow each other, so a task holds one sum."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, None
        row = lambda: pd.DataFrame([(*now, *[t.astype(np.float32).tobytes() for t in total])], columns=["task", "chunk", "top", "weight"])
        for batch in batches:
            for task, chunk, top, weight in zip(batch.task, batch.chunk, batch.top, batch.weight, strict=True):
                both = np.stack([np.frombuffer(top, np.float32), np.frombuffer(weight, np.float32)]).astype(np.float64)
                if (task, chunk) == now:
                    total += both
                else:
                    if now:
                        yield row()
                    now, total = (task, chunk), both
        if now:
            yield row()

    dealt = sums.repartition("task", "chunk").sortWithinPartitions("task", "chunk", F.xxhash64("top", "weight"))
    return dealt.mapInPandas(add, "task int, chunk int, top binary, weight binary")


def by_task(encoded: DataFrame, shares: int, tasks: int) -> DataFrame:
    """encoded with its share and the task that learns it: each task's documents are one partition, share by share. Ranges, whose bounds are
    drawn from a sample, would give some partition two tasks' documents and another one none."""
    dealt = encoded.withColumn("share", F.pmod("order", F.lit(shares))).withColumn("task", F.pmod("share", F.lit(tasks)).cast("int"))
    return dealt.repartitionById(tasks, "task").sortWithinPartitions("task", "share", "order", "ids")


def learning_tasks(shares: int, cores: int) -> int:
    """As few tasks of SHARES_A_TASK shares at most as keep all cores busy to the end."""
    return min(shares, cores * -(-shares // (cores * SHARES_A_TASK)))


def fit_shares(encoded: DataFrame, w: net.Weights, known: np.ndarray, documents: int) -> net.Weights:
    """The weights after all documents (order, ids: subword ids as 16-bit numbers) have been learnt from, `documents` in all.

    Documents are dealt over shares by their order, a hash. A task learns some shares one after the other, each from w, and passes on one sum;
    sums are added FAN_IN at a time, level by level."""
    shares = -(-documents // SHARE_DOCS)
    if not shares:
        return w
    spark, vocab = encoded.sparkSession, len(known)
    shared = spark.sparkContext.broadcast((w, known))
    tasks = learning_tasks(shares, spark.sparkContext.defaultParallelism)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, known = shared.value
        before, now, state, task = net.flat(w), None, None, None
        top, weight = np.zeros(len(before)), np.zeros(len(before))

        def done() -> None:
            nonlocal top, weight
            state.learn()
            top += (state.adam.v - before) * state.adam.squares
            weight += state.adam.squares

        for batch in batches:
            for task, share, ids in zip(batch.task, batch.share, batch.ids, strict=True):  # noqa: B007
                if share != now:
                    if state:
                        done()
                    now, state = share, net.Share(w, int(known[-1]), documents / shares)
                state.add(known[np.frombuffer(ids, np.uint16)])
        if state:
            done()
            cut = range(0, len(before), CHUNK)
            parts = lambda x: [x[i : i + CHUNK].astype(np.float32).tobytes() for i in cut]
            yield pd.DataFrame({"task": task, "chunk": range(len(cut)), "top": parts(top), "weight": parts(weight)})

    sums, left = stored(by_task(encoded, shares, tasks).select("task", "share", "ids").mapInPandas(learn, "task int, chunk int, top binary, weight binary")), tasks
    while left > 1:
        left = -(-left // FAN_IN)
        more = stored(added(sums.withColumn("task", F.pmod("task", F.lit(left)))))
        drop(sums)
        sums = more
    flat = np.zeros_like(net.flat(w))
    for r in sums.collect():  # as many numbers as the network has, twice
        top, weight = np.frombuffer(bytes(r["top"]), np.float32), np.frombuffer(bytes(r["weight"]), np.float32)
        flat[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(top)] = np.divide(top, weight, out=np.zeros_like(top), where=weight > 0)
    drop(sums)
    return net.unflat(net.flat(w) + flat, w.begin, vocab)


_SCORED = "uid long, doc_id string, held_out boolean, n_tokens long, n_known long, base double, score double, hashes array<long>, chances array<float>"


def score_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, held_out (crc32(doc_id) mod 10 is 0; those teach nothing), n_tokens (words and one end), n_known (seen in
    training), train_tokens, base_score (smoothed word shares, log10) and score (the model's log10 probability of the whole text,
    as its words and the end).

    Needs doc_id and text; further columns are left out, whatever they are called. Null and empty texts are one end. Repeated rows
    repeat; without any training document every count is 0 and the network is as it starts; no rows give none."""
    spark, first = docs.sparkSession, begins(ranks_path, pattern)
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (remainder("doc_id", 10) == 0).alias("held_out"))
    # Ids pass through Python as text: there, numbers with nulls among them would lose digits.
    rows = split.select(F.monotonically_increasing_id().alias("uid"), F.xxhash64("doc_id", "text").alias("order"), F.col("doc_id").cast("string").alias("doc_id"), "held_out", "text")
    read = stored(read_texts(rows, ranks_path, pattern), "kind")
    texts = read.filter(F.col("kind") == TEXT)
    counts = stored(read.filter(F.col("kind") == WORD).groupBy(F.col("key").alias("hash")).agg(F.sum("n").alias("n")))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    id_counts = np.zeros(len(first))
    for r in read.filter(F.col("kind") == ID).groupBy("key").agg(F.sum("n").alias("n")).collect():  # at most as many rows as the tokenizer has ids
        id_counts[r["key"]] = r["n"]
    head = most_frequent(counts, HEAD).toPandas()

    # About TRAIN_DOCS training documents for the first fit; their subword ids are what reaches the driver.
    training = texts.filter("NOT held_out").select(F.col("n").alias("order"), "ids")
    n_docs = training.count()
    place = F.pmod(F.xxhash64("order", F.lit(13)), F.lit(1 << 30))
    chosen = training.filter(place < int((1 << 30) * min(1.0, TRAIN_DOCS / max(1, n_docs)))).limit(2 * TRAIN_DOCS)
    sample = [np.frombuffer(bytes(r["ids"]), np.uint16) for r in chosen.collect()]
    known = numbered(id_counts, first)
    weights = fit_shares(training, first_fit(sample, id_counts, first), known, n_docs)
    shared = spark.sparkContext.broadcast(Scorer(weights, known, first, (head["hash"].to_numpy(np.int64), head["n"].to_numpy(float)), total, distinct))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cuts = np.flatnonzero(np.diff(np.cumsum([len(i) // 2 for i in batch.ids]) // AT_ONCE)) + 1
            for part in np.split(np.arange(len(batch)), cuts):
                if len(part):
                    yield shared.value.score(batch.iloc[part])

    scored = stored(texts.select("key", "doc_id", "held_out", "ids").mapInPandas(score, _SCORED).withColumn("doc_id", F.col("doc_id").cast("long")))
    drop(read)
    scale = float(total + ADD * (distinct + 1))
    rare = scored.select("uid", F.explode(F.arrays_zip("hashes", "chances")).alias("w")).select("uid", F.col("w.hashes").alias("hash"), F.col("w.chances").cast("double").alias("chance"))
    met = joined_counts(rare, counts)
    share = F.col("n") / float(max(1, total))
    both = F.when(F.col("n") > 0, F.log10(SHARE * F.exp("chance") + (1 - SHARE) * share)).otherwise(F.col("chance") * float(np.log10(np.e)) + float(np.log10(SHARE)))
    met = met.groupBy("uid").agg(F.sum((F.col("n") > 0).cast("long")).alias("more_known"), F.sum(F.log10(F.col("n") + ADD)).alias("more_base"), F.sum(both).alias("more_score"))
    whole = scored.select("uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score").join(met, "uid", "left")
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    base = add("base", "more_base") - F.col("n_tokens") * float(np.log10(scale))
    return whole.select("doc_id", "held_out", "n_tokens", add("n_known", "more_known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), add("score", "more_score").alias("score"))


def joined_counts(rare: DataFrame, counts: DataFrame) -> DataFrame:
    """rare (uid, hash, chance) with the count n of each hash, 0 where training has none.

    A word that only held-out texts have may still be frequent there: hashes that make up a thousandth of `rare` each, a thousand at
    most, meet their counts by a broadcast; the others are spread over many keys."""
    n = rare.count()
    often = rare.groupBy("hash").count().filter(F.col("count") * 1000 > n).select("hash")
    hot = stored(often.join(counts, "hash", "left").select("hash", F.coalesce("n", F.lit(0)).alias("n")))
    few = F.broadcast(hot)
    cold = rare.join(F.broadcast(hot.select("hash")), "hash", "left_anti").join(counts, "hash", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rare.join(few, "hash").unionByName(cold) if not hot.isEmpty() else cold
