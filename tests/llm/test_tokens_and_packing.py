import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from latentspark.llm import decontaminate, jaccard_join, lm_score, packing, token_counts
from latentspark.llm.queries import pack_whole

WORD = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(WORD)
BYTE = public_tokenizers.path("byte_bpe_50k.json")
pieces = st.sampled_from(["the", " ", "isn't", "'LL", "\n", "é", "É", "é", "Σ", "ς", "中文", "12", "½", "<|endoftext|>", "<|startoftext|>", "?!", "\x1c", "\xa0", "　", "İ", "ß", "👍🏽", "x" * 40])


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces | st.text(max_size=3), max_size=25).map("".join))
def test_transducer_counts_as_the_library(text):
    assert token_counts.counter(WORD).count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_chunks_compose(monkeypatch):
    text = "ab cdéé " * 30 + "x" * 50 + " isn't  ok\n" * 9
    whole = token_counts.counter(WORD).count(text)
    for size in (1, 2, 7, 33):
        monkeypatch.setattr(token_counts, "CHUNK", size)
        assert token_counts.counter(WORD).count(text) == whole


def test_memory_limit_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO", 3)
    text = "many different words, some of them twice: many different words"
    for _ in range(3):
        assert token_counts.counter(WORD).count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_all_code_points_in_pairs():
    rng = random.Random(7)
    often = [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x1FC00), *range(0xE0000, 0xE0200)]
    points = often + [i for i in range(0x110000) if i % 37 == 0 and not 0xD800 <= i < 0xE000]
    points = [chr(p) for p in points]
    rng.shuffle(points)
    texts = [a + b for a, b in zip(points, points[1:], strict=False)] + [p + rng.choice(["a", "1", "!", "'", "'s", "\u0301", " "]) + rng.choice(points) for p in points]
    assert token_counts.counter(WORD).counts(texts) == [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("text", ["=" * 40_000 + "!" + "=" * 40_000, "ab" * 60_001, "!?" * 70_000, "é" * 50_001, "lo" * 100 + "the" * 40_000])
def test_long_runs(text):
    assert token_counts.counter(WORD).count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_a_run_of_a_million_letters_takes_few_rounds(monkeypatch):
    rng, rounds = random.Random(1), []
    block = "".join(rng.choice("etaoinshrdlu") for _ in range(50_021))
    text = block * 20
    own = token_counts.Transducer.run
    monkeypatch.setattr(token_counts.Transducer, "run", lambda self, *a: rounds.append(len(a[1])) or own(self, *a))
    assert token_counts.counter(WORD).count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)
    assert len(rounds) < 12 and sum(rounds[2:]) < 3 * len(text) / token_counts.CHUNK


def test_pairs_stay_as_the_merges_leave_them():
    t, rng = token_counts.counter(WORD).transducer, random.Random(3)
    tokens = sorted(t.tokens)
    inner = [x for x in tokens if not x.endswith(token_counts.END)]

    def merged(symbols):
        while len(symbols) > 1:
            rank, i = min((t.merges.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 60:
                break
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    for _ in range(3000):
        left, right = rng.choice(inner), rng.choice(tokens)
        last = -2 if right.endswith(token_counts.END) else -1
        assert t.stay(left, right) == (t.makes(left) and merged([*left, *right[:last], right[last:]]) == [left, right])


def test_texts_are_cut_at_white_space(monkeypatch):
    texts = ["a b\nc" * 50, "", "x" * 90 + " y", "isn't it " * 9, "<|endoftext|>" * 3 + "é b" * 20]
    whole = token_counts.counter(WORD).counts(texts)
    monkeypatch.setattr(token_counts, "AT_ONCE", 16)
    assert token_counts.counter(WORD).counts(texts) == whole == [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_count_columns(spark):
    docs = spark.createDataFrame([(1, "hello world", 5), (2, None, 6), (3, "", 7), (3, "", 7), (4, "é " * 3000, 8)], "doc_id long, text string, n_tokens long")
    got = [tuple(r) for r in token_counts.count_tokens(docs, WORD).drop("text").orderBy("doc_id").select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()]
    assert got == [(1, 11, 2, False), (2, 0, 0, False), (3, 0, 0, False), (3, 0, 0, False), (4, 9000, 3000, True)]
    assert token_counts.count_tokens(docs.limit(0), WORD).count() == 0


def one_at_a_time(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, room in enumerate(bins) if room >= n]
        if fit:
            i = min(fit, key=lambda i: bins[i])
            bins[i] -= n
        else:
            bins.append(capacity - n)
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=120), st.sampled_from([32, 37, 64]))
def test_runs_are_best_fit_decreasing(lengths, capacity):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    used, placed = defaultdict(list), defaultdict(int)
    for length, a, b, first, per_bin, base in packing.best_fit_runs(histogram, capacity):
        for nth in range(b - a):
            used[first + nth // per_bin].append((base + nth % per_bin * length, length))
        placed[length] += b - a
    assert placed == histogram
    for spans in used.values():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in s) for s in used.values()) == sorted(one_at_a_time(lengths, capacity))


def test_packing_query(spark):
    texts = [None, "", "short", "A <|endoftext|> b", "mot é 中文 " * 900, "same", "same", "word " * 1023, "word " * 1022]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(5, "same", "x"), (None, "no id", "x")]
    got = pack_whole(spark.createDataFrame(rows, "doc_id long, text string, offset string")).collect()
    library = Tokenizer.from_file(BYTE)
    seen = defaultdict(list)
    for r in got:
        seen[r["sequence_id"]].append((r["offset"], r["length"]))
        if r["doc_id"] is not None:
            ids = [*library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
            part = ids[r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)) == r["ids_crc32"]
            assert r["length"] == 1024 or (r["piece"] == 0 and r["length"] == (len(ids) % 1024 or 1024))
    for spans in seen.values():
        assert [s for s, _ in sorted(spans)] == [sum(n for _, n in sorted(spans)[:i]) for i in range(len(spans))]
        assert sum(n for _, n in spans) <= 1024
    assert sum(r["doc_id"] == 5 for r in got) == 2 and sum(r["doc_id"] is None for r in got) == 1
    assert pack_whole(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "don't  stop\n\n x", "   é"])
def test_special_strings(spark, text):
    library = Tokenizer.from_file(BYTE)
    got = pack_whole(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    ids = [*library.encode(text, add_special_tokens=False).ids, 2]
    assert got["length"] == len(ids) and got["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_large_ids_stay_beside_nulls(spark):
    big = (1 << 62) + 1
    docs = spark.createDataFrame([(big, "five words are one shingle"), (None, "x"), (big + 2, "five words are one shingle")], "doc_id long, text string").coalesce(1)
    ids = {big, None, big + 2}
    assert {r["doc_id"] for r in pack_whole(docs).collect()} == ids
    near = jaccard_join.near_duplicates(docs).collect()
    assert {r["doc_id"] for r in near} == ids and {r["class_id"] for r in near} == {big, None}
    assert {r["doc_id"] for r in decontaminate.find_leaks(docs, docs.selectExpr("1L AS item_id", "text")).collect()} == ids
    assert {r["doc_id"] for r in lm_score.score_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()} == ids
