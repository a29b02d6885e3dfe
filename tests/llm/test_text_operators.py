import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

from latentspark.llm import common, decontaminate, jaccard_join, langid
from latentspark.llm.components import components
from latentspark.llm.shingles import WordHashes, shingles


def word_set(text, size=5):
    words = ["".join(c for c in w.lower() if c.isalnum()) for w in (text or "").split()]
    words = [w for w in words if w]
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()


def planted(seed=0, base=60):
    """Random texts, copies, near copies on both sides of 0.8, a large near group, a passage that many share, odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [" ".join(word() for _ in range(rng.randint(5, 80))) for _ in range(base)]
    passage = " ".join(word() for _ in range(60))
    texts += [f"{passage} {' '.join(word() for _ in range(rng.randint(20, 60)))}" for _ in range(40)]
    near = texts[3].split() + [word() for _ in range(100)]
    for i in range(60):
        copy = list(near)
        copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    for t in texts[:20]:
        w = t.split()
        w[len(w) // 2] = word()
        texts += [" ".join(w), t.upper() + "!"]
    texts += ["", None, "!!!", "one", "One.", "two words", "two words", texts[5], texts[5]]
    rng.shuffle(texts)
    return texts


def expected(texts, threshold=0.8):
    sets = [word_set(t) for t in texts]
    links, parent = Counter(), list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (root(i), links[i]) for i in range(len(texts))}


@pytest.mark.parametrize("small,block,share", [(128, 128, 4096), (6, 16, 30)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, small, block, share):
    for name, value in (("SMALL", small), ("BLOCK", block), ("SHARE", share)):
        monkeypatch.setattr(jaccard_join, name, value)
    texts = planted()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, node int").repartition(4)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == expected(texts)


@pytest.mark.parametrize("small", [0, 10, 500])
def test_large_buckets_connect_what_all_pairs_connect(monkeypatch, small):
    """Sets around a common passage, near copies in a chain, and others; leaders against all pairs."""
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    rng = np.random.default_rng(5)
    least, width = 0.62, jaccard_join.SKETCH
    common = rng.integers(0, 256, width, dtype=np.uint8)
    rows = []
    for _ in range(250):
        row = rng.integers(0, 256, width, dtype=np.uint8)
        share = rng.random(width) < rng.choice([0.5, 0.75])
        row[share] = common[share]
        rows.append(row)
    for _ in range(150):  # each a copy of an earlier one, some of it new
        row = rows[rng.integers(0, len(rows))].copy()
        new = rng.random(width) < 0.25
        row[new] = rng.integers(0, 256, new.sum(), dtype=np.uint8)
        rows.append(row)
    sketches, nodes = np.array(rows), rng.permutation(1000)[: len(rows)]

    def parts(edges):
        label = {int(n): int(n) for n in nodes}
        for _ in range(len(nodes)):
            old = dict(label)
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
            if label == old:
                return label

    agree = (sketches[:, None] == sketches[None]).mean(2) >= least
    assert parts(jaccard_join._bucket_edges(nodes, sketches, least)) == parts([(int(nodes[i]), int(nodes[j])) for i, j in zip(*np.nonzero(agree), strict=True)])


def test_bitmap_loses_no_member(spark, monkeypatch):
    monkeypatch.setattr(common, "BITMAP", 2)
    rows = spark.createDataFrame([(None if i == 7 else i, f"t{i % 5}", "x") for i in range(300)], "a long, b string, _word string")
    members = rows.filter("a % 50 = 3 OR a IS NULL")
    asked, plain = common.maybe_in(rows, members, ["a", "b"])
    got = [r["a"] for r in asked.collect()]
    assert {None, 3, 53, 103, 153, 203, 253} <= set(got) and asked.columns == plain.columns == rows.columns
    assert len(got) + plain.count() == 300 and plain.count() > 100


def test_near_duplicates_without_ids(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join(words[:30] + ["other"] + words[31:])
    docs = spark.createDataFrame([(None, " ".join(words)), (9, " ".join(words)), (7, near), (None, "alone")], "doc_id long, text string")
    got = sorted((r["class_id"] or 0, r["n_links"]) for r in jaccard_join.near_duplicates(docs).collect())
    assert got == [(0, 0), (7, 2), (7, 2), (7, 2)]
    assert sorted(r["doc_id"] or 0 for r in jaccard_join.deduplicate(docs).collect()) == [0, 7]


def test_deduplicate_keeps_one_and_all_columns(spark):
    rows = [(2, "a b c d e f", "x"), (1, "a b c d e f!", "y"), (3, None, "z"), (4, None, None), (None, "other words", "n"), (5, "twice the same", "t"), (5, "twice the same", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string")
    got = jaccard_join.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in got.collect()))) == ["1", "3", "4", "5", "None"]
    assert jaccard_join.deduplicate(docs.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    b = np.concatenate([a[:1600], rng.integers(0, 2**63, 400, dtype=np.uint64)])
    true = 1600 / 2400
    assert abs((jaccard_join.signature(a) == jaccard_join.signature(b)).mean() - true) < 0.2
    assert (jaccard_join.signature(np.tile(a, 5)) == jaccard_join.signature(a)).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 200), (5, 4)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200}


def test_shingles():
    w = WordHashes()
    assert len(shingles(w.of("a b c d e f"))) == 2 and len(shingles(w.of("a b"))) == 1 and not len(shingles(w.of("?! ,")))
    assert (shingles(w.of("A, b. c! d e")) == shingles(w.of("a b c d e"))).all()


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    items = [" ".join(word() for _ in range(n)) for n in (1, 2, 4, 5, 6, 9, 20, 40, 40, 70, 150)] + [None, "", "??"]
    texts = [None, "", "a"]
    for k in range(120):
        words = [word() for _ in range(rng.choice((3, 50, 400)))]
        if k % 2:
            item = items[k % 11].split()
            for _ in range(k % 7):
                item[rng.randrange(len(item))] = word()
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() + "," for w in item]
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(3, texts[3], 0), (None, texts[4], 0)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    want = Counter()
    for doc_id, text in [*enumerate(texts), (3, texts[3]), (None, texts[4])]:
        n_words = [w for w in (text or "").split()]
        for item_id, item in enumerate(items):
            q = word_set(item)
            if q and len(n_words) >= (size := len(next(iter(q)))):
                shared = len(q & word_set(text, size))
                if shared >= 0.8 * len(q) - 1e-9:
                    want[doc_id, item_id, len(q), shared] += 1
    for limit in (20_000, 3):
        monkeypatch.setattr(decontaminate, "ITEMS", limit)
        got = Counter((r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in decontaminate.find_leaks(docs, bench).collect())
        assert got == want
        clean = decontaminate.decontaminate(docs, bench)
        bad = {d for d, *_ in want}
        assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {*range(len(texts)), None} - bad
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0 and decontaminate.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_codewords_are_apart():
    for k in (2, 3, 4, 6, 9, 30):
        c = langid.codewords(k)
        gaps = [(c[i] != c[j]).sum() for i in range(k) for j in range(i)]
        assert min(gaps) >= 1 and len(c) == k and (k < 3 or min(gaps) >= 2)


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


K = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


def plain_cells(text):
    """Every n-gram of every run of letters, one at a time."""
    out, low = [], (1 << 32) - 1
    for run in regex.findall(r"\p{L}+", text.lower()):
        p = [32, *map(ord, run), 32]
        for i in range(1, len(p) - 1):
            a, b, c = p[i - 1] * K[0] & low, p[i] * K[1] & low, p[i + 1] * K[2] & low
            out += [b * K[2], (a ^ b) * K[1] + 1, (a ^ b ^ c) * K[0] + 2]
        out.append(((p[-2] * K[0] & low) ^ (p[-1] * K[1] & low)) * K[1] + 1)
    return [((h ^ (h >> 15)) * K[1] & low) >> 20 for h in (x & low for x in out)]


def plain_judgement(model, text):
    cells = plain_cells(text or "")
    if not cells:
        return "und", 0.0, None, True
    margins = [sum(model.weights[c][b] for c in cells) / len(cells) + model.bias[b] for b in range(len(model.bias))]
    losses = [sum(r * math.exp(-max(-3, min(3, m)) * bit) for r, m, bit in zip(model.reliability, margins, code, strict=True)) for code in model.codes]
    odds = [math.exp(-model.sharpness * x) for x in losses]
    order = sorted(range(len(odds)), key=lambda i: losses[i])
    chances = [odds[i] / sum(odds) for i in order]
    return model.languages[order[0]], chances[0], model.languages[order[1]], chances[0] - chances[1] < 0.2


def test_language_id_equals_plain_decoding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs.filter(langid.remainder("doc_id", 4) != 2))
    odd = spark.createDataFrame([(-1, "½ ①"), (-2, "² Ⅷ"), (-3, "_ 12 \u0301"), (-4, "中文 ǅ ª x1y"), (-5, "le the der el"), (-6, "İ x\ny " * 20_000), (-7, None)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").limit(60).unionByName(odd)
    got = langid.predict(rows, model).collect()
    assert len(got) == 67
    for r in got:
        lang, score, second, ambiguous = plain_judgement(model, r["text"])
        assert (r["lang_pred"], r["runner_up"], r["ambiguous"]) == (lang, second, ambiguous) and r["score"] == pytest.approx(score, rel=1e-6)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (-1, -2, -3, -7)} == {"und"}


def test_both_forms_of_the_fit_agree(spark, monkeypatch):
    """By rows and by cells: the weights of the ridge regression are the same."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    few = langid.fit(docs)
    monkeypatch.setattr(langid, "ROWS_FORM", 10)
    np.testing.assert_allclose(langid.fit(docs).weights, few.weights, atol=2e-3 * np.abs(few.weights).max())
    monkeypatch.setattr(langid, "IN_ALL", 40)
    assert len(langid.fit(docs).languages) == 4


def test_language_id_edges(spark):
    rows = [(i, t, lang, "x") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 20)] + [(100, None, "en", "x"), (101, "", None, "x"), (102, "123 !?", "fr", "x"), (None, "the dog", None, "x"), (103, "the cat " * 5000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = defaultdict(list)
    for r in langid.identify_languages(docs).collect():
        got[r["doc_id"]].append(r)
    assert [got[i][0]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and got[None][0]["lang_pred"] == "en" == got[103][0]["lang_pred"]
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {*range(40), None, 103}
    unlabelled = langid.identify_languages(docs.withColumn("lang", docs["lang"].substr(9, 0)).withColumn("lang", langid.F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}
    assert langid.identify_languages(docs.limit(0)).count() == 0


def test_leaks_beyond_one_index_and_ids_of_any_type(spark, monkeypatch):
    docs = spark.createDataFrame([("a", "x one two three four five six y"), ("b", "nothing here"), (None, "one two three four five six " * 20_000)], "doc_id string, text string")
    items = spark.createDataFrame([("i1", "one two three four five six"), ("i2", "w" * 400), (None, "three four five six y")], "item_id string, text string")
    want = {("a", "i1"), ("a", None), (None, "i1")}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, items).collect()} == want
    monkeypatch.setattr(decontaminate, "BYTES", 100)
    assert decontaminate.one_index(items, 5, 0.8) is None
    got = decontaminate.find_leaks(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and got.schema["item_id"].dataType == items.schema["item_id"].dataType
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()] == ["b"]


def test_runs_reach_the_recall_or_say_so():
    for threshold in (0.7, 0.8, 0.9, 1.0):
        runs = jaccard_join.runs_for(0.999, threshold)
        assert runs <= jaccard_join.SKETCH // jaccard_join.DEPTH and 1 - (1 - threshold**jaccard_join.DEPTH) ** runs >= 0.999
    with pytest.raises(ValueError, match="runs"):
        jaccard_join.runs_for(0.999, 0.5)
