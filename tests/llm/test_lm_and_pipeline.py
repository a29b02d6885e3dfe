import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from latentspark.llm import attention_lm as net
from latentspark.llm import decontaminate, jaccard_join, lm_score
from latentspark.llm.common import ranked, table

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


VOCAB, BEGIN = 512, 300


def test_gradient_is_right():
    rng = np.random.default_rng(0)
    w = net.Weights(BEGIN, {k: v.astype(np.float64) + rng.normal(0, 0.1, v.shape) for k, v in net.initial(np.ones(VOCAB), BEGIN).items()})
    win = next(net.windows(rng.integers(0, VOCAB, 100), np.array([60, 40]), 5))
    g, _ = net.gradient(w, win.inputs, win.targets, win.scored)
    for k in w:
        at = np.unravel_index(np.abs(g[k]).argmax(), w[k].shape)
        old, e, seen = w[k][at], 1e-5, []
        for step in (e, -e):
            w[k][at] = old + step
            seen.append(net.gradient(w, win.inputs, win.targets, win.scored)[1])
        w[k][at] = old
        assert (seen[0] - seen[1]) / (2 * e) == pytest.approx(g[k][at], rel=1e-4)


def trained(seed=1):
    rng = np.random.default_rng(seed)
    return net.train(net.initial(np.ones(VOCAB), BEGIN), rng.integers(0, VOCAB, 3000), np.array([1000, 2000]), 0), rng


def test_chances_sum_to_one_and_see_only_the_past():
    w, rng = trained()
    tokens = rng.integers(0, VOCAB, 90)
    last = [[x[-1] for x in net.log_chances(w, np.append(tokens, t), np.array([91]), 0)] for t in range(VOCAB)]
    kind, rest = np.exp(np.array(last)).T
    assert (kind * rest).sum() == pytest.approx(1, abs=1e-4)
    for own in (slice(0, BEGIN), slice(BEGIN, VOCAB)):
        assert rest[own].sum() == pytest.approx(1, abs=1e-4) and np.ptp(kind[own]) < 1e-5
    assert kind[0] + kind[-1] == pytest.approx(1, abs=1e-5)
    changed = tokens.copy()
    changed[50:] = 3
    a, b = (np.sum(net.log_chances(w, t, np.array([90]), 0), 0) for t in (tokens, changed))
    np.testing.assert_allclose(a[:50], b[:50], atol=1e-5)


def test_chances_of_all_words_sum_to_one():
    """Of all words of up to two ids, and all longer ones by the chance that a word of two ids goes on; after some words."""
    small, begin, end = 9, 5, 4  # id 4 is a text's end
    rng = np.random.default_rng(2)
    w = net.train(net.initial(np.ones(small), begin), rng.integers(0, small, 3000), np.array([3000]), end)
    first = np.arange(small) < begin
    scorer = lm_score.Scorer(w, np.arange(small), first, (np.empty(0, np.int64), np.empty(0)), 0, 0)
    scorer.known = np.append(np.arange(small), end)  # the last number is the start's

    def chance(words):
        """Of the last word but the end, and of its going on after its last id."""
        ids = np.array([i for word in words for i in word] + [end], np.uint16)
        starts = np.flatnonzero(first[ids])
        whole = np.exp(scorer.word_chances(ids, np.array([len(ids)]), starts))
        kind, _ = net.log_chances(w, ids.astype(np.int64), np.array([len(ids)]), end)
        return (whole[-2] if len(words) else 0), whole[-1], np.expm1(-kind[-1])  # odds of going on against ending

    for before in ([], [[0]], [[1, 6, 5], [2]] * 8):
        total = chance(before)[1]  # the end comes next
        for a in range(begin):
            if a == end:
                continue
            one, _, _ = chance([*before, [a]])
            total += one
            for b in range(begin, small):
                two, _, longer = chance([*before, [a, b]])
                total += two * (1 + longer)
        assert total == pytest.approx(1, abs=1e-3)


@pytest.mark.parametrize("lengths", [[1], [31, 32, 33], [28, 60, 61, 500]])
def test_windows_score_each_token_once(lengths):
    tokens = np.arange(sum(lengths))
    seen = np.concatenate([w.targets[w.scored] for w in net.windows(tokens, np.array(lengths), 0, part=3)])
    np.testing.assert_array_equal(seen, tokens)


def test_later_windows_see_eight_tokens_and_the_network_has_a_feed_forward_layer():
    win = next(net.windows(np.arange(200), np.array([200]), 0))
    assert win.scored[1:].any() and not win.scored[1:, :8].any()
    assert {"up", "up_b", "down"} <= set(net.initial(np.ones(VOCAB), BEGIN))


def test_context_alone_costs_keys_and_values_only_and_parts_change_nothing(monkeypatch):
    w, rng = trained()
    tokens, lengths = rng.integers(0, VOCAB, 700), np.array([300, 1, 33, 366])
    win = next(net.windows(tokens, lengths, 5))
    order, whole = net._whole_first(win.scored)
    assert whole == 4 and win.scored[order[:whole], 0].all() and not win.scored[order[whole:], :8].any()
    rows = order[whole:]
    part = net._Part(w, win.inputs[rows], win.scored[rows], 8)
    assert part.a.shape == (len(rows), 24, 32) and len(part.r) == len(part.z) == win.scored[rows].sum()
    want, loss = net.gradient(w, win.inputs, win.targets, win.scored)
    chances = np.array(net.log_chances(w, tokens, lengths, 5))
    assert loss == pytest.approx(-chances.sum() / len(tokens), rel=1e-5)
    monkeypatch.setattr(net, "PART", 3)
    monkeypatch.setattr(net, "ROWS", 7)
    monkeypatch.setattr(net, "AT_ONCE", 2)
    got, _ = net.gradient(w, win.inputs, win.targets, win.scored)
    for k in w:
        np.testing.assert_allclose(got[k], want[k], rtol=1e-3, atol=1e-6)
    np.testing.assert_allclose(np.array(net.log_chances(w, tokens, lengths, 5)), chances, atol=1e-5)


@pytest.mark.parametrize("step", [1 << 14, 1000])
def test_steps_are_those_of_adam(monkeypatch, step):
    monkeypatch.setattr(net, "STEP", step)
    w, rng = trained()
    adam, v, m, s, squares = net.Adam(w), net.flat(w).astype(float), 0, 0, 0
    for i in range(1, 61):
        win = next(net.windows(rng.integers(0, VOCAB, 200), np.array([200]), 0))
        grad = net.flat(net.gradient(adam.w, win.inputs, win.targets, win.scored)[0]).astype(float)
        adam.step(win, 0.01)
        m, s, squares = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2, squares + grad**2
        v -= 0.01 * min(1, i / 50) * m / (1 - 0.9**i) / (np.sqrt(s / (1 - 0.99**i)) + 1e-8)
    np.testing.assert_allclose(adam.squares, squares, rtol=1e-3, atol=1e-9)
    assert np.quantile(np.abs(adam.v - v), 0.999) < 1e-4 < np.abs(v - net.flat(w)).mean()


def test_ids_that_do_not_occur_take_no_step():
    rng = np.random.default_rng(2)
    w = net.initial(np.ones(20_000), 12_000)
    adam, before = net.Adam(w), net.flat(w).copy()
    for _ in range(3):
        tokens = rng.integers(0, 300, 2000)
        adam.step(next(net.windows(tokens, np.array([2000]), 0)), 0.01)
    assert not adam.grad.any() and 0 < sum(adam.met) < len(adam.met) / 2
    for part, met in enumerate(adam.met):
        at = slice(part * net.STEP, (part + 1) * net.STEP)
        assert met == (adam.v[at] != before[at]).any() == adam.squares[at].any()


def test_subwords_in_one_call():
    enc = lm_score._encoding(PATH, public_tokenizers.PATTERN)
    words = ["the", "don't", "\xa0", "a\xa0", "中文", "!!", "　x", "é", "\xa0", "\xa0"]
    ids = [np.frombuffer(i, np.uint16).tolist() for i in lm_score.Subwords(PATH, public_tokenizers.PATTERN).encode([w.encode() for w in words])]
    assert ids == [enc.encode_ordinary(" " + w) for w in words]
    first = lm_score.begins(PATH, public_tokenizers.PATTERN)
    assert all(np.flatnonzero(first[i]).tolist() == [0] for i in ids)


def check_scores(docs, got):
    words = {i: [*(t or "").encode().lower().split(), b""] for i, t in docs}
    train = Counter(w for i, _ in docs if zlib.crc32(str(i).encode()) % 10 for w in words[i])
    n, v = sum(train.values()), len(train)
    for r in got:
        ws = words[r["doc_id"]]
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in train for w in ws), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
    return train


def plain_log_chances(w, tokens, start):
    """The network token by token: windows of 32 that move by 24, plain softmaxes over all tokens."""
    w64 = {k: v.astype(float) for k, v in w.items()}
    e, of, _ = net.clusters(w)
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    out = []
    for at in range(len(tokens)):
        nth = 0 if at < 32 else -(-(at - 31) // 24)
        window = [start if i == 0 else tokens[i - 1] for i in range(24 * nth, at + 1)]
        x = w64["embed"][window] + w64["place"][: len(window)]
        q, k, v = np.split(x @ w64["qkv"], 3, axis=1)
        h = x[-1] + soft(k @ q[-1] / 4) @ v
        h = h + np.maximum(h @ w64["up"] + w64["up_b"], 0) @ w64["down"]
        cluster = soft(h @ w64["cluster"] + w64["cluster_b"])
        whole = np.empty(len(of))
        for c in range(len(e) - 1):
            whole[e[c] : e[c + 1]] = cluster[c] * soft(w64["inner"][e[c] : e[c + 1]] @ h + w64["inner_b"][e[c] : e[c + 1]])
        out.append((np.log(whole[: w.begin].sum()), np.log(whole[tokens[at]])))
    return out


def plain_score(w, known, begins, encoding, counts, total, text):
    words = [*(text or "").encode().lower().split(), b""]
    ids = [[*encoding.encode_ordinary(" " + x.decode())] if x else [encoding.n_vocab] for x in words]
    chances = plain_log_chances(w, [known[i] for x in ids for i in x], known[-1])
    at, out = 0, 0.0
    for word, own in zip(words, ids, strict=True):
        one = chances[at][1] - chances[at][0] + sum(c for _, c in chances[at + 1 : at + len(own)])
        at += len(own)
        one += chances[at][0] if at < len(chances) else 0
        out += math.log10(0.5 * math.exp(one) + 0.5 * counts[word] / total) if counts[word] else math.log10(0.5) + one / math.log(10)
    return out


@pytest.mark.parametrize("head", [1 << 17, 50, 0])
def test_scores(spark, monkeypatch, head):
    monkeypatch.setattr(lm_score, "HEAD", head)
    monkeypatch.setattr(lm_score, "AT_ONCE", 5000)
    if head < 100:
        monkeypatch.setattr(lm_score, "MEMO", 500)
    fitted = []
    own = lm_score.fit_shares
    monkeypatch.setattr(lm_score, "fit_shares", lambda *a: fitted.append((own(*a), a[2])) or fitted[0][0])
    docs = table(spark, SF, "documents").select("doc_id", "text")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, " \t\x0b"), (9004, "É é\xa0x"), (9005, "w" * 5000), (9006, "The the THE qqq qqq" + " onlyhere" * 400), (9007, "of a " * 30_000), (9002, "")], docs.schema)
    both = docs.unionByName(odd).withColumns({c: F.lit("x") for c in ("uid", "n", "hash", "kind", "ids", "score")})
    got = lm_score.score_documents(both, PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == both.count()
    rows = [(r["doc_id"], r["text"]) for r in both.collect()]
    train = check_scores(rows, got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    (w, known), = fitted
    encoding, texts = lm_score._encoding(PATH, public_tokenizers.PATTERN), dict(rows)
    few = [r for r in got if r["doc_id"] in (9001, 9004, 9005, 9006)] + sorted(got, key=lambda r: r["n_tokens"])[10:60:10]
    for r in few:
        assert r["score"] == pytest.approx(plain_score(w, known, lm_score.begins(PATH, public_tokenizers.PATTERN), encoding, train, sum(train.values()), texts[r["doc_id"]]), rel=1e-4, abs=1e-3)


def test_scores_of_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.score_documents(docs, PATH, public_tokenizers.PATTERN).count() == 0


def test_network_learns_from_all_documents_and_knows_all_ids(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "TRAIN_DOCS", 1)
    monkeypatch.setattr(lm_score, "SHARE_DOCS", 50)
    seen = []
    own = lm_score.fit_shares
    monkeypatch.setattr(lm_score, "fit_shares", lambda e, w, *rest: seen.append((w, own(e, w, *rest), e.count(), rest)) or seen[-1][1])
    encoding = lm_score._encoding(PATH, public_tokenizers.PATTERN)
    whole = [i for i in range(600, 5000) if encoding.decode([i])[:1] == " " and encoding.decode([i])[1:].isalpha() and encoding.decode([i]).islower()][:300]
    texts = [(i, "the cat" + encoding.decode([t]) * 3) for i, t in enumerate(whole)]  # each document has an id of its own
    lm_score.score_documents(spark.createDataFrame(texts, "doc_id long, text string"), PATH, public_tokenizers.PATTERN).collect()
    (first, last, rows, (known, n)), = seen
    assert rows == n > 200 and len(last["embed"]) == encoding.n_vocab + 1
    taught = known[[t for i, t in enumerate(whole) if zlib.crc32(str(i).encode()) % 10]]
    for k in ("embed", "inner"):
        assert (first[k][taught] != last[k][taught]).any(1).all()


def test_shares_in_tasks_and_levels_average_like_one_after_the_other(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARE_DOCS", 5)
    first = lm_score.begins(PATH, public_tokenizers.PATTERN)
    rng = np.random.default_rng(3)
    docs = [(int(order), rng.integers(0, len(first) - 1, 40).astype(np.uint16)) for order in rng.integers(0, 1 << 40, 60)]
    counts = np.ones(len(first))
    w, known = lm_score.untrained(counts, first), lm_score.numbered(counts, first)
    top, weight = np.zeros(len(net.flat(w))), np.zeros(len(net.flat(w)))
    for share in range(12):
        state = net.Share(w, int(known[-1]), 5)
        mine = sorted((order, ids.tobytes()) for order, ids in docs if order % 12 == share)
        for _, ids in mine:
            state.add(known[np.frombuffer(ids, np.uint16)])
        state.learn()
        top += (state.adam.v - net.flat(w)) * state.adam.squares
        weight += state.adam.squares
    want = net.flat(w) + np.divide(top, weight, out=np.zeros_like(top), where=weight > 0)
    encoded = spark.createDataFrame([(order, bytearray(ids.tobytes())) for order, ids in docs], "order long, ids binary").repartition(3)
    for fan_in in (64, 2):
        monkeypatch.setattr(lm_score, "FAN_IN", fan_in)
        got = net.flat(lm_score.fit_shares(encoded, w, known, len(docs)))
        assert np.abs(got - want).max() < 1e-6 < 4e-5 < np.abs(want - net.flat(w)).max()


def test_each_task_learns_from_a_partition_of_its_own(spark):
    docs = spark.range(3000).select(F.xxhash64("id").alias("order"), F.lit(b"xx").alias("ids"))
    for shares, tasks in ((57, 6), (7, 7), (90, 40)):
        dealt = lm_score.by_task(docs, shares, tasks).select(F.spark_partition_id().alias("at"), "task", "share")
        got = {(r["at"], r["task"]) for r in dealt.distinct().collect()}
        assert len(got) == len({at for at, _ in got}) == len({task for _, task in got}) == tasks and dealt.count() == 3000


def test_learning_keeps_all_cores_busy():
    """A task more than the cores would take as long alone as all others together."""
    for cores in (1, 6, 40):
        for shares in (1, 5, 97, 113, 677, 5000):
            tasks = lm_score.learning_tasks(shares, cores)
            most = -(-shares // tasks)
            assert most <= lm_score.SHARES_A_TASK and -(-tasks // cores) * most <= -(-shares // cores) + -(-tasks // cores)


def test_most_frequent_fills_the_last_class(spark):
    from latentspark.llm.common import most_frequent

    counts = spark.createDataFrame([(f"w{i}", 5) for i in range(600)] + [("top", 90), ("never", 0)], "word string, n long")
    got = [r["word"] for r in most_frequent(counts, 500).collect()]
    assert "top" in got and "never" not in got and 430 <= len(got) <= 500 and len(set(got)) == len(got)
    assert most_frequent(counts, 0).count() == 0 and most_frequent(counts, 1000).count() == 601


def test_ranks_are_gapless(spark):
    df = spark.createDataFrame([(i % 3, i // 2, "x") for i in range(200)], "g int, v int, rank string")
    got = ranked(df.drop("rank"), ["g"], ["v"], "rank", buckets=4).collect()
    for g in range(3):
        assert sorted(r["rank"] for r in got if r["g"] == g) == list(range(sum(r["g"] == g for r in got)))


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert kept.columns == docs.columns and docs.count() - kept.count() <= 3
    unique = corpus_pipeline.near_duplicates(spark, kept, SF)
    classes = {r["class_id"] for r in jaccard_join.near_duplicates(kept).collect()}
    assert {r["doc_id"] for r in unique.collect()} == classes
    clean = corpus_pipeline.decontamination(spark, unique, SF)
    leaks = {r["doc_id"] for r in decontaminate.find_leaks(unique, table(spark, SF, "benchmark")).collect()}
    assert leaks and {r["doc_id"] for r in clean.collect()} == classes - leaks
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == classes - leaks
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "packing"]
