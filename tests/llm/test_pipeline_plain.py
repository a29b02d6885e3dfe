"""The whole pipeline against a version in plain Python, with nulls, empty texts, copies, ties and columns of clashing names."""

import random
import zlib
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, row string, key string, text_key long, score double, label int"


def shingle_set(text, size=5):
    words = ["".join(c for c in w.lower() if c.isalnum()) for w in (text or "").split()]
    words = [w for w in words if w]
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()


def fixture(seed=5):
    """(doc_id, text, lang) of two languages with alphabets of their own, and benchmark items."""
    rng = random.Random(seed)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(3, 7)))
    alphabets = {"aa": "abcdefgh", "zz": "рстуфхцч"}
    text = lambda lang, n: " ".join(word(alphabets[lang]) for _ in range(n))
    rows = [(i, text(lang := "aa" if i % 3 else "zz", rng.choice((4, 30, 120))), lang) for i in range(90)]
    items = [text("aa", n) for n in (3, 8, 20, 60)] + [None, "", "!?"]
    for i in range(100, 130):  # near copies on both sides of the threshold
        words = rows[i - 100][1].split()
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = word(alphabets[rows[i - 100][2]])
        rows.append((i, " ".join(words), rows[i - 100][2]))
    rows += [(200 + i, rows[7][1], "aa") for i in range(40)]  # a group of exact copies
    for i in range(300, 324):  # items, whole or with words changed, inside documents
        item = items[i % 4].split()
        for _ in range(i % 5 // 2):
            item[rng.randrange(len(item))] = word("abcdefgh")
        rows.append((i, f"{text('aa', 40)} {' '.join(item).upper()} {text('aa', 30)}", "aa"))
    rows += [(400, None, "aa"), (401, "", "zz"), (402, "12 ½ !?", None), (403, text("aa", 3000), "aa"), (404, text("zz", 2500), None)]
    rows += [(405, text("aa", 50), None)] * 3 + [(None, text("zz", 60), "zz")]
    rng.shuffle(rows)
    return rows, list(enumerate(items))


def plain_pipeline(rows, items):
    """Pieces (doc_id, piece, start, length, ids_crc32), and how many sequences one-at-a-time packing takes."""
    rows = list({(d, t) for d, t, _ in rows if any(c.isalpha() for c in t or "")})
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    rows = [r for i, r in enumerate(rows) if root(i) == i]

    def leaks(text):
        for _, item in items:
            q = shingle_set(item)
            if q and len(q & shingle_set(text, len(next(iter(q))))) >= 0.8 * len(q) - 1e-9:
                return True
        return False

    rows = [(d, t) for d, t in rows if not leaks(t)]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, room = [], []
    for doc_id, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        edges = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            pieces.append((doc_id, i, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))))
    for n in sorted((p[3] for p in pieces), reverse=True):
        fit = [i for i, r in enumerate(room) if r >= n]
        if fit:
            room[min(fit, key=lambda i: room[i])] -= n
        else:
            room.append(1024 - n)
    return pieces, len(room)


def written(spark, folder, rows, items):
    docs = spark.createDataFrame([(d, t, lang, "s", "r", "k", 1, 0.5, 2) for d, t, lang in rows], COLUMNS)
    docs.repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_pipeline_equals_the_plain_one(spark, tmp_path):
    rows, items = fixture()
    docs = written(spark, tmp_path, rows, items)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want, sequences = plain_pipeline(rows, items)
    order = lambda p: (p[0] is None, p[0] or 0, *p[1:])
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got], key=order) == sorted(want, key=order)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(places) == sequences
    for spans in places.values():
        spans.sort()
        assert [at for at, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= 1024
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.schema == docs.schema
    assert kept.filter("doc_id = 405").count() == 1 and kept.filter("doc_id IS NULL").count() == 1


def test_pipeline_of_nothing(spark, tmp_path):
    written(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
