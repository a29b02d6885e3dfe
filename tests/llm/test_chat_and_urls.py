import hashlib
import math
import re
from collections import Counter

import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latentspark.llm import chat_format as chat
from latentspark.llm import url_filter as urls

nasty = st.lists(st.sampled_from(["\\", "### ", "###", "#", "</turn>", "<|image:0|>", "<|", ": ", ":", "\n", "é", "a", "Assistant"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(nasty | st.text(max_size=8), nasty | st.text(max_size=30))
def test_turns_read_back(role, text):
    segment, start, end, found = chat.format_turn(role, [{"type": "text", "text": text}])
    assert chat.read_turn(segment)[:2] == (role, text) and chat.unescape(segment[start:end]) == text and not found


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(nasty, nasty | st.text(max_size=9)), max_size=5), st.integers(1, 9))
def test_conversations_are_parsed_from_their_text(turns, step):
    """Whatever the pieces that the text comes in."""
    text = "".join(chat.format_turn(role, [{"type": "text", "text": t}])[0] for role, t in turns)
    assert chat.read_turns(text) == turns
    d = chat._Digest("c")
    for at in range(0, len(text), step):
        d.add(text[at : at + step], None, None)
    assert d.row()[1:3] == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()) and d.row()[5] == len(text)


def test_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} </turn> \\ é " * (20_000 if i == 7 else 3)) for i in range(3000)]
    out = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out["n_turns"] == 3000 and out["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for _, _, r, t in rows))
    assert out["loss_sha256"] == sha("".join(t for _, i, _, t in rows if i % 2))


def test_parts_in_order():
    parts = [{"type": "text", "text": "see <|image:0|>"}, {"type": "image", "ref": "a.png", "width": 56, "height": 29}, {"type": "audio", "ref": "b", "seconds": 2.0}, {"type": "document", "ref": "c", "pages": 3}, {"type": "video", "ref": "d"}]
    segment, start, end, found = chat.format_turn("user", parts)
    assert segment[start:end] == "see \\<|image:0|><|image:0|><|audio:1|><|document:2|><|file:3|>"
    assert [(a["position"], a["kind"], a["ref"], a["n_tokens"]) for a in found] == [(0, "image", "a.png", 4), (1, "audio", "b", 25), (2, "document", "c", 1536), (3, "file", "d", 1)]


def test_conversations(spark):
    rows = [(1, 1, "assistant", "yes </turn>"), (1, 0, "user", None), (1, 2, "assistant", ""), (2, 0, "assistant", "a\\b"), (None, 0, None, "x"), (3, 0, "user", "q"), (3, 0, "user", "q"), (3, None, "system", "s")]
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out[1]["turns_sha256"] == sha("user\n\nassistant\nyes </turn>\nassistant\n\n") and out[1]["n_turns"] == 3
    assert (out[1]["loss_chars"], out[1]["loss_sha256"]) == (11, sha("yes </turn>"))
    assert out[2]["loss_sha256"] == sha("a\\b") and out[3]["turns_sha256"] == sha("system\ns\nuser\nq\nuser\nq\n") and out[None]["n_turns"] == 1
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_typed_parts_in_spark(spark):
    part = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    rows = [(1, 0, "user", [("text", "look: ", None, None, None, None, None), ("image", None, "i1", 28, 28, None, None)], 9), (1, 1, "assistant", None, 9)]
    got = chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>, segment int")).orderBy("turn").collect()
    assert got[0]["segment"] == "### user: look: <|image:0|></turn>\n" and got[0]["expanded_tokens"] == 1 and got[0]["loss_start"] is None
    assert got[1]["char_start"] == len(got[0]["segment"]) and got[1]["loss_start"] == got[1]["loss_end"]


CASES = [
    ("https://A.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2#a/es/", "example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("ftp://x.com/fr/é", "x.com", "/fr/é", "com/fr/", "allow"),
    ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    ("http://x.org", "x.org", "", None, None),
    ("http://x.org?://y.com/de/", "x.org", "", None, None),
    ("no scheme.org/", "", "", None, None),
    (None, "", "", None, None),
    ("", "", "", None, None),
    ("://", "", "", None, None),
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, c[0], "<title>the red fox</title>", "x") for i, c in enumerate(CASES)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in urls.filter_urls(pages).collect()}
    assert len(got) == len(CASES)
    for i, (_, host, path, rule, verdict) in enumerate(CASES):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert urls.filter_urls(pages.limit(0)).count() == 0


def test_viterbi_equals_brute_force():
    words = {"red": 50, "fox": 40, "re": 5, "d": 3, "box": 30, "o": 2, "redf": 1}
    seg = urls.Segmenter(words, sum(words.values()))

    def every(label):
        return [[label]] + [[label[:i], *rest] for i in range(1, len(label)) for rest in every(label[i:])]

    cost = lambda parts: sum(seg.cost.get(p, seg.unknown[len(p)]) for p in parts)
    for label in ("redfox", "redbox", "oxred", "zzred", "foxd"):
        assert abs(cost(seg.split(label)) - min(map(cost, every(label)))) < 1e-9
    assert seg.split("redfox") == ["red", "fox"] and seg.split("") == []


def test_title_words_are_whole(spark):
    html = ["<TITLE lang='de'>Donaudampfschifffahrtsgesellschaft a</title >", "<html><title>\nRed\nfox</title><title>no</title>", "<titles>none</titles>", None, "x"]
    titles = spark.createDataFrame([(h,) for h in html], "html string").select(urls.title_of(F.col("html")).alias("title"))
    assert {r["word"]: r["n"] for r in urls.word_counts(titles).collect()} == {"donaudampfschifffahrtsgesellschaft": 1, "a": 1, "red": 1, "fox": 1}


def plain_p_block(pages, cells):
    """Counts, segmentation and naive Bayes url by url."""
    words = Counter(w for _, _, html in pages for t in re.findall(r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", html or "")[:1] for w in regex.findall(r"\p{L}+", t.lower()))
    seg = urls.Segmenter({w: n for w, n in words.items() if len(w) <= urls.LONGEST}, sum(words.values()))

    def cells_of(host, path):
        out = [f"t:{host.split('.')[-1]}"] if host else []
        for kind, text in (("h", ".".join(host.split(".")[:-1])), ("p", path.lower())):
            for run in regex.findall(r"\p{L}+|\p{Nd}+", text):
                out += [f"{kind}:{len(run)}#"] if run[0].isdigit() else [f"{kind}:{w}" for w in seg.split(run)]
        return [(xxhash.xxh64_intdigest(t, 42) ^ (1 << 63)) - (1 << 63) for t in out]

    seen, classes, parts = {"block": Counter(), "allow": Counter()}, Counter(), {}
    for page_id, url, _ in pages:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        parts[page_id] = (max(fits)[1] if fits else None, [c % cells for c in cells_of(host, path)])
        if fits:
            classes[max(fits)[1]] += 1
            seen[max(fits)[1]].update(parts[page_id][1])
    out = {}
    for page_id, (rule, own) in parts.items():
        odds = math.log((classes["block"] + 1) / (classes["allow"] + 1))
        for c in own:
            odds += math.log((seen["block"][c] + 1) / (seen["block"].total() + cells)) - math.log((seen["allow"][c] + 1) / (seen["allow"].total() + cells))
        out[page_id] = None if rule else 1 / (1 + math.exp(-odds))
    return out


@pytest.mark.parametrize("words,cells", [(50_000, 1 << 16), (0, 97)])
def test_naive_bayes_equals_plain_counts(spark, words, cells):
    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    pages += [(9001, "http://" + "redfox" * 60 + ".net/" + "a" * 300 + "/12/É", None), (9002, None, "<title>x y</title>"), (9003, "http://redfox.net/x", "<title>red red fox</title>"), (9004, "://", ""), (9004, "://", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS uid", "'x' AS unit", "2 AS n")
    got = urls.filter_urls(df, cells=cells, max_words=words).collect()
    want = plain_p_block(pages, cells)
    assert len(got) == len(pages) and any(p is not None for p in want.values())
    for r in got:
        p = want[r["page_id"]]
        assert r["p_block"] == (p if p is None else pytest.approx(p, rel=1e-6))
        assert p is None or r["verdict"] == ("block" if p > 0.5 else "allow")


def test_naive_bayes_learns_from_rules(spark):
    rows = [(i, f"http://s{i % 3}.example.com/{'de' if i % 2 else 'fr'}/{i}", None) for i in range(60)] + [(100, "http://a.net/de/7", None), (101, "http://a.net/fr/7", None)]
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).filter("page_id >= 100").collect()}
    assert got == {100: "block", 101: "allow"}
