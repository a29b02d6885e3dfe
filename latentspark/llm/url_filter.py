"""URL filters: rules first, then a classifier over segmented words.

Host names are word chains without spaces. A unigram model of words, learnt from the titles of the pages,
splits each label by Viterbi; words of the host and of the path are the tokens of a multinomial naive Bayes
model that learns from the urls that rules decide and judges the others. Work is done once for each distinct run of letters:
segmentation, token weights and counts are those of runs, and pages meet their runs in a join.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentspark.llm.common import hot_join, stored

#: (verdict, host, path) of the production rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Up to so many title words the unigram model is sent to the executors; beyond it, runs meet the words that they hold in a join.
WORDS = 50_000
#: Longest word of a segmentation, and the cells of the hashed naive Bayes table (2 counts each), which bound the model's size.
LONGEST, CELLS = 20, 1 << 16
#: Rows that a task passes on at a time.
AT_ONCE = 100_000


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict), else null. Rules of equal length: the first by text."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def title_of(html: Column) -> Column:
    """The text of the first title element, in whatever case and with whatever attributes; empty without one."""
    return F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1)


def word_counts(titles: DataFrame) -> DataFrame:
    """word, n: whole words (runs of letters, lower-cased) of a string column named `title`, over all rows."""
    words = titles.select(F.explode(F.regexp_extract_all(F.lower("title"), F.lit(r"(\p{L}+)"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


class Segmenter:
    """Splits runs of letters into words; words: counts of words, total: of all words."""

    def __init__(self, words: dict[str, int], total: int):
        total = total or 1
        self.cost = {w: -math.log(n / total) for w, n in words.items()}
        # A chain of words costs more than a word of the model, an unknown one grows dearer with its length.
        self.unknown = [-math.log(10 / total) + n * math.log(10) for n in range(LONGEST + 1)]

    def split(self, run: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(run) + 1):
            options = ((best[start] + self.cost.get(run[start:end], self.unknown[end - start]), start) for start in range(max(0, end - LONGEST), end))
            cost, start = min(options)
            best.append(cost)
            back.append(start)
        out, end = [], len(run)
        while end:
            out.append(run[back[end] : end])
            end = back[end]
        return out[::-1]


def units_of(host: Column, path: Column) -> Column:
    """What a url is made of: its host's last label whole (t:), runs of letters of the other labels (h:) and of the path (p:), and
    for a run of digits its length (h:4#)."""

    def runs(kind: str, text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\p{Nd}+)"))
        return F.transform(found, lambda r: F.concat(F.lit(kind), F.when(r.rlike(r"^\p{Nd}"), F.concat(F.length(r).cast("string"), F.lit("#"))).otherwise(r)))

    last = F.when(host != "", F.array(F.concat(F.lit("t:"), F.element_at(F.split(host, r"\."), -1)))).otherwise(F.array().cast("array<string>"))
    return F.concat(last, runs("h:", F.regexp_replace(host, r"\.?[^.]*$", "")), runs("p:", F.lower(path)))


def segmented(runs: DataFrame, counts: DataFrame, total: int, limit: int) -> DataFrame:
    """run, words: each of the runs split by the unigram model of counts (word, n). Every word of the titles counts, however many
    there are: beyond `limit` a run meets those that it holds in a join."""
    usable = counts.filter(F.length("word") <= LONGEST)
    if usable.count() <= limit:
        words = runs.sparkSession.sparkContext.broadcast(Segmenter({r["word"]: r["n"] for r in usable.collect()}, total))

        @F.pandas_udf("array<string>")
        def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield batch.map(words.value.split)

        return runs.select("run", split("run").alias("words"))

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[str, str]] = []
        for batch in batches:
            for run in batch.run:
                for start in range(len(run)):
                    held += [(run, run[start:end]) for end in range(start + 1, min(len(run), start + LONGEST) + 1)]
                    if len(held) > AT_ONCE:
                        yield pd.DataFrame(held, columns=["run", "word"])
                        held = []
        yield pd.DataFrame(held, columns=["run", "word"])

    holds = stored(runs.select("run").mapInPandas(parts, "run string, word string").distinct())
    often = holds.groupBy("word").agg(F.count("*").alias("held"))
    met = hot_join(holds, often.join(usable, "word"), "word", "held", holds.count())
    own = met.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("model"))

    @F.pandas_udf("array<string>")
    def split_own(batch: pd.Series, models: pd.Series) -> pd.Series:
        return pd.Series([Segmenter(dict(m) if m is not None else {}, total).split(run) for run, m in zip(batch, models, strict=True)])

    return runs.select("run").join(own, "run", "left").select("run", split_own("run", "model").alias("words"))


def filter_urls(pages: DataFrame, rules=RULES, cells: int = CELLS, max_words: int = WORDS) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, p_block (the model's; null where a rule decides).

    Needs page_id and url; learns words from the titles in html where there is that column, else from nothing
    (then runs stay whole up to LONGEST letters). A null url, or one without ://, has empty host and path and no rule; null html has no
    title. Without any ruled url, all prior, the model allows; a tie allows too. Empty tables give no rows; repeated rows
    repeat; further columns are left out."""
    parts = pages.select(F.monotonically_increasing_id().alias("uid"), "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parts.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules)).select("uid", "page_id", "host", "path", "_r.rule", F.col("_r.verdict").alias("ruled"))
    urls = stored(ruled.withColumn("units", units_of(F.col("host"), F.col("path"))))
    titles = pages.select(title_of(F.col("html")).alias("title")) if "html" in pages.columns else pages.select(F.lit("").alias("title")).limit(0)
    counts = stored(word_counts(titles))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    # Each distinct unit once: how often it is met in all, and in urls that rules block and allow.
    met = urls.select("uid", "rule", "ruled", F.explode("units").alias("unit"))
    times = met.groupBy("unit").agg(F.count_if(F.col("rule").isNull()).alias("n"), F.count_if(F.col("ruled") == "block").alias("block"), F.count_if(F.col("ruled") == "allow").alias("allow"))
    units = stored(times.withColumn("run", F.when(F.col("unit").rlike(r"^[hp]:\p{L}"), F.substr("unit", F.lit(3)))))
    words = segmented(units.filter("run IS NOT NULL").select("run").distinct(), counts, total, max_words)
    tokens = F.when(F.col("run").isNull(), F.array("unit")).otherwise(F.transform("words", lambda w: F.concat(F.substr("unit", F.lit(1), F.lit(2)), w)))
    units = stored(units.join(words, "run", "left").select("unit", "n", "block", "allow", F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(cells)).cast("int")).alias("cells")))

    classes = {r["ruled"]: r["count"] for r in urls.filter("rule IS NOT NULL").groupBy("ruled").count().collect()}
    # At most `cells` rows come back, whatever the number of urls.
    seen = np.zeros((2, cells))
    for r in units.filter("block + allow > 0").select("block", "allow", F.explode("cells").alias("cell")).groupBy("cell").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).collect():
        seen[:, r["cell"]] = r["allow"], r["block"]
    chance = np.log((seen + 1) / (seen.sum(1, keepdims=True) + cells))
    prior = math.log((classes.get("block", 0) + 1) / (classes.get("allow", 0) + 1))
    weight = urls.sparkSession.sparkContext.broadcast(chance[1] - chance[0])

    @F.pandas_udf("double")
    def odds_of(cell_lists: pd.Series) -> pd.Series:
        return pd.Series([float(weight.value[np.asarray(c, dtype="int64")].sum()) for c in cell_lists], dtype="float64")

    weighed = stored(units.filter("n > 0").select("unit", "n", odds_of("cells").alias("odds")))
    open_ = met.filter("rule IS NULL").select("uid", "unit")
    odds = hot_join(open_, weighed, "unit", "n", open_.count()).groupBy("uid").agg(F.sum("odds").alias("odds"))
    judged = urls.join(odds, "uid", "left").withColumn("odds", F.coalesce("odds", F.lit(0.0)) + prior)
    p = F.when(F.col("rule").isNull(), 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), "odds")))))
    verdict = F.coalesce("ruled", F.when(F.col("p_block") > 0.5, "block").otherwise("allow"))
    return judged.withColumn("p_block", p).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "p_block")
