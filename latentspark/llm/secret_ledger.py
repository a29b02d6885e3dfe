"""Secret scans with an incremental blob ledger.

Every version of every text is addressed by its content: the SHA-256 of its bytes. The ledger, a Parquet table in folders by rule, holds a row for each
blob and rule version that has been scanned, with the spans found (none, too). A scan takes the distinct blobs of the given versions, leaves
out the pairs of blob and rule version that the ledger has, scans the rest once each, adds their rows, and joins the findings of
all rules to every path that has such a blob. A rule whose pattern changes gets a new version, and only that is scanned again.

All of it is DataFrame expressions. A ledger row is complete by itself, so a run that was broken off leaves nothing wrong behind: what it
wrote counts, the rest is scanned by the next run. One run at a time writes to a ledger.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latentspark.llm.common import hot_join, stored


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of the pattern (Java's), of which those stay whose group `value` has `least` characters."""

    kind: str
    version: int
    pattern: str
    value: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}-v{self.version}"


#: The base rules come first; their spans are counted by kind. Runs of fewer than 24 hex digits, or of fewer than 20 characters from AKIA on, hold no
#: longer run, so their lengths are asked for in the pattern itself.
BASE = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
#: Tokens of code hosts, chat services and payment services, signed web tokens, and headers of private keys.
MORE = (
    Rule("host", 1, r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", 1, r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("signed", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE + MORE
LEDGER = "blob binary, spans array<struct<start:long,end:long>>, rule string"


def blob_of(text: Column) -> Column:
    """The address of a text; a null one is empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def pieces(text: Column, rule: Rule) -> Column:
    """Characters before each match (since the last one), in it and in its value, in order: an array of structs, without matches empty."""
    gaps = F.split(text, rule.pattern, -1)
    matched = lambda group: F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group))
    zipped = F.arrays_zip(gaps.alias("gap"), matched(0).alias("all"), matched(rule.value).alias("value"))
    lengths = F.transform(zipped, lambda z: F.struct(F.length(z["gap"]).cast("long").alias("gap"), F.length(z["all"]).cast("long").alias("all"), F.length(z["value"]).alias("value")))
    none = F.expr("cast(array() as array<struct<gap:bigint,all:bigint,value:int>>)")
    return F.when(text.rlike(rule.pattern), F.filter(lengths, lambda z: z["all"].isNotNull())).otherwise(none)


def scanned(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows of the ledger for blobs (blob, text, todo: names of the rules to scan)."""
    text = F.coalesce("text", F.lit(""))
    asked = F.array(*[F.when(F.array_contains("todo", r.name), F.struct(F.lit(r.name).alias("rule"), F.lit(r.least).alias("least"), pieces(text, r).alias("pieces"))) for r in rules])
    each = blobs.select("blob", F.explode(F.filter(asked, lambda a: a.isNotNull())).alias("a")).select("blob", "a.rule", "a.least", F.posexplode_outer("a.pieces").alias("at", "p"))
    # The end of a match is the sum of all gaps and matches so far. Rows lie by blob already; a blob's matches are as many as its text holds.
    end = F.expr("sum(p.gap + p.all) OVER (PARTITION BY blob, rule ORDER BY at)")
    spans = each.withColumn("end", end).select("blob", "rule", F.when(F.col("p.value") >= F.col("least"), F.struct((F.col("end") - F.col("p.all")).alias("start"), "end")).alias("span"))
    return spans.groupBy("blob", "rule").agg(F.array_sort(F.collect_list("span")).alias("spans")).select("blob", "spans", "rule")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; none where there is no ledger yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    rows = spark.range(0).select(F.expr("cast(null as binary)").alias("blob"), F.expr("cast(null as array<struct<start:bigint,end:bigint>>)").alias("spans"), F.lit("").alias("rule"))
    return spark.read.schema(LEDGER).parquet(path) if there else rows


def update_ledger(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scans what the ledger at `path` lacks of the texts of `versions` (text; any other columns) and adds it.

    Copies of one text are merged before and after the shuffle by blob, so no task gets them all."""
    spark = versions.sparkSession
    known = read_ledger(spark, path).filter(F.col("rule").isin([r.name for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("known"))
    every = F.array(*[F.lit(r.name) for r in rules])
    blobs = versions.select(blob_of(F.col("text")).alias("blob"), "text").dropDuplicates(["blob"]).join(known, "blob", "left")
    todo = F.array_except(every, F.coalesce("known", F.expr("cast(array() as array<string>)")))
    unseen = blobs.select("blob", "text", todo.alias("todo")).filter(F.size("todo") > 0)
    scanned(unseen, rules).write.mode("append").partitionBy("rule").parquet(path)


def findings(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """versions without their text, each with spans: array of (start, place of the rule in `rules`, kind, end), sorted, as the ledger at `path` has them for its blob.

    Paths of one blob may be any share of all rows: frequent blobs' rows are broadcast (a thousand at most, of together no
    more than a thousand times the mean text's spans), the others are spread by blob."""
    paths = stored(versions.withColumn("_blob", blob_of(F.col("text"))).drop("text"))
    copies = paths.groupBy("_blob").agg(F.count(F.lit(1)).alias("_n"))
    place = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)]), F.col("rule"))
    kind = F.element_at(F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.kind)]), F.col("rule"))
    seen = read_ledger(versions.sparkSession, path).filter(F.col("rule").isin([r.name for r in rules]) & (F.size("spans") > 0)).select(F.col("blob").alias("_blob"), place.alias("place"), kind.alias("kind"), "spans")
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("place").alias("place"), F.col("kind").alias("kind"), s["end"].alias("end")))
    found = seen.select("_blob", spans.alias("spans")).groupBy("_blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    none = F.expr("cast(array() as array<struct<start:bigint,place:int,kind:string,end:bigint>>)")
    ones = copies.join(found, "_blob", "left").withColumn("spans", F.coalesce("spans", none))
    return hot_join(paths, ones, "_blob", "_n", paths.count()).drop("_blob", "_n")


def scan_versions(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Updates the ledger at `path` and returns the findings of every row of versions (text and any other columns).

    Null texts count as empty and hold no secrets; repeated rows and ids stay, each with its findings; very long texts are scanned whole; an
    empty table gives no rows and leaves the ledger as it is. Other columns keep their names, except text and names with _blob, _n or spans."""
    update_ledger(versions, path, rules)
    return findings(versions, path, rules)


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base(spans: Column) -> Column:
    """The spans of the base rules, which come first among RULES."""
    return F.filter(spans, lambda s: s["place"] < len(BASE))
