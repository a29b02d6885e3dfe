"""What several operators share: tables, durable intermediate results, ranks in groups."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The application's folder below spark.checkpoint.dir. Where none is set, a local session gets a temporary folder; elsewhere
    that is an error, as executors would not share it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="latentspark-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame, *partitions: str) -> DataFrame:
    """The rows written once as Parquet to the shared folder (in folders by `partitions`) and read again: lineage ends here,
    and a lost executor costs no recomputation of what lies before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored/{uuid.uuid4().hex}"
    df.write.partitionBy(*partitions).parquet(path)
    out = spark.read.schema(_nullable(df.schema)).parquet(path)
    out.stored_at = path
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes tables that `stored` gave, once nothing reads them any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def ranked(df: DataFrame, keys: list[str], order: list, name: str, buckets: int | None = None) -> DataFrame:
    """Adds the 0-based rank of a row in its group, gapless in each group.

    A group is dealt over `buckets` (by default four for each shuffle partition, 256 at least) by a hash of the order columns, ranked in each bucket, and the
    buckets' sizes give each bucket its first rank; no task holds a whole group. Rows equal in all
    order columns are interchangeable. The order within a group is by (bucket, order)."""
    buckets = buckets or max(256, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_bucket")) - F.col("_n")
    starts = sizes.select(*keys, "_bucket", before.alias("_start"))
    local = dealt.withColumn("_local", F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order)) - 1)
    return local.join(starts, [*keys, "_bucket"]).withColumn(name, F.col("_start") + F.col("_local")).drop("_bucket", "_start", "_local")


#: 64-bit words of the bitmap that `maybe_in` broadcasts: some 2 MB, whatever the tables' size.
BITMAP = 1 << 17


def maybe_in(rows: DataFrame, members: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows split in two without a shuffle: those whose keys may be among the members', and those whose keys are not. Null keys equal
    each other. The more members there are for the bitmap, the more rows may be among them."""
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in keys])
    word, bit = F.pmod(F.shiftright(h, 6), F.lit(BITMAP)).cast("int"), F.pmod(h, F.lit(64)).cast("int")
    bits = members.select(word.alias("_word"), bit.alias("_bit")).distinct()
    words = stored(bits.groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits")))
    tested = rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(words), "_word", "left")
    there = F.coalesce(F.expr("shiftrightunsigned(_bits, _bit) & 1L") == 1, F.lit(False))
    return tuple(tested.filter(side).select(*rows.columns) for side in (there, ~there))


def hot_join(rows: DataFrame, ones: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows joined with their one row of `ones`, which holds `key` and how many rows share it. Keys of more than a thousandth of
    all rows, a thousand at most, are broadcast; the others are spread by a shuffle."""
    hot = F.col(weight) * 1000 > total
    often = F.broadcast(ones.filter(hot))
    cold = rows.join(F.broadcast(ones.filter(hot).select(key)), key, "left_anti").join(ones.filter(~hot), key)
    return rows.join(often, key).unionByName(cold)


def most_frequent(counts: DataFrame, size: int, n: str = "n") -> DataFrame:
    """Rows of counts with the largest n, `size` at most.

    Rows fall into some hundred classes of n; classes are taken whole while they fit, and of the next one as many
    as there is room for, by a hash of the row. A histogram decides that, so no task sends its own best rows to the driver."""
    level = F.floor(F.log2(F.col(n)) * 16).cast("int")
    place = F.pmod(F.xxhash64(*counts.columns), F.lit(1 << 30))
    least, room = None, size
    for r in counts.filter(F.col(n) > 0).groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if r["count"] > room:
            whole = counts.filter((F.col(n) > 0) & (level > r["level"]))
            return whole.unionAll(counts.filter((F.col(n) > 0) & (level == r["level"]) & (place < int((1 << 30) * room / r["count"]))).limit(room))
        least, room = r["level"], room - r["count"]
    return counts.limit(0) if least is None else counts.filter((F.col(n) > 0) & (level >= least))
