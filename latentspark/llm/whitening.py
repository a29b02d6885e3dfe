"""Embedding whitening from an exactly centred Gramian.

Vectors become integers, so sums are exact: n times a vector minus the sums of all is an exact integer vector, and that divided by n is centred
up to one rounding. MLlib's RowMatrix adds the outer products of these rows over the cluster; divided by n that is the covariance.
Its eigenvectors are found on the driver (features x features numbers) and sent to the tasks that whiten the rows.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.llm.common import drop, stored

#: Eigenvalues up to this share of the largest are rounding: their components cannot be whitened.
NONE = 1e-12
WHITE = "deviation string, whitened array<double>"


def integer_vectors(rows: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, x: floor(scale * component) as long, of the rows whose vector has components, all of them finite. Beyond 64 bits: an error."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    kept = rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(F.exists(vector, bad), F.lit(True)))
    scaled = lambda v: v.cast("double") * scale
    whole = lambda v: F.when(F.abs(scaled(v)) < 2.0**62, F.floor(scaled(v)).cast("long")).otherwise(F.raise_error(F.lit("a component is beyond 64 bits")).cast("long"))
    return kept.select("vec_id", F.transform(vector, whole).alias("x"))


def gramian(vectors: DataFrame, column: str, n: int, d: int) -> np.ndarray:
    """Sum of the outer products of an array<double> column."""
    rows = MLUtils.convertVectorColumnsFromML(vectors.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(rows, n, d).computeGramianMatrix().toArray()


def exact_sums(fit: DataFrame) -> tuple[int, np.ndarray]:
    """Number of vectors, and the sum of each component."""
    parts = fit.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("s"), F.count("*").alias("n")).orderBy("at").collect()  # a row a component
    if len({r["n"] for r in parts}) > 1:
        raise ValueError("vectors of unequal length")
    return (parts[0]["n"] if parts else 0), np.array([r["s"] for r in parts], np.int64)


def components_of(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; the largest entry of each is positive."""
    e, v = np.linalg.eigh(covariance)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    sign = np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return e, v * sign


def whitened_rows(rows: DataFrame, n: int, sums: np.ndarray, projection: np.ndarray) -> DataFrame:
    """Adds deviation (a whole number in decimal digits) and whitened (a number for each component; NaN where its column of the projection is)."""
    total, square = [int(s) for s in sums], sum(int(s) ** 2 for s in sums)
    shared = rows.sparkSession.sparkContext.broadcast((sums, projection))

    def whiten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, p = shared.value
        for batch in batches:
            x = np.stack(batch.x.to_numpy()) if len(batch) else np.empty((0, len(s)), np.int64)
            top = float(np.abs(x).max(initial=0)) * len(s)
            if top * max(top, float(np.abs(s).max(initial=0))) < 2.0**62:
                pairs = zip((x * x).sum(1).tolist(), (x @ s).tolist(), strict=True)
            else:
                pairs = ((sum(v * v for v in r), sum(v * t for v, t in zip(r, total, strict=True))) for r in x.tolist())
            # The sum of (n x - S)^2, multiplied out.
            deviation = [str(n * n * a - 2 * n * b + square) for a, b in pairs]
            yield batch.drop(columns="x").assign(deviation=deviation, whitened=list(((n * x - s) / n) @ p))

    others = [c for c in rows.columns if c != "x"]
    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in others)
    return rows.mapInPandas(whiten, kinds + WHITE)


def whiten(rows: DataFrame, vector: str = "embedding", scale: int = 256, most: int = 4) -> DataFrame:
    """Per row and component up to `most`: vec_id, component (from 1), n (distinct vectors, to which all is fitted), deviation (decimal, exact: the squared length of
    n x - S), whitened, explained (the component's share of all variance), identity_error (how far the covariance of the fitted vectors' whitened
    components is from the identity, at most).

    Needs vec_id and the vector; further columns are left out. Rows whose vector is null, empty or holds null or non-finite components are left
    out. Equal vectors count once for the fit and all get their rows; so do repeated ids and null ids. Fewer dimensions than `most` give fewer
    components. A component without variance (one distinct vector has none) is whitened to null, and no part of identity_error, which is null where there
    is none other; explained is null where nothing varies. Vectors of unequal length and sums beyond 64 bits are errors.
    Three scans of the distinct vectors, which are written once, and one of all rows; the only shuffle deals vectors to find the distinct ones."""
    vectors = integer_vectors(rows, vector, scale)
    spark, kind = rows.sparkSession, rows.schema["vec_id"].dataType.simpleString()
    fit = stored(vectors.select("x").distinct())
    n, sums = exact_sums(fit)
    d = len(sums)
    if n == 0:
        drop(fit)
        return spark.range(0).selectExpr(f"cast(null as {kind}) AS vec_id", "0 AS component", "id AS n", "cast(0 AS decimal(38,0)) AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error")
    # Exact in 64 bits, or Spark's own overflow error.
    centred = F.zip_with(F.col("x"), F.lit([int(s) for s in sums]), lambda a, s: (a * F.lit(n) - s).cast("double") / F.lit(float(n)))
    covariance = gramian(fit.select(centred.alias("c")), "c", n, d) / n
    e, v = components_of(covariance, most)
    real = e > max(NONE * e[0], 0.0)
    projection = v / np.sqrt(np.where(real, e, np.nan))

    error = None
    if k := int(real.sum()):
        seen = stored(whitened_rows(fit, n, sums, projection[:, :k]).select("whitened"))
        mean = [r["m"] for r in seen.select(F.posexplode("whitened").alias("at", "v")).groupBy("at").agg(F.avg("v").alias("m")).orderBy("at").collect()]
        again = seen.select(F.zip_with("whitened", F.lit(mean), lambda a, m: a - m).alias("c"))
        error = float(np.abs(gramian(again, "c", n, k) / n - np.eye(k)).max())
        drop(seen)
    drop(fit)

    trace = float(np.trace(covariance))
    share = F.lit([float(x) / trace if trace > 0 else None for x in e]).cast("array<double>")
    # Ids pass through Python as text: there, numbers with nulls among them would lose digits.
    done = whitened_rows(vectors.withColumn("vec_id", F.col("vec_id").cast("string")), n, sums, projection)
    long = done.select(F.col("vec_id").cast(kind).alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "white"))
    return long.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"),
        F.nanvl("white", F.lit(None).cast("double")).alias("whitened"),
        F.get(share, F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
