"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.llm.common import free_names, staged

#: A mean above this is drawn as a sum of independent parts, so that exp(-mean) stays far from underflow.
PART = 16.0
#: Of a Poisson distribution with a mean up to PART, less than 2^-70 lies above this.
HIGHEST = 96


def unit(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the parts alone: 52 bits of their MD5, exact as a double."""
    text = F.md5(F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p for p in parts)))
    return F.conv(F.substring(text, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cumulative(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... of a Poisson variable, as an array."""
    start = F.exp(-mean)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(HIGHEST)),
        F.struct(start.alias("p"), F.array(start).alias("c")),
        lambda s, k: F.struct(
            (s["p"] * mean / k).alias("p"),
            F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * mean / k)).alias("c"),
        ),
        lambda s: s["c"],
    )


def root_weights(docs: DataFrame, source: str = "source") -> DataFrame:
    """Target weights that grow with the square root of a source's rows, in whole thousandths."""
    return docs.groupBy(F.col(source).alias("source")).agg(
        F.round(F.sqrt(F.count(F.lit(1))) * 1000).cast("long").alias("weight")
    )


def repetition_rates(docs: DataFrame, weights: DataFrame, total: float | None = None, source: str = "source") -> DataFrame:
    """One row per source of docs: ``source``, ``parts`` (how many draws are added) and ``chances`` (of one draw).

    The mean number of times a document of a source is repeated is weight share * total / rows of the source; ``total``
    defaults to the rows of docs. Weights are shared among the sources that docs has. A source without a weight, or with
    one that is null or not positive, has the mean 0. A null source is a source like any other.
    """
    counts = docs.groupBy(F.col(source).alias("__source")).agg(F.count(F.lit(1)).alias("__n"))
    given = weights.groupBy(F.col("source").alias("__given")).agg(F.sum(F.greatest("weight", F.lit(0))).alias("__weight"))
    known = staged(
        counts.join(given, F.col("__source").eqNullSafe(F.col("__given")), "left").select(
            F.col("__source").alias("source"), F.col("__n").alias("n"), F.coalesce("__weight", F.lit(0)).alias("weight")
        ),
        "weights",
    )
    sums = known.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).first()
    wanted = float(sums["n"] or 0) if total is None else float(total)
    mean = F.col("weight") / F.lit(float(sums["weight"] or 1) or 1.0) * F.lit(wanted) / F.col("n")
    parts = F.greatest(F.ceil(F.col("mean") / PART), F.lit(1)).cast("int")
    return (
        known.withColumn("mean", mean)
        .withColumn("parts", parts)
        .select("source", "parts", cumulative(F.col("mean") / F.col("parts")).alias("chances"))
    )


def mix_sources(
    docs: DataFrame,
    weights: DataFrame,
    total: float | None = None,
    seed: str = "mixture",
    id: str = "doc_id",
    source: str = "source",
    partitions: int | None = None,
) -> DataFrame:
    """Each document as often as a Poisson variable says whose mean is its source's repetition rate, in shuffled order.

    ``weights`` has ``source`` and ``weight``. The variable is the inverse of the distribution at a number hashed from seed
    and id, so a retried task draws the same, and rows with the same id are repeated equally often. The result has all
    columns of docs, ``copy`` (from 1) and ``shuffle_key``; columns of docs with these two names are replaced. Rows are
    ordered by shuffle_key over all partitions. The key's range is known, so partitions are cut without sampling, and
    no source is ever brought together: hot sources cost what others cost.

    Only the rates are joined. They are a written table with a row per source, so Spark knows the size when it plans: it
    broadcasts them below its threshold, and otherwise joins by source and splits hot ones.
    Null ids are drawn like the id 'null'. No documents give no rows.
    """
    of, parts, chances, copies = free_names(docs, "source_of_rate", "parts", "chances", "copies")
    rates = staged(repetition_rates(docs, weights, total, source), "rates").select(
        F.col("source").alias(of), F.col("parts").alias(parts), F.col("chances").alias(chances)
    )
    kept = docs.drop("copy", "shuffle_key")
    key = F.coalesce(F.col(id).cast("string"), F.lit("null"))
    draw = F.aggregate(
        F.sequence(F.lit(1), F.col(parts)),
        F.lit(0),
        lambda n, part: n + F.size(F.filter(chances, lambda c: c <= unit(seed, part.cast("string"), key))),
    )
    drawn = (
        kept.join(rates, F.col(source).eqNullSafe(F.col(of)))
        .withColumn(copies, draw)
        .where(F.col(copies) > 0)
        .select(*kept.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias("copy"))
    )
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), key, F.col("copy").cast("string")))
    drawn = drawn.withColumn("shuffle_key", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.floor(F.col("shuffle_key") / F.lit(float(1 << 60)) * n).cast("int")
    return drawn.repartitionById(n, F.least(bucket, F.lit(n - 1))).sortWithinPartitions("shuffle_key", id, "copy")
