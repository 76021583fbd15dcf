"""Versioned table snapshots in the shared folder.

A state change never rewrites files that a running query may read: every version goes to a directory of its own and
readers pick the newest one that carries Spark's ``_SUCCESS`` marker. A failed or repeated write of a version simply
overwrites that version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of steps that nothing reads any more."""
    place, fs = _file_system(spark, path)
    fs.delete(place, True)


def committed_versions(spark: SparkSession, root: str, table: str) -> list[int]:
    """Numbers of the completely written versions, ascending."""
    pattern, fs = _file_system(spark, f"{root}/{table}/version=*/_SUCCESS")
    found = fs.globStatus(pattern) or []
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found)


def write_version(df: DataFrame, root: str, table: str, version: int, cluster_by: Sequence[str] = ()) -> DataFrame:
    """Write one version and return it as read back, which cuts the lineage.

    ``cluster_by`` range-sorts the rows first, so that file and row-group statistics can skip most of the table for a
    filter on the first of these columns; the further ones let a range be cut where many rows share the first.
    """
    path = f"{root}/{table}/version={version}"
    if cluster_by:
        df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_version(
    spark: SparkSession, root: str, table: str, version: int | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """The given version, or the newest committed one; an empty table if there is none and a schema is given."""
    if version is None:
        versions = committed_versions(spark, root, table)
        if not versions:
            if schema is None:
                raise AnalysisException(f"no committed version of {table} under {root}")
            return spark.createDataFrame([], schema)
        version = versions[-1]
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{root}/{table}/version={version}")


def read_all_versions(
    spark: SparkSession, root: str, table: str, schema: T.StructType, before: int | None = None, since: int = 0, numbered: bool = False
) -> DataFrame:
    """All committed versions together, for tables that are appended to; optionally only those in a range of numbers.

    The version is a partition column of the files, so versions outside the range are not even listed as input; ``numbered`` keeps it.
    """
    versions = [v for v in committed_versions(spark, root, table) if v >= since and (before is None or v < before)]
    versioned = T.StructType([*schema.fields, T.StructField("version", T.LongType())])
    if not versions:
        return spark.createDataFrame([], versioned if numbered else schema)
    rows = spark.read.schema(versioned).parquet(f"{root}/{table}")
    rows = rows.filter(F.col("version").between(versions[0], versions[-1]))
    return rows if numbered else rows.drop("version")
