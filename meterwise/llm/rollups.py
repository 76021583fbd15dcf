"""Token counts by source, language and tokenizer version, kept up by signed changes in batches that commit once.

A root folder holds a folder per committed batch with two tables: ``ledger``, the batch's signed rows (``doc``, ``source``,
``lang``, ``version``, ``n_tokens``, ``sign``), and ``totals``, their sums. Totals are additive, so reading them adds up small
tables and never the documents. A batch is written aside and renamed into place as its last step: a batch that fails
leaves nothing that is read, and one that is committed already is not applied again. The folder must be on a file system with an
atomic rename.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwise.llm.common import staged

KEY = ["source", "lang", "version"]
LEDGER = "doc string, source string, lang string, version string, n_tokens long, sign int"
TOTALS = "source string, lang string, version string, documents long, tokens long"
#: A run of anything but white space; a run of a-z, 0-9 and characters beyond ASCII in any case.
VERSIONS = {"runs-1": r"[^\x20\x09-\x0D]+", "words-2": r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"}


def counted(text: Column, version: str) -> Column:
    """Tokens of a text under a tokenizer version; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(VERSIONS[version])), F.lit(0)).cast("long")


def changes(docs: DataFrame, kind: str, version: str | None, n_tokens: Column | None, id: str = "doc_id", source: str = "source", lang: str = "lang") -> DataFrame:
    """A change per row of docs: kind is insert, revise or delete. A delete without a version takes all versions away."""
    return docs.select(
        F.col(id).cast("string").alias("doc"),
        F.col(source).cast("string").alias("source"),
        F.col(lang).cast("string").alias("lang"),
        F.lit(version).cast("string").alias("version"),
        (F.lit(0) if n_tokens is None else n_tokens).cast("long").alias("n_tokens"),
        F.lit(kind).alias("kind"),
    )


class TokenRollup:
    """The totals under a root folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self, path: str):
        jvm = self.spark.sparkContext._jvm
        held = jvm.org.apache.hadoop.fs.Path(path)
        return held.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), held

    def batches(self) -> list[str]:
        """Names of the committed batches' folders."""
        system, path = self._files(f"{self.root}/batches")
        return sorted(status.getPath().getName() for status in system.listStatus(path)) if system.exists(path) else []

    def _read(self, table: str, schema: str) -> DataFrame:
        paths = [f"{self.root}/batches/{name}/{table}" for name in self.batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def live(self) -> DataFrame:
        """What counts now: ``doc``, KEY and ``n_tokens``, the ledger's rows that no later sign took back."""
        entry = ["doc", *KEY, "n_tokens"]
        held = self._read("ledger", LEDGER).groupBy(*entry).agg(F.sum("sign").alias("sign"))
        return held.where("sign > 0").select(*entry)

    def signed(self, changed: DataFrame) -> DataFrame:
        """The signed rows that a batch of changes makes of what counts now.

        Of several changes to one document and version in a batch one holds: a delete before others, then the one with the
        largest count, source and language, so repeated rows do not matter. An insert or revision takes back what counts
        for its document and version and counts the new row; a delete only takes back. A change that changes nothing makes
        no rows. Changes without a document or kind, and inserts without a version, are left out; null sources and
        languages are groups of their own.
        """
        one = (
            changed.where("doc is not null and kind in ('insert', 'revise', 'delete') and (kind = 'delete' or version is not null)")
            .withColumn("__all", F.col("version").isNull())
            .groupBy("doc", "version", "__all")
            .agg(F.max(F.struct((F.col("kind") == "delete").alias("gone"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "source", "lang")).alias("c"))
            .select("doc", "version", "__all", "c.*")
        )
        one = staged(one, "changes")
        live = self.live()
        all_gone = one.where("__all").select("doc")
        stated = one.where("not __all")
        back = live.join(all_gone, "doc", "left_semi").unionByName(
            live.join(all_gone, "doc", "left_anti").join(stated.select("doc", "version"), ["doc", "version"], "left_semi")
        )
        new = stated.where("not gone").join(all_gone, "doc", "left_anti").select("doc", *KEY, "n_tokens")
        rows = back.withColumn("sign", F.lit(-1)).unionByName(new.withColumn("sign", F.lit(1)))
        return rows.groupBy("doc", *KEY, "n_tokens").agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0")

    def commit(self, batch: str, changed: DataFrame) -> bool:
        """Applies a batch under its name; False if a batch of that name was committed before."""
        name = quote(batch, safe="")
        if name in self.batches():
            return False
        aside = f"{self.root}/aside/{uuid.uuid4().hex}"
        self.signed(changed).write.parquet(f"{aside}/ledger")
        ledger = self.spark.read.schema(LEDGER).parquet(f"{aside}/ledger")
        sums = ledger.groupBy(*KEY).agg(F.sum("sign").alias("documents"), F.sum(F.col("sign") * F.col("n_tokens")).alias("tokens"))
        sums.write.parquet(f"{aside}/totals")
        system, target = self._files(f"{self.root}/batches/{name}")
        system.mkdirs(target.getParent())
        # A rename onto a folder that exists would go into it, so two writers of one batch must be told apart here.
        if system.exists(target):
            return False
        return system.rename(self._files(aside)[1], target)

    def totals(self) -> DataFrame:
        """``documents`` and ``tokens`` by source, language and version, groups without documents left out."""
        held = self._read("totals", TOTALS).groupBy(*KEY).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return held.where("documents <> 0 or tokens <> 0")
