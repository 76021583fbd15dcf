"""Prompts for questions and anomaly analysis, and batch completion with an injected client."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from meterwise.functions import constants as K
from meterwise.functions import expressions as X
from meterwise.functions import wording as T
from meterwise.operators.operations import waiting_fixes

_CONTEXT = ("warehouse_name", "anomaly_type", "severity", "credits_wasted", "status")

Complete = Callable[[list[str]], list[str]]


def _text_table(rows: Column) -> Column:
    """Right-aligned text table of a small array of structs, header first."""

    def cells(name: str) -> Column:
        values = F.transform(rows, lambda row: row[name].cast("string"))
        return F.concat(F.array(F.lit(name.upper())), values)

    def padded(name: str) -> Column:
        width = F.array_max(F.transform(cells(name), F.length))
        return F.transform(cells(name), lambda text: F.lpad(text, width, F.lit(" ")))

    lines = padded(_CONTEXT[0])
    for name in _CONTEXT[1:]:
        lines = F.zip_with(lines, padded(name), lambda left, right: F.concat_ws(" ", left, right))
    return F.array_join(lines, "\n")


def question_context(anomalies: DataFrame, limit: int = 15) -> DataFrame:
    """One row: the newest anomalies as a text table and the credits of the resolved ones among them.

    Only ``limit`` rows reach the single task that builds the text.
    """
    newest = (
        anomalies.select("anomaly_id", "detected_at", *_CONTEXT)
        .orderBy(F.desc("detected_at"), F.desc("anomaly_id"))
        .limit(limit)
    )
    entry = F.struct("detected_at", "anomaly_id", *_CONTEXT)
    saved = F.coalesce(F.sum(F.when(F.col("status") == K.RESOLVED, F.col("credits_wasted"))), F.lit(0))
    rows = F.sort_array(F.collect_list(entry), asc=False)
    return newest.agg(rows.alias("rows"), F.count(F.lit(1)).alias("row_count"), saved.alias("credits_saved")).select(
        "row_count", _text_table(F.col("rows")).alias("table"), "credits_saved"
    )


def question_prompts(questions: DataFrame, anomalies: DataFrame, limit: int = 15) -> DataFrame:
    """Add to each ``question`` the prompt that answers it from the newest anomalies."""
    context = question_context(anomalies, limit)
    return questions.withColumn(
        "prompt",
        T.fill(
            T.QUESTION_PROMPT,
            table=context.select("table").scalar(),
            rate=F.lit(str(K.CREDIT_RATE)),
            saved=context.select(X.decimal_text(F.col("credits_saved"), 2)).scalar(),
            question=F.col("question"),
        ),
    )


def analysis_prompts(anomalies: DataFrame, audit_log: DataFrame) -> DataFrame:
    """(anomaly_id, prompt) for every anomaly whose fix waits for approval."""
    return waiting_fixes(anomalies, audit_log).select(
        "anomaly_id",
        T.fill(
            T.ANALYSIS_PROMPT,
            warehouse=F.col("warehouse_name"),
            kind=F.col("anomaly_type"),
            severity=F.col("severity"),
            credits=X.decimal_text(F.col("credits_wasted"), 4),
            description=F.col("description"),
            fix=F.col("proposed_fix"),
        ).alias("prompt"),
    )


def complete_batch(
    prompts: DataFrame, make_client: Callable[[], Complete], prompt: str = "prompt", response: str = "response"
) -> DataFrame:
    """Add a response to every prompt.

    ``make_client`` runs once per task and returns a function from a list of prompts to their responses; calls carry
    one Arrow batch each. A lost task calls again for its rows, so write the result before using it more than once.
    """
    schema = T_.StructType([*prompts.schema.fields, T_.StructField(response, T_.StringType())])

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        complete = make_client()
        for batch in batches:
            yield batch.assign(**{response: complete(batch[prompt].tolist())})

    return prompts.mapInPandas(answer, schema)
