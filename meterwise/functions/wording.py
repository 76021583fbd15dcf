"""Message templates and the helper that fills them with columns."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterwise.functions import constants as K

# --- fixed values: texts that stored rows must carry word for word --------------------------------
IDLE_DESCRIPTION = (
    "Warehouse {warehouse} was running but idle from {start} to {end}. Cloud services credits consumed: {credits}"
)
IDLE_SUGGESTION = (
    "Consider reducing AUTO_SUSPEND timeout or suspending warehouse {warehouse} during off-hours. "
    "Current idle cost: {credits} credits/hour."
)
SPIKE_DESCRIPTION = (
    "Warehouse {warehouse} cost spike detected at {start}. Used {used} credits vs {average} rolling avg "
    "({ratio}x normal)."
)
SPIKE_SUGGESTION = (
    "Investigate queries running on {warehouse} between {start}-{end}. Consider: "
    "(1) Check QUERY_HISTORY for long-running queries, (2) Review warehouse auto-scaling config, "
    "(3) Set STATEMENT_TIMEOUT_IN_SECONDS to cap runaway queries."
)

IDLE_SCAN_AUDIT = "Idle compute scan completed. Lookback: {parameter} hours. New anomalies found: {rows}"
IDLE_FULL_SCAN_AUDIT = "Idle compute scan (DEMO) completed. New anomalies found: {rows}"
SPIKE_SCAN_AUDIT = "Cost spike scan (DEMO) completed. Threshold: {parameter}x. New anomalies found: {rows}"
IDLE_SCAN_RESULT = "Idle compute detection complete. {rows} new anomalies logged."
IDLE_FULL_SCAN_RESULT = "Demo idle compute detection complete. {rows} new anomalies logged."
SPIKE_SCAN_RESULT = "Cost spike detection complete. {rows} new anomalies logged."

IDLE_FIX = "ALTER WAREHOUSE {warehouse} SET AUTO_SUSPEND = 60;"
IDLE_FIX_DETAILS = (
    "Reducing AUTO_SUSPEND to 60s for {warehouse} to prevent idle compute waste. "
    "Estimated savings: {credits} credits/hour."
)
SPIKE_FIX = "ALTER WAREHOUSE {warehouse} SET STATEMENT_TIMEOUT_IN_SECONDS = 3600;"
SPIKE_FIX_DETAILS = (
    "Setting statement timeout on {warehouse} to prevent runaway queries. Spike was {credits} credits above baseline."
)
NO_FIX = "-- No automated fix available for: {kind}"
NO_FIX_DETAILS = "Unknown anomaly type. Manual investigation required."
FIX_SUMMARY = "Fix application complete. Auto-applied: {applied}, Pending approval: {pending}"

APPROVAL_DETAILS = "Human approved fix for anomaly {anomaly}. Approved by: {approver}"
APPROVAL_RESULT = "Fix approved and applied for anomaly {anomaly} by {approver}"
APPROVAL_MISSING = "No pending approval found for anomaly ID {anomaly}"

RESUME_FIX = "ALTER WAREHOUSE {warehouse} SET AUTO_RESUME = TRUE;"
OVERSIZE_FIX = "-- Review WAREHOUSE_LOAD_HISTORY for {warehouse}"

# --------------------------------------------------------------------------------------------------------------

# Our own wording, for the parts that have no stored text to match.
ALERT_PROMPT = (
    "A user describes in words when they want to be notified. Turn the sentence below into one JSON object and write "
    "nothing else. Its members are metric (one of: " + ", ".join(K.ALERT_METRICS) + "), threshold (a number), "
    "warehouse (a name, or " + K.ANY_WAREHOUSE + " where the sentence names none) and condition (one of: "
    + ", ".join(K.ALERT_CONDITIONS) + ").\nSentence: {rule}"
)
QUESTION_PROMPT = (
    "{question}\n\nUse these figures and nothing else. A credit costs {rate} dollars. Fixes have saved {saved} credits "
    "up to now. The latest anomalies are:\n{table}\nGive amounts, and say what to change first."
)
ANALYSIS_PROMPT = (
    "Explain this warehouse cost anomaly: give the likely root cause, a recommended action and the impact.\n"
    "Warehouse: {warehouse}\nType: {kind}\nSeverity: {severity}\nCredits wasted: {credits}\n"
    "Description: {description}\nProposed fix: {fix}"
)
APPROVAL_NAMELESS = "The approval of anomaly {anomaly} names nobody"
OUTBOX_SUBJECT = "[{severity}] {kind} on {warehouse}"
OUTBOX_BODY = "{description} Suggested: {suggestion}"
NOTICE_TITLES = {
    "APPROVAL_NEEDED": "Approval needed for {warehouse}",
    "APPROVED": "Fix approved for {warehouse}",
    "WARNING": "Cost spike fixed on {warehouse}",
    "INFO": "Fix applied on {warehouse}",
}


def fill(template: str, **values: Column) -> Column:
    """Concatenate the template's text with the columns named by its ``{placeholders}``; null if any is null."""
    parts: list[Column] = []
    for text, field, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if field:
            parts.append(values[field].cast("string"))
    return F.concat(*parts)
