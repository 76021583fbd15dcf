"""Names, thresholds and rates that results depend on."""

from __future__ import annotations

from decimal import Decimal

# --- fixed values ---------------------------------------------------------------------------------------------
IDLE_COMPUTE = "IDLE_COMPUTE"
COST_SPIKE = "COST_SPIKE"

LOW, MEDIUM, HIGH, CRITICAL = "LOW", "MEDIUM", "HIGH", "CRITICAL"
AUTO_FIX_SEVERITIES = (LOW, MEDIUM)
URGENT_SEVERITIES = (HIGH, CRITICAL)

OPEN, RESOLVED, ACKNOWLEDGED, DISMISSED = "OPEN", "RESOLVED", "ACKNOWLEDGED", "DISMISSED"
UNRESOLVED = (OPEN, ACKNOWLEDGED)

DETECTION, AUTO_ACTION, RECOMMENDATION, USER_ACTION = "DETECTION", "AUTO_ACTION", "RECOMMENDATION", "USER_ACTION"
COMPLETED, PENDING_APPROVAL, FAILED = "COMPLETED", "PENDING_APPROVAL", "FAILED"

PSEUDO_WAREHOUSE = "CLOUD_SERVICES_ONLY"
LOOKBACK_HOURS = 24
SPIKE_THRESHOLD = Decimal("2.5")

# Idle severity: cloud-services credits above these (strictly).
IDLE_HIGH_ABOVE = Decimal("1.0")
IDLE_MEDIUM_ABOVE = Decimal("0.1")
# Spike severity: usage over baseline above these (strictly).
SPIKE_CRITICAL_ABOVE = Decimal("8.0")
SPIKE_HIGH_ABOVE = Decimal("4.0")

# Baseline: the rows before the current one, and how many of them must exist.
BASELINE_ROWS = 3
BASELINE_MIN_ROWS = 2

CREDIT_RATE = Decimal("3.00")  # dollars per credit
KWH_PER_CREDIT = Decimal("3.8")
CO2_KG_PER_KWH = Decimal("0.39")
CO2_KG_PER_TREE = Decimal("21.77")

AUTO_FIX_ACTOR = "FINOPS_AGENT"
AUTO_FIX_RESOLVER = "FINOPS_AGENT (auto)"

ALERT_METRICS = ("daily_spend", "weekly_spend", "credits_per_hour", "idle_minutes", "query_count")
ALERT_CONDITIONS = ("greater_than", "less_than", "equals")
ANY_WAREHOUSE = "ANY"

APPROVAL_NEEDED, APPROVED, WARNING, INFO = "APPROVAL_NEEDED", "APPROVED", "WARNING", "INFO"

OVERSIZE = ("Large", "X-Large", "2X-Large", "3X-Large", "4X-Large")
# --------------------------------------------------------------------------------------------------------------
