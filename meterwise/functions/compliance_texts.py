"""Names and advice that policy findings carry."""

# --- fixed values ---------------------------------------------------------------------------------------------
SUSPEND_CHECK = "Auto-Suspend Timeout"
RESUME_CHECK = "Auto-Resume Disabled"
SIZE_CHECK = "Potentially Oversized"
SUSPEND_ADVICE = "60-300s"
RESUME_ADVICE = "true"
SIZE_ADVICE = "Review utilization"
# --------------------------------------------------------------------------------------------------------------
