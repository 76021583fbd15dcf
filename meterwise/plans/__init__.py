"""Multi-step jobs and the query registry."""
