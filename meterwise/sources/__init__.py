"""Table readers, derived test tables and written snapshots."""
