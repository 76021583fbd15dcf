"""Structured Streaming versions of the hourly scans."""
