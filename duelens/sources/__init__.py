"""Scans, sinks, upserts and the test-bed views."""
