"""Readers, the month-partitioned hand-off table, calendars and the benchmark-table adapter."""
