"""Feature building and time-stable model judging on multi-table data, on Spark."""
