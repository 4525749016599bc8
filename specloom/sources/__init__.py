"""Log archive scans and the tables the jobs keep."""
