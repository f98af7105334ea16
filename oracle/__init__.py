"""DuckDB oracle SQL for the correctness gate (written from the operator
"""
