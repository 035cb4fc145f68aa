"""Operators of a training-data pipeline (token counts, dedup, scoring, scans, tokenising, archives)."""
