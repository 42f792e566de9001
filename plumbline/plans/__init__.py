"""Whole plans: panels derived from the benchmark tables, contestants, and the registered queries."""
