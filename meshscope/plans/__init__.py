"""Iteration machinery, the query registry and its oracle SQL."""
