"""Compositions of operators: corpus build, case retrieval, calendar scoring, query registry."""
