"""Operators of a training-data pipeline: scoring, duplicates, decontamination, privacy, language, formatting, mixing.

Nothing else in the library imports this folder. Each operator takes column names and keeps its own general outputs;
:mod:`reelspark.llm.queries` binds them to the test tables.
"""
