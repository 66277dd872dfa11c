"""Operators of a large training-data pipeline.

Every operator takes and returns DataFrames and is lazy except where its
docstring names a job.  Nothing outside this subpackage imports it.
"""
