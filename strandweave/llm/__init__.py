"""Operators for large text corpora.

Nothing outside this subpackage imports it.  Operators take and return DataFrames; work that does not
fit built-in expressions runs in ``mapInArrow`` over whole Arrow batches.
"""
