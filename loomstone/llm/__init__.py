"""Training-data operators for large corpora.

Nothing else in the package imports this subpackage; it may be removed as a
whole.  Every operator is a plain function from DataFrames to DataFrames; the
thin contract queries live in :mod:`loomstone.llm.queries`.
"""
