"""Operators that large-scale training-data pipelines need.

Nothing outside this subpackage (and the top-level ``corpus_pipeline``) imports
it; removing the folder leaves the rest of the library intact.
"""
