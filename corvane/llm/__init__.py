"""Training-data operators: thirteen stand-alone Spark operators for corpora of documents and pages.

Nothing outside this subpackage imports it.
"""
