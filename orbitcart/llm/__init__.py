"""Training-data operators: search, quality, deduplication, tokenisation, mixing, secrets.

Every operator is a function of DataFrames with its own parameters and outputs. The thin
queries over the test tables, and their SQL, are in ``queries``. Nothing outside this
subpackage imports it.
"""
