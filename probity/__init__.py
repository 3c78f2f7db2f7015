"""Review-trust analytics as DataFrame transformations.

Every public operator takes DataFrames (or Columns) and returns DataFrames (or Columns), so it can be
chained with ``df.transform`` and runs unchanged on a batch table or, where it needs no ordering over
the whole table, on a stream.
"""
