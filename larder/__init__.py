"""larder: order, menu and stock analytics as Spark DataFrame operators.

Every operator is a plain function from DataFrames to DataFrames, built on
Spark's DataFrame / SQL / Structured Streaming APIs.  Sub-packages:

* ``sources``   - readers and writers (parquet snapshots, nested JSON documents)
* ``functions`` - column-level helpers (tokens, trigrams, epoch text, scans)
* ``operators`` - the relational operators (sales, stock, merges, history ...)
* ``plans``     - multi-job plans (atomic order admission) and join strategy
* ``streaming`` - Structured Streaming forms of the change-tracking operators
"""

__version__ = "0.1.0"
