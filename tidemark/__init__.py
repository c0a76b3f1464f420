"""Analytics over dated full-dump snapshots, on PySpark."""
