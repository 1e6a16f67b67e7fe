"""The ledger's tables.

A change is the value that a slot of an address has from a block on. Keys may be of any orderable type: binary
addresses and slots order as unsigned bytes, as the ledger needs.
"""

from __future__ import annotations

from pyspark.sql import types as T

KEY = ["addr", "slot"]

CHANGES = T.StructType([
    T.StructField("addr", T.BinaryType(), False),
    T.StructField("slot", T.BinaryType(), False),
    T.StructField("block", T.LongType(), False),
    T.StructField("value", T.BinaryType(), True),
])
RUNS = T.StructType([
    T.StructField("run_id", T.LongType(), False),
    T.StructField("level", T.IntegerType(), False),
    T.StructField("block_lo", T.LongType(), False),
    T.StructField("block_hi", T.LongType(), False),
    T.StructField("n_rows", T.LongType(), False),
])
CHECKPOINTS = T.StructType([
    T.StructField("block", T.LongType(), False),
    T.StructField("level", T.IntegerType(), False),
    T.StructField("run_id", T.LongType(), False),
    T.StructField("block_lo", T.LongType(), False),
    T.StructField("block_hi", T.LongType(), False),
])
#: The value of a slot that was never written, where a caller wants one instead of null.
ZERO = bytes(32)
