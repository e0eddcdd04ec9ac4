"""Byte decoding for page snapshots that arrive as binary."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ship this module's function by value so that executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: charset of the one site that does not serve UTF-8.
KOREAN_CHARSET = "cp949"


def decode_utf8(raw: Column) -> Column:
    """UTF-8 with the replacement character for bad bytes."""
    return F.make_valid_utf8(raw.cast("string"))


def _cp949(raw: pa.Array) -> pa.Array:
    return pa.array(
        [None if b is None else b.decode("cp949", "replace") for b in raw.to_pylist()],
        pa.string(),
    )


def decode_cp949(raw: Column) -> Column:
    """CP949 with the replacement character; Spark's own ``decode`` lacks this charset."""
    return F.arrow_udf(_cp949, "string").asNondeterministic()(raw)
