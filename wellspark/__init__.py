"""wellspark: health, nutrition and wearable analytics as Spark DataFrame plans.

Sub-packages
------------
sources     readers and sinks (CSV with path keys, nested JSON, text, binary, JSON/CSV sinks, result store)
functions   column-expression helpers (rounding, safe division, text/regex, reply parsing)
operators   DataFrame -> DataFrame operators (selection, trends, nutrition, PPG, HRV, scoring, text, transcripts)
streaming   Structured Streaming forms of the batch operators
plans       the operators bound to the driver tables (``queries()``) and their SQL oracles
"""

from wellspark.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
