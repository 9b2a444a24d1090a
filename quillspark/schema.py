"""Row types of the spell-analytics engine.

Byte offsets into UTF-8 text are the canonical coordinates; lines and columns derive from them.
"""

from __future__ import annotations

from pyspark.sql import types as T

RANGE = T.StructType([T.StructField("start_byte", T.LongType()), T.StructField("end_byte", T.LongType())])
RANGES = T.ArrayType(RANGE)
DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("path", T.StringType()), T.StructField("language", T.StringType()), T.StructField("text", T.StringType())])
CANDIDATE = T.StructType([T.StructField("word", T.StringType()), *RANGE.fields])
REGION = T.StructType([T.StructField("tag", T.StringType()), T.StructField("language", T.StringType()), *RANGE.fields])
FINDING = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("word", T.StringType()), T.StructField("locations", RANGES)])
EVENT = T.StructType([T.StructField("uri", T.StringType()), T.StructField("version", T.LongType()), T.StructField("language_id", T.StringType()), T.StructField("op", T.StringType()), T.StructField("text", T.StringType())])

#: The closed vocabulary of region tags.
TAGS = (
    "comment", "comment.block", "comment.line", "identifier", "identifier.constant", "identifier.field", "identifier.function", "identifier.module",
    "identifier.parameter", "identifier.type", "identifier.variable", "string", "string.heredoc", "string.special",
)
