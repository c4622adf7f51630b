"""Record shapes of the data model."""

from pyspark.sql import types as T

FILE_KINDS = (
    "python", "javascript", "typescript", "json", "yaml", "markdown",
    "text", "asset", "config", "documentation", "unknown",
)

JOB_STATUSES = (
    "pending", "validating", "extracting", "triaging",
    "analyzing", "synthesizing", "completed", "failed",
)

FILES = T.StructType([
    T.StructField("project_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("rel_path", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("content", T.BinaryType()),
])

# One row per released member, and one marker row (null ``seq``) per archive
# that carries the reason when the archive was turned away.
OPENED = T.StructType([
    T.StructField("project_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("member_name", T.StringType()),
    T.StructField("rel_path", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("content", T.BinaryType()),
    T.StructField("reject_reason", T.StringType()),
])

FILE_RESULT = T.StructType([
    T.StructField("rel_path", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("lines", T.LongType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("language", T.StringType()),
])

ARTIFACTS = T.StructType([
    T.StructField("project_id", T.StringType()),
    T.StructField("part", T.LongType()),
    T.StructField("tree_text", T.StringType()),
    T.StructField("file_summaries", T.ArrayType(FILE_RESULT)),
    T.StructField("project_summary", T.StringType()),
])

ARCHIVE_SCAN = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])

JOB_MESSAGES = T.StructType([
    T.StructField("job_id", T.LongType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("msg", T.StringType()),
])
