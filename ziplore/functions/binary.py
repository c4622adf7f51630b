"""Binary sniffing on raw bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes below 9 and from 14 to 31 count as not printable.
CONTROL = r"[\x00-\x08\x0E-\x1F]"
SAMPLE_BYTES = 1024
BINARY_SHARE = 0.30


def looks_binary(content: Column, sample: int = SAMPLE_BYTES) -> Column:
    """More than 30 % control bytes at the start of the file.

    Empty content is text; content that could not be read (null) is binary.
    Bytes are only counted where there is a control byte at all, which most
    texts do not have.
    """
    head = F.decode(F.substring(content, 1, sample), "ISO-8859-1")
    size = F.length(head)
    control = size - F.length(F.regexp_replace(head, CONTROL, ""))
    return (
        F.when(content.isNull(), F.lit(True))
        .when(~head.rlike(CONTROL), F.lit(False))
        .otherwise(control / size > F.lit(BINARY_SHARE))
    )
