"""Text expressions with the exact whitespace and line rules of the model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip removes. The record model
# strips the same set without the four separators 0x1c-0x1f.
SEPARATORS = "\x1c\x1d\x1e\x1f"
MODEL_BLANKS = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
BLANKS = MODEL_BLANKS + SEPARATORS

# The same set as a Java character class.
BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

SUMMARY_CHARS = 160
ELLIPSIS = "…"


def strip(text: Column, blanks: str = BLANKS) -> Column:
    return F.trim(text, F.lit(blanks))


def strip_right(text: Column, blanks: str = BLANKS) -> Column:
    return F.rtrim(text, F.lit(blanks))


def summarise_text(text: Column, max_chars: int = SUMMARY_CHARS) -> Column:
    """One line for a text: its heading, else its first sentence, else its start."""
    return summarise_stripped(strip(text), max_chars)


def summarise_stripped(body: Column, max_chars: int = SUMMARY_CHARS) -> Column:
    """:func:`summarise_text` for a column that is already stripped.

    A sentence only counts when its end lies within ``max_chars``, so the
    sentence pattern looks at ``max_chars + 1`` characters: the last possible
    terminator and the blank after it.
    """
    heading = F.regexp_extract(body, rf"\A#{{1,6}}{BLANK}+([^\n]+)", 1)
    opening = F.substring(body, 1, max_chars + 1)
    sentence = F.regexp_extract(opening, rf"(?s)\A(.*?[.!?]){BLANK}", 1)
    return (
        F.when(body.startswith("#") & (heading != ""), heading)
        .when(sentence != "", sentence)
        .when(
            F.length(opening) > max_chars,
            F.concat(F.substring(body, 1, max_chars), F.lit(ELLIPSIS)),
        )
        .otherwise(body)
    )


def decode_text(content: Column, max_bytes: int | None = None, boundary_safe: bool = False) -> Column:
    """Bytes to text: the whole content as UTF-8 if it is valid, else as Latin-1.

    The Latin-1 branch also turns CRLF and CR into LF. With ``max_bytes`` only
    that many bytes are taken as UTF-8, and a character cut there makes them
    invalid; ``boundary_safe`` drops the cut character instead.
    """
    sample = (content if max_bytes is None else F.substring(content, 1, max_bytes)).cast("string")
    latin = F.decode(content, "ISO-8859-1")
    latin = F.replace(F.replace(latin, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    text = F.when(content.isNull(), F.lit("")).when(F.is_valid_utf8(sample), sample)
    if boundary_safe and max_bytes is not None:
        for cut in (1, 2, 3):
            shorter = F.substring(content, 1, max_bytes - cut).cast("string")
            text = text.when(
                (F.octet_length(content) > max_bytes) & F.is_valid_utf8(shorter), shorter
            )
    return text.otherwise(latin)


def line_count(content: Column) -> Column:
    """Newlines, plus one for a last line without a newline. Whole content."""
    raw = content.cast("string")
    newlines = F.octet_length(raw) - F.octet_length(F.replace(raw, F.lit("\n"), F.lit("")))
    open_end = (F.octet_length(raw) > 0) & ~raw.endswith("\n")
    return F.coalesce(newlines + open_end.cast("int"), F.lit(0)).cast("long")


def byte_count(content: Column) -> Column:
    return F.coalesce(F.octet_length(content), F.lit(0)).cast("long")
