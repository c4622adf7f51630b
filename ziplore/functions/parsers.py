"""Summaries that need a real parser: JSON, YAML and Python source.

Each is an Arrow-batched UDF. Rows to leave alone are passed as null, which
costs nothing to transfer; a null result means "summarise as plain text".
"""

from __future__ import annotations

import ast
import json
import warnings
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    import yaml
except ImportError:  # YAML files are then summarised as text
    yaml = None

NAMES_SHOWN = 3
KEYS_SHOWN = 5


def _encodable(text: str) -> str:
    """Lone surrogates from JSON escapes cannot leave Python as UTF-8."""
    return text.encode("utf-8", "replace").decode("utf-8")


def _keys(label: str, parsed) -> str:
    """First keys of a mapping, items of a list or characters of a string."""
    return _encodable(f"{label} with keys: " + ", ".join(list(parsed)[:KEYS_SHOWN]))


def _json_summary(text: str) -> str:
    return _keys("JSON", json.loads(text))


def _yaml_summary(text: str) -> str | None:
    return _keys("YAML", yaml.safe_load(text)) if yaml else None


def _python_summary(text: str) -> str:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        body = ast.parse(text).body
    shown = ["Python"]
    for label, node_type in (("classes", ast.ClassDef), ("funcs", ast.FunctionDef)):
        names = [node.name for node in body if isinstance(node, node_type)]
        if names:
            shown.append(f"{label}=" + ", ".join(names[:NAMES_SHOWN]))
    return _encodable("; ".join(shown))


_BY_FORMAT: dict[str, Callable[[str], str | None]] = {
    "json": _json_summary,
    "yaml": _yaml_summary,
    "python": _python_summary,
}


def _parsed_or_none(fmt: str | None, text: str | None) -> str | None:
    if fmt is None or text is None:
        return None
    try:
        return _BY_FORMAT[fmt](text)
    except Exception:  # any parser failure falls through to the text summary
        return None


@F.pandas_udf(T.StringType())
def _parsed_summary(fmt: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([_parsed_or_none(f, t) for f, t in zip(fmt, text)], dtype=object)


def parsed_summary(fmt: Column, text: Column) -> Column:
    """Summary by format (``json``, ``yaml`` or ``python``); null to fall through.

    Set ``text`` to null where ``fmt`` is, so that it is not sent.
    """
    return _parsed_summary(fmt, text)


def json_key_summary(text: Column) -> Column:
    return parsed_summary(F.lit("json"), text)


def yaml_key_summary(text: Column) -> Column:
    return parsed_summary(F.lit("yaml"), text)


def python_summary(text: Column) -> Column:
    return parsed_summary(F.lit("python"), text)


def object_key_summary(text: Column) -> Column:
    """JVM-only variant for columns known to hold strict JSON objects.

    Unlike :func:`json_key_summary` it repeats duplicate keys and gives null
    for anything that is not an object.
    """
    keys = F.json_object_keys(text)
    return F.concat(F.lit("JSON with keys: "), F.array_join(F.slice(keys, 1, KEYS_SHOWN), ", "))


def custom_summary(
    ext: Column, text: Column, analyzers: dict[str, Callable[[str], tuple[str, str] | None]]
) -> Column:
    """Struct of kind and summary from user functions keyed by extension.

    Only rows with a registered extension are sent; a function that returns
    None or fails leaves its row to the built-in rules.
    """

    def one(extension, body):
        if extension is None or body is None:
            return (None, None)
        try:
            kind, summary = analyzers[extension](body) or (None, None)
        except Exception:
            return (None, None)
        return (kind, None if summary is None else _encodable(summary))

    @F.pandas_udf("kind string, summary string")
    def run(extension: pd.Series, body: pd.Series) -> pd.DataFrame:
        rows = [one(e, b) for e, b in zip(extension, body)]
        return pd.DataFrame(rows, columns=["kind", "summary"], dtype=object)

    known = ext.isin(*analyzers)
    return run(F.when(known, ext), F.when(known, text))
