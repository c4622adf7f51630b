"""Stored per-file summaries (a JSON list per project) back to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ziplore.operators.validate import clean_result, result_fault

_ITEMS = "array<map<string,string>>"
_FIELDS = ("rel_path", "kind", "summary", "lines", "size_bytes", "language")
_DEFAULTS = {"kind": "unknown", "summary": "", "lines": "0", "size_bytes": "0"}


def read_file_summaries(df: DataFrame, json_col: str = "summaries_json", mode: str = "strict") -> DataFrame:
    """Explode each row's JSON list; all other columns are kept.

    Malformed JSON gives no rows. In ``strict`` mode one bad item empties the
    whole list; in ``legacy`` mode items are passed on as they are. ``item_no``
    is the place in the list.
    """
    if mode not in ("strict", "legacy"):
        raise ValueError(f"mode must be strict or legacy, not {mode!r}")
    kept = [c for c in df.columns if c != json_col]
    items = F.from_json(F.col(json_col), _ITEMS)

    def shaped(item):
        def value(name):
            if name == "language":
                return item[name]
            # An absent key takes the default; an explicit null stays null.
            default = F.lit(_DEFAULTS.get(name))
            return F.when(F.map_contains_key(item, name), item[name]).otherwise(default)

        def number(name):
            # Whole numbers may be written as 3, "3" or 3.0.
            return F.regexp_replace(value(name), r"[.]0+\z", "").try_cast("long")

        return F.struct(
            value("rel_path").alias("rel_path"),
            value("kind").alias("kind"),
            value("summary").alias("summary"),
            number("lines").alias("lines"),
            number("size_bytes").alias("size_bytes"),
            value("language").alias("language"),
        )

    shaped_items = F.transform(F.coalesce(items, F.array().cast(_ITEMS)), shaped)
    if mode == "strict":
        sound = F.forall(shaped_items, lambda r: result_fault(r).isNull())
        shaped_items = F.when(sound, shaped_items)
    rows = df.select(*kept, F.posexplode(shaped_items).alias("item_no", "item"))
    if mode == "legacy":
        return rows.select(*kept, "item_no", *[F.col(f"item.{f}") for f in _FIELDS])
    return rows.select(*kept, "item_no", clean_result(F.col("item")).alias("item")).select(
        *kept, "item_no", *[F.col(f"item.{f}") for f in _FIELDS]
    )
