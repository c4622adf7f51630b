"""Optional rewriting of drafts by a caller's completion function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The message sent with each draft and its temperature.
SYSTEM_MESSAGE = (
    "You are a professional copy-editor. "
    "Rewrite the summary so it is clear, engaging and no longer than 150 words."
)
TEMPERATURE = 0.3
PROVIDERS = ("openai", "watsonx", "ollama")
DEFAULT_PROVIDER = "ollama"


def provider_of(model_id: Column) -> Column:
    """Prefix before the first slash; a bare name is ollama, an unknown prefix null."""
    prefix = F.substring_index(model_id, "/", 1)
    return F.when(F.instr(model_id, "/") == 0, F.lit(DEFAULT_PROVIDER)).when(
        prefix.isin(*PROVIDERS), prefix
    )


def polish_summaries(
    df: DataFrame,
    complete_fn: Callable[[list[dict], str, float], str] | None = None,
    model_id: str = "ollama/llama3",
    text_col: str = "project_summary",
) -> DataFrame:
    """Rewrite ``text_col``; any failure keeps the draft.

    Adds ``provider``, ``polished`` and ``error``. ``complete_fn(messages,
    model_id, temperature)`` runs in the executors and may open its client once
    per process. Without it, or with an unknown provider, drafts pass through
    in the JVM.
    """
    routed = df.withColumn("provider", provider_of(F.lit(model_id)))
    head, _, _ = model_id.partition("/")
    if "/" in model_id and head not in PROVIDERS:
        unknown = F.lit(f"unknown provider in {model_id}")
        return routed.withColumns({"polished": F.lit(False), "error": unknown})
    if complete_fn is None:
        return routed.withColumns(
            {"polished": F.lit(False), "error": F.lit(None).cast("string")}
        )

    schema = T.StructType(
        [*routed.schema.fields, T.StructField("polished", T.BooleanType()), T.StructField("error", T.StringType())]
    )

    def rewrite(draft):
        messages = [
            {"role": "system", "content": SYSTEM_MESSAGE},
            {"role": "user", "content": draft},
        ]
        try:
            return str(complete_fn(messages, model_id, TEMPERATURE)), True, None
        except Exception as error:
            return draft, False, str(error)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            outcome = [rewrite(draft) for draft in batch[text_col]]
            batch[text_col] = [o[0] for o in outcome]
            batch["polished"] = [o[1] for o in outcome]
            batch["error"] = [o[2] for o in outcome]
            yield batch

    return routed.mapInPandas(run, schema)
