"""Job channel messages: ``event:NAME``, ``error:TEXT`` and ``close``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLOSE = "close"
# Event names that mark a finished job.
DONE_EVENTS = ("WORKFLOW_DONE", "ANALYSIS_COMPLETED")

# Stage a job has reached once an event of this name was seen.
STATUS_BY_EVENT = {
    "validating": ("ANALYSIS_STARTED", "NewUpload"),
    "extracting": ("ZipValid", "FileDiscovered"),
    "triaging": ("ExtractionDone", "FileSkipped"),
    "analyzing": ("FileForAnalysis", "TriageComplete", "FileAnalysed"),
    "synthesizing": ("AnalysisComplete", "TreeBuilt", "ProjectDraft", "SummaryPolished"),
    "completed": DONE_EVENTS,
    "failed": ("ZipInvalid", "ExtractionFailed"),
}


def message_type(msg: Column) -> Column:
    return (
        F.when(msg == CLOSE, F.lit("close"))
        .when(msg.startswith("event:"), F.lit("event"))
        .when(msg.startswith("error:"), F.lit("error"))
        .otherwise(F.lit("other"))
    )


def message_body(msg: Column) -> Column:
    """Text after the first colon of an event or error; null for the rest."""
    tagged = msg.startswith("event:") | msg.startswith("error:")
    return F.when(tagged, F.substring(msg, 7, 2_147_483_647))


def is_done(msg: Column) -> Column:
    return msg.isin(*[f"event:{name}" for name in DONE_EVENTS])


def stage_of(event_name: Column) -> Column:
    """Status the event name stands for; null when it says nothing."""
    stage = F.when(F.lit(False), F.lit(None).cast("string"))
    for status, names in STATUS_BY_EVENT.items():
        stage = stage.when(event_name.isin(*names), status)
    return stage
