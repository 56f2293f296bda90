"""Whole pipelines: session transcripts to memories, and many sessions to one store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.operators import dedupe as D
from memloom.operators import segment as S
from memloom.operators.summarize import counts, summaries
from memloom.plans.session import cut


def candidates(sessions: DataFrame, key: str = "session_id", raw: str = "raw_text", step: int = 10_000) -> DataFrame:
    """(key, ord, category, text): good memories before de-duplication; ord sorts by place, with up to `step` sentences a line."""
    rows = S.by_line(sessions, lambda lines, line: S.candidates(S.sentences(lines, line)), key, raw)
    return rows.select(key, (F.col("line_no").cast("long") * F.lit(step) + F.col("sent_no")).alias("ord"), "category", "text")


def memories(sessions: DataFrame, key: str = "session_id", raw: str = "raw_text") -> DataFrame:
    """(key, ord, category, text): what each session leaves to be remembered."""
    rows = cut(candidates(sessions, key, raw, 1 << 32))  # no line has as many sentences: ord is unique
    return D.dedupe(rows, [key, "category"]).select(key, "ord", "category", "text")


def report(sessions: DataFrame, key: str = "session_id", raw: str = "raw_text") -> DataFrame:
    """(key, counts by category, summary) of each session that left a memory."""
    rows = cut(memories(sessions, key, raw))
    return counts(rows, key).join(summaries(rows, key), key)


def rebuild(sessions: DataFrame, key: str = "session_id", raw: str = "raw_text") -> DataFrame:
    """(category, ord, text, session): memories of all sessions merged, sessions by name."""
    return rebuilt(cut(memories(sessions, key, raw)), key)


def rebuilt(said: DataFrame, key: str = "session_id") -> DataFrame:
    """The same of memories that are there already.

    The order key is a struct (session, ord), so no global numbering is needed.
    """
    rows = said.select("category", F.struct(F.col(key).alias("session"), "ord").alias("ord"), "text")
    merged = D.dedupe(rows, ["category"])
    return merged.select("category", F.col("ord.ord").alias("ord"), "text", F.col("ord.session").alias("session"))
