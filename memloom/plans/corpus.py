"""Session transcripts derived from the `events` table, for queries over a known corpus.

A session is a user; its lines are its events by (ts, event_id). Each event becomes one line
that reads like a coding session: decisions with an open bug, errors, to-dos, fixes,
narration, diffs, chrome, secrets, wrapped lines and pasted instructions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.dialect import DUCK, SPARK, Sql

SUBJECTS = ["parser", "cache layer", "login form", "export job", "retry queue", "search index", "billing report", "mail sender", "config loader", "image worker", "sync daemon"]
OBJECTS = ["timeouts", "stale tokens", "duplicate rows", "unicode names", "large uploads", "empty payloads", "clock skew"]
CHOICES = ["parquet snapshots", "JWT auth", "a bounded queue", "nightly compaction", "streaming checkpoints"]

#: event type -> lines, picked by event_id; {s} {o} {c} are replaced
LINES = {
    "purchase": [
        "We decided to use {c} for the {s} and need to fix the {s} crash on {o}.", "Let's go with {c} because it's simpler for {o}",
        "The {s} was fixed for {o}. We chose {c} instead.", "Requirements:", "- Add tests for {o} in the {s}",
    ],
    "error": [
        "error: {s} failed while reading {o}", "RuntimeException: {s} rejected {o}", "export {k}_API_KEY=sk-live{n}abc for the {s}",
        "The {s} does not load {o}, which is a bug", "at handler (src/app.ts:{n}:7)",
    ],
    "signup": [
        "TODO: add validation of {o} to the {s}", "We still need to update the {s} docs for {o}", "remaining: remove {o} from the {s}",
        "Need to implement {c} in the {s},", "## Plan for {s}",
    ],
    "view": [
        "Fixed the {s} bug with {o}.", "Resolved the {s} issue about {o}", "I'll check the {s} for {o}", "and {o} are handled by the {s}",
        "Completed {c} support in the {s}.",
    ],
    "click": [
        "const x{n} = load('{o}');", "@@ -{n},7 +{n},9 @@", "5h limit: 37% left", "[pasted content {n} chars]", "Use {c} when the {s} meets {o}.",
    ],
}


def _pick(d, values: list[str], k):
    return d.when(*((k == i, v) for i, v in enumerate(values[:-1])), otherwise=values[-1])


def line_text(d, event_type, event_id, number, mod):
    """`mod(x, m, step)`: x // step % m in the engine at hand; number: the id as text."""
    s, o, c = _pick(d, SUBJECTS, mod(event_id, 11, 1)), _pick(d, OBJECTS, mod(event_id, 7, 3)), _pick(d, CHOICES, mod(event_id, 5, 7))
    forms = [(event_type == kind, _pick(d, texts, mod(event_id, 5, 1))) for kind, texts in LINES.items()]
    t = d.when(*forms, otherwise="{s} idle")
    for mark, value in (("s", s), ("o", o), ("c", c), ("n", number)):
        t = _put(d, t, "{" + mark + "}", value)
    return _put(d, t, "{k}", d.lit("ACME"))


def _put(d, t, mark: str, value):
    if d is SPARK:
        return F.replace(t, F.lit(mark), value)
    return Sql(f"replace({t}, '{mark}', {value})")


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, ts, event_id, text) of each event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = line_text(
        SPARK, F.col("event_type"), F.col("event_id"), F.col("event_id").cast("string"),
        lambda x, m, step: F.floor(x / step) % m if step > 1 else x % m,
    )
    return events.select(F.col("user_id").alias("session_id"), "ts", "event_id", text.alias("text"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, raw_text): the lines of a session in order."""
    ordered = F.sort_array(F.collect_list(F.struct("ts", "event_id", "text")))
    lines = transcript_lines(spark, sf_dir).groupBy("session_id").agg(ordered.alias("l"))
    return lines.select(F.col("session_id").cast("string").alias("session_id"), F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("raw_text"))


_TEXT = line_text(
    DUCK, Sql("event_type"), Sql("event_id"), Sql("CAST(event_id AS VARCHAR)"),
    lambda x, m, step: Sql(f"(({x} // {step}) % {m})"),
)
#: The same lines in SQL: tables tl (one row a line) and tr (one row a session).
CORPUS_SQL = f"""
tl AS (SELECT user_id AS session_id, ts, event_id, {_TEXT} AS text FROM events),
tr AS (SELECT CAST(session_id AS VARCHAR) AS session_id, string_agg(text, chr(10) ORDER BY ts, event_id) AS raw_text FROM tl GROUP BY session_id)
"""
