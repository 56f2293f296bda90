"""Transcript -> clean lines -> sentences -> candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import predicates as P
from memloom.functions import redact as X
from memloom.functions import repair as Rp
from memloom.functions import rules as R
from memloom.functions import text as T
from memloom.functions.dialect import SPARK as d
from memloom.plans.session import told


def _once(value: Column) -> Column:
    """An explode of one element: a fence that keeps Catalyst from copying a rule to where its result is read."""
    return F.explode(F.array(value))


def _marks(t: Column) -> Column:
    """What the cleaner's windows ask of a line."""
    kind = F.when(P.spec_heading(d, t), "heading").when(P.bullet(d, t), "bullet").when(P.numbered_or_blank(d, t), "listed")
    kind = kind.when(P.block_tail(d, t), "tail").otherwise("prose")
    return F.struct(
        P.envelope_start(d, t).alias("start"), P.envelope_end(d, t).alias("end"), kind.alias("kind"),
        P.may_go_on(d, t).alias("may_go_on"), P.must_go_on(d, t).alias("must_go_on"), P.may_join(d, t).alias("may_join"), P.must_join(d, t).alias("must_join"),
    )


def _raw_lines(sessions: DataFrame, key: str, raw: str) -> DataFrame:
    return sessions.select(key, F.posexplode(F.split(Rp.scrub_document(d, F.col(raw)), "\n", -1)).alias("line_no", "_raw"))


def _clear(raw_lines: DataFrame) -> DataFrame:
    """(_raw, text): normalised lines that are no noise."""
    rows = raw_lines.select("_raw", _once(T.normal_line(d, F.col("_raw"))).alias("text"))
    return rows.filter(~P.noisy_line(d, F.col("text")))


def transcript_lines(sessions: DataFrame, key: str = "session_id", raw: str = "raw_text") -> DataFrame:
    """(key, line_no, text): scrubbed, normalised lines that are no noise, in order."""
    return told(_raw_lines(sessions, key, raw), "_raw", _clear).select(key, "line_no", "text")


def _marked(lines: DataFrame) -> DataFrame:
    return told(lines, "text", lambda x: x.select("text", _once(_marks(F.col("text"))).alias("_m")))


def _out_of_envelopes(rows: DataFrame, key: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy("line_no")
    last_start = F.max(F.when(F.col("_m.start"), F.col("line_no"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    last_end = F.max(F.when(F.col("_m.end"), F.col("line_no"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    inside = F.col("_m.start") | F.coalesce(last_start >= F.coalesce(last_end, F.lit(-1)), F.lit(False))
    return rows.withColumn("_inside", inside).filter(~F.col("_inside")).select(*rows.columns)


def _out_of_blocks(rows: DataFrame, key: str) -> DataFrame:
    columns, kind = rows.columns, F.col("_m.kind")
    until = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_block", F.sum((kind == "heading").cast("int")).over(until))
    block = Window.partitionBy(key, "_block")
    first = {k: F.min(F.when(kind == k, F.col("line_no"))).over(block) for k in ("bullet", "prose")}
    rows = rows.withColumn("_bullet", first["bullet"]).withColumn("_prose", first["prose"])
    # a tail before any bullet ends the block as prose does
    tail = F.min(F.when((kind == "tail") & F.coalesce(F.col("line_no") < F.col("_bullet"), F.lit(True)), F.col("line_no"))).over(block)
    rows = rows.withColumn("_break", F.least("_prose", tail))
    keep = (F.col("_block") == 0) | ((kind != "heading") & F.coalesce(F.col("line_no") >= F.col("_break"), F.lit(False)))
    return rows.filter(keep).select(*columns)


def _joined(rows: DataFrame, key: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy("line_no")
    before, here = F.col("_before"), F.col("_m")
    rows = rows.withColumn("_before", F.lag("_m").over(order))
    joins = before["may_go_on"] & here["may_join"] & (before["must_go_on"] | here["must_join"])
    rows = rows.withColumn("_joins", F.coalesce(joins, F.lit(False)))
    rows = rows.withColumn("_group", F.sum((~F.col("_joins")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.sort_array(F.collect_list(F.struct("line_no", "text")))
    joined = rows.groupBy(key, "_group").agg(F.min("line_no").alias("line_no"), parts.alias("_parts"))
    text = F.array_join(F.transform("_parts", lambda x: x["text"]), " ")
    return joined.select(key, "line_no", text.alias("text"))


def drop_envelopes(lines: DataFrame, key: str = "session_id") -> DataFrame:
    """Lines of pasted envelopes go, by a window over a session."""
    return _out_of_envelopes(_marked(lines), key).select(*lines.columns)


def drop_headed_blocks(lines: DataFrame, key: str = "session_id") -> DataFrame:
    """Headings go, and the bullets beneath them."""
    return _out_of_blocks(_marked(lines), key).select(*lines.columns)


def drop_spec_blocks(lines: DataFrame, key: str = "session_id") -> DataFrame:
    """Pasted envelopes go, then headings with the bullets beneath them."""
    return _out_of_blocks(_out_of_envelopes(_marked(lines), key), key).select(*lines.columns)


def unwrap(lines: DataFrame, key: str = "session_id") -> DataFrame:
    """Soft-wrapped lines are joined to the line they go on from."""
    return _joined(_marked(lines), key)


def whole_lines(sessions: DataFrame, key: str = "session_id", raw: str = "raw_text") -> DataFrame:
    """(key, line_no, text): lines unwrapped, before the last look at noise and secrets."""
    answer = lambda x: _clear(x).select("_raw", "text", _once(_marks(F.col("text"))).alias("_m"))
    rows = told(_raw_lines(sessions, key, raw), "_raw", answer).drop("_raw")
    return _joined(_out_of_blocks(_out_of_envelopes(rows, key), key), key)


def by_line(sessions: DataFrame, make: Callable[[DataFrame, str], DataFrame], key: str = "session_id", raw: str = "raw_text") -> DataFrame:
    """(key, line_no, ...) of each clean line: `make` gets (name, text) of the distinct ones, and that name to keep."""

    def answer(lines: DataFrame) -> DataFrame:
        clean = lines.filter(~P.noisy_line(d, F.col("text"))).withColumnRenamed("text", "_line")
        return make(clean.select("_line", _once(X.redact(d, X.auth_residue_off(d, F.col("_line")))).alias("text")), "_line")

    return told(whole_lines(sessions, key, raw).withColumnRenamed("text", "_line"), "_line", lambda x: answer(x.withColumnRenamed("_line", "text"))).drop("_line")


def clean_lines(sessions: DataFrame, key: str = "session_id", raw: str = "raw_text") -> DataFrame:
    """(key, line_no, text) after the whole cleaner."""
    return by_line(sessions, lambda lines, _: lines, key, raw)


def split_sentences(text: Column) -> Column:
    """Array of trimmed sentences of a line."""
    parts = F.transform(F.split(text, r"\n+|(?<=[.!?])\s+", -1), lambda x: d.trim(x))
    return F.filter(parts, lambda x: x != "")


def split_compound(sentence: Column) -> Column:
    """Both halves around the first conjunction in the list that occurs, or the sentence."""
    low, out = F.lower(sentence), None
    for c in R.CONJUNCTIONS:
        at = F.instr(low, c)
        halves = F.array(d.trim(F.substring(sentence, F.lit(1), at - 1)), d.trim(F.substring(sentence, at + len(c), F.lit(1 << 30))))
        out = F.when(at > 0, halves) if out is None else out.when(at > 0, halves)
    return F.filter(out.otherwise(F.array(sentence)), lambda x: x != "")


def compounds(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, whole_no, part_no, text): the parts of each sentence."""
    whole = lines.select(*keys, F.posexplode(split_sentences(T.metadata_off(d, F.col("text")))).alias("whole_no", "whole"))
    return whole.select(*keys, "whole_no", F.posexplode(split_compound(F.col("whole"))).alias("part_no", "text"))


def sentences(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, sent_no, text): one row per candidate statement."""
    parts = F.flatten(F.transform(split_sentences(T.metadata_off(d, F.col("text"))), split_compound))
    return lines.select(*keys, F.posexplode(parts).alias("sent_no", "text"))


def _judgement(texts: DataFrame) -> DataFrame:
    """(raw, category, text, good) of the texts that are of a category."""
    t = F.col("raw")
    kept = texts.filter(~P.noisy_sentence(d, t) & ~X.redaction_only(d, t))
    kept = kept.select("raw", _once(P.classify(d, t)).alias("category")).filter("category IS NOT NULL")
    kept = kept.select("raw", "category", _once(Rp.repair(d, t)).alias("text"))
    return kept.select("*", _once((F.col("text") != "") & P.quality(d, F.col("text"), F.col("category"))).alias("good"))


def judged(rows: DataFrame, more: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """`rows` of sentences (..., text) that are of a category: (..., raw, category, text, good), repaired, and whether they are worth keeping.

    `more` may add columns that depend on these alone.
    """
    return told(rows.withColumnRenamed("text", "raw"), "raw", lambda x: more(_judgement(x)))


def candidates(rows: DataFrame) -> DataFrame:
    """(..., raw, category, text): classified, repaired, good memories."""
    return judged(rows).filter("good").drop("good")
