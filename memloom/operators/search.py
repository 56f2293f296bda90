"""Keyword search over stored memory lines, and the context block made of its results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import predicates as P
from memloom.functions import redact as X
from memloom.functions import repair as Rp
from memloom.functions import rules as R
from memloom.functions.dialect import SPARK as d
from memloom.operators.dedupe import dedupe
from memloom.operators.resolve import first_resolver


def expand(query: str) -> tuple[list[str], list[str]]:
    """(direct terms, all terms) of a query: lower case, single blanks, no repeats."""
    term = " ".join(query.lower().split())
    every = dict.fromkeys(t for t in [term, *R.QUERY_ALIASES.get(term, [])] if t)
    return [term] if term else [], list(every)


def search(lines: DataFrame, query: str, most: int = R.MATCHES_PER_FILE) -> DataFrame:
    """(file, line_no, text): the first `most` matching lines of each file of (file, line_no, text).

    Terms are known when the plan is made, so matching is a filter of literal `contains`.
    """
    direct, every = expand(query)
    low = F.lower("text")
    has = lambda terms: _any(low, terms)
    rows = lines.withColumn("text", d.trim(F.col("text"))).filter((F.col("text") != "") & ~F.col("text").startswith("#") & has(every))
    if " ".join(query.lower().split()) in R.DIRECT_FIRST:
        some = not rows.filter(has(direct)).isEmpty()
        rows = rows.filter(has(direct)) if some else rows
    place = F.row_number().over(Window.partitionBy("file").orderBy("line_no"))
    return rows.withColumn("_k", place).filter(F.col("_k") <= most).select("file", "line_no", "text")


def _any(low, terms):
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(low, F.lit(t))
    return out


def find_lines(found: DataFrame) -> DataFrame:
    """(file, label, n, text): results as shown, numbered within each file, redacted."""
    place = F.row_number().over(Window.partitionBy("file").orderBy("line_no"))  # a few lines a file
    label = F.when(F.col("file") == "resolved.md", F.concat("file", F.lit(" (Resolved)"))).otherwise(F.col("file"))
    return found.select("file", label.alias("label"), place.alias("n"), X.redact(d, F.regexp_replace("text", r"^[-*]\s+", "")).alias("text"))


def context(lines: DataFrame, query: str, max_chars: int = R.CONTEXT_CHARS) -> str:
    """The block to put before a prompt: sections of memories that fit, open ones only, within a budget.

    A cut block ends with a notice beyond its budget.
    """
    if max_chars <= 0:
        raise ValueError("max_chars must be positive")
    head = f"# Project Context: {query}\n\n"
    found = search(lines, query)
    if found.isEmpty():
        return head + f'No relevant memories found for "{query}".\n'
    stem = F.regexp_replace("file", r"\.md\z", "")
    bare = F.regexp_replace("text", r"^[-*]\s+", "")

    def items(rows: DataFrame) -> DataFrame:
        rows = rows.select(stem.alias("category"), F.col("line_no").alias("ord"), d.trim(bare).alias("raw"))
        repaired = F.when(F.col("category") == "summaries", F.col("raw")).otherwise(Rp.repair(d, F.col("raw")))
        rows = rows.select("category", "ord", F.explode(F.array(repaired)).alias("text")).filter("text <> ''")
        return rows.filter((F.col("category") == "summaries") | P.quality(d, F.col("text"), F.col("category")))

    good = items(found)
    stored = items(lines.filter("file = 'resolved.md'"))
    shown = dedupe(good.filter("category <> 'resolved'"), ["category"])
    open_ = shown.filter("category IN ('bugs', 'todos')").withColumn("key", F.struct("category", "ord"))
    stored_kept = dedupe(stored, ["category"]).withColumn("key", F.struct("category", "ord"))
    settled = first_resolver(open_, stored_kept, "key")
    settled_ids = settled.select("open_key.*").distinct()
    shown = shown.join(settled_ids, ["category", "ord"], "left_anti")
    suppressors = settled.select("resolved_key").distinct().join(stored_kept.withColumnRenamed("key", "resolved_key"), "resolved_key")
    resolved = good.filter("category = 'resolved'").unionByName(suppressors.select("category", (F.col("ord") + 1_000_000).alias("ord"), "text"))
    resolved = dedupe(resolved, ["category"])
    # at most MATCHES_PER_FILE lines of each file, and their resolvers
    rows = shown.select("category", "ord", "text").unionByName(resolved.select("category", "ord", "text")).collect()
    out = head
    for category in sorted({r.category for r in rows} - {"resolved"}) + (["resolved"] if any(r.category == "resolved" for r in rows) else []):
        listed = sorted((r.ord, r.text) for r in rows if r.category == category)
        out += f"## {R.TITLES.get(category, category)}\n" + "\n".join(f"- {t}" for _, t in listed) + "\n\n"
    spark = lines.sparkSession
    out = spark.createDataFrame([(out,)], "t string").select(X.redact(d, F.col("t"))).first()[0]
    return out if len(out) <= max_chars else out[:max_chars] + R.TRUNCATED
