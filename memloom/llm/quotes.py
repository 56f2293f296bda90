"""Quotation linking for chats (DataFrame functions only).

Quote levels are parsed from leading '>' marks. Each run of quoted lines of one level,
and each line of it, is normalised (marks off, lower case, white space to one space) and
hashed; so are the lines, paragraphs and whole of what messages say themselves. A
quotation links to the first message of its conversation that says it, if that comes
before. A message replies to the latest message linked at its lowest linked level. Pointer
doubling over replies gives each message its thread and depth, hence the reply order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.dialect import SPARK
from memloom.llm.common import Scratch, table

_MARKS = r"(?:[ \t]*>)"
#: Lines that say who is quoted; they go with the quotes.
ATTRIBUTION = r"^[ \t]*On [^\n]* wrote:[ \t]*$"


def _normal(text: Column) -> Column:
    bare = F.regexp_replace(text, rf"(?m)^{_MARKS}+", " ")
    return F.trim(F.regexp_replace(F.lower(bare), r"[\x20\x09-\x0D]+", " "))


def own_text(text: Column) -> Column:
    """What a message says itself: no quoted lines, no attributions, no blank lines at its ends."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~x.rlike(rf"^{_MARKS}") & ~x.rlike(ATTRIBUTION))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+\z", "")


def quoted_runs(text: Column) -> Column:
    """Array of (level, run): maximal runs of lines of one quote level, of any depth."""
    level = lambda line: F.length(F.regexp_replace(F.regexp_extract(line, rf"^{_MARKS}+", 0), "[^>]", ""))

    def runs(of):
        lines, levels, n = of["lines"], of["levels"], F.size(of["lines"])
        quoted = lambda i: F.get(levels, i) > 0
        turns = lambda i: F.get(levels, i) != F.get(levels, i - 1)
        # a run starts where a level does and ends before the next one
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: quoted(i) & ((i == 0) | turns(i)))
        stops = F.filter(F.sequence(F.lit(1), n), lambda i: quoted(i - 1) & ((i == n) | turns(i)))
        ends = F.arrays_zip(starts.alias("a"), stops.alias("b"))
        return F.transform(ends, lambda x: F.struct(
            F.get(levels, x["a"]).alias("level"), F.array_join(F.slice(lines, x["a"] + 1, x["b"] - x["a"]), "\n").alias("run")
        ))

    def bound(lines):
        return SPARK.let(F.struct(lines.alias("lines"), F.transform(lines, level).alias("levels")), runs)

    return SPARK.let(F.split(F.coalesce(text, F.lit("")), "\n"), bound)


def _units(runs: Column) -> Column:
    """Hashes of the whole and of each line of an array of texts, blank ones left out."""
    parts = F.flatten(F.transform(runs, lambda r: F.concat(F.array(r), F.split(r, "\n"))))
    return F.transform(F.array_distinct(F.filter(F.transform(parts, _normal), lambda x: x != "")), lambda x: F.sha2(x.cast("binary"), 256))


def link_quotations(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, role, body, n_quotes, parent_turn, root_turn, depth) for every row of
    `messages` (conv_id, turn, role, text).

    Sorted by (conv_id, root_turn, depth, turn), a conversation is in reply order: each
    message comes after the one it replies to. A message without a linked quotation starts
    a thread of its own. Null text: empty body. Rows with a null conv_id or turn are linked
    to nothing. Rows that repeat (conv_id, turn) count as one message and all come back.
    Empty table: empty result.
    """
    rows = messages.select("conv_id", "turn", "role", "text")
    known = rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL")
    runs = known.filter(F.col("text").rlike(rf"(?m)^{_MARKS}")).select("conv_id", "turn", F.explode(quoted_runs(F.col("text"))).alias("q"))
    quoted = runs.select("conv_id", "turn", F.col("q.level").alias("level"), F.explode(_units(F.array("q.run"))).alias("h")).distinct()
    quoted = scratch.keep(quoted)
    own = own_text(F.col("text"))
    paragraphs = F.split(own, r"\n[ \t]*\n")
    said = known.join(quoted.select("conv_id").distinct(), "conv_id", "left_semi")
    said = said.select("conv_id", "turn", F.explode(F.array_union(_units(F.array(own)), _units(paragraphs))).alias("h"))
    # combined before the shuffle: a passage that all messages repeat leaves a row per task
    first = said.groupBy("conv_id", "h").agg(F.min("turn").alias("target"))
    links = quoted.join(first, ["conv_id", "h"]).filter("target < turn")
    best = links.groupBy("conv_id", "turn").agg(F.min(F.struct("level", (-F.col("target")).alias("back"))).alias("b"))
    step = scratch.keep(best.select("conv_id", "turn", (-F.col("b.back")).alias("parent")))

    up = step.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth"))
    while True:
        above = up.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        grown = up.join(above, ["conv_id", "root"], "left").select(
            "conv_id", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("next").isNotNull().alias("moved"),
        )
        grown = scratch.keep(grown)
        up = grown.drop("moved")
        if grown.filter("moved").isEmpty():
            break
    replies = step.join(up, ["conv_id", "turn"])
    out = rows.withColumn("body", own_text(F.col("text"))).withColumn("n_quotes", F.size(quoted_runs(F.col("text"))).cast("long"))
    out = out.join(replies, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "body", "n_quotes", F.col("parent").alias("parent_turn"),
        F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"),
    )


def reply_order(linked: DataFrame) -> DataFrame:
    """The messages in reply order, over range partitions: a long conversation spreads over several."""
    keys = ["conv_id", "root_turn", "depth", "turn"]
    return linked.repartitionByRange(*keys).sortWithinPartitions(*keys)


def op1_quotations(spark, sf_dir: str) -> DataFrame:
    """Every message of every conversation, linked and in reply order."""
    return reply_order(link_quotations(table(spark, sf_dir, "conversations"), Scratch(spark, "quotes")))


def _sql_normal(text: str) -> str:
    bare = rf"regexp_replace({text}, '^([ \t]*>)+', ' ', 'gm')"
    return rf"trim(regexp_replace(lower({bare}), '[\x20\x09-\x0D]+', ' ', 'g'))"


OP1_SQL = rf"""
WITH RECURSIVE m AS (
  SELECT ROW_NUMBER() OVER () AS rid, conv_id, turn, role, COALESCE(text, '') AS text FROM conversations
), l AS (
  SELECT rid, conv_id, turn, u.line, u.i,
         length(regexp_replace(regexp_extract(u.line, '^([ \t]*>)+'), '[^>]', '', 'g')) AS level,
         regexp_matches(u.line, '{ATTRIBUTION}') AS attribution
  FROM m, LATERAL (SELECT UNNEST(ls) AS line, UNNEST(range(len(ls))) AS i FROM (SELECT string_split(m.text, chr(10)) AS ls)) u
), own AS (
  SELECT m.rid, regexp_replace(COALESCE(string_agg(line, chr(10) ORDER BY i), ''), '^\s+|\s+$', '', 'g') AS body
  FROM m LEFT JOIN l ON l.rid = m.rid AND level = 0 AND NOT attribution GROUP BY m.rid
), runs AS (
  SELECT rid, conv_id, turn, level, g, string_agg(line, chr(10) ORDER BY i) AS run FROM (
    SELECT *, i - ROW_NUMBER() OVER (PARTITION BY rid, level ORDER BY i) AS g FROM l WHERE level > 0
  ) GROUP BY rid, conv_id, turn, level, g
), q AS (
  SELECT DISTINCT conv_id, turn, level, n FROM (
    SELECT conv_id, turn, level, {_sql_normal("run")} AS n FROM runs
    UNION ALL SELECT conv_id, turn, level, {_sql_normal("line")} FROM l WHERE level > 0
  ) WHERE n <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL
), said AS (
  SELECT m.conv_id, m.turn, {_sql_normal("part")} AS n FROM (
    SELECT rid, body AS part FROM own
    UNION ALL SELECT rid, UNNEST(string_split(body, chr(10))) FROM own
    UNION ALL SELECT rid, UNNEST(string_split_regex(body, '\n[ \t]*\n')) FROM own
  ) p JOIN m USING (rid)
), first AS (
  SELECT conv_id, n, MIN(turn) AS target FROM said GROUP BY conv_id, n
), best AS (
  SELECT conv_id, turn, arg_max(target, -level * 1000000000 + target) AS parent
  FROM q JOIN first USING (conv_id, n) WHERE target < turn GROUP BY conv_id, turn
), up AS (
  SELECT conv_id, turn, parent AS root, CAST(1 AS BIGINT) AS depth FROM best
  UNION ALL
  SELECT up.conv_id, up.turn, best.parent, depth + 1 FROM up JOIN best ON best.conv_id = up.conv_id AND best.turn = up.root
), top AS (
  SELECT conv_id, turn, arg_max(root, depth) AS root, MAX(depth) AS depth FROM up GROUP BY conv_id, turn
), n AS (
  SELECT rid, COUNT(*) AS n_quotes FROM runs GROUP BY rid
)
SELECT m.conv_id, m.turn, m.role, own.body, CAST(COALESCE(n_quotes, 0) AS BIGINT) AS n_quotes, best.parent AS parent_turn,
       COALESCE(top.root, m.turn) AS root_turn, CAST(COALESCE(top.depth, 0) AS BIGINT) AS depth
FROM m JOIN own USING (rid) LEFT JOIN n USING (rid)
LEFT JOIN best ON best.conv_id = m.conv_id AND best.turn = m.turn
LEFT JOIN top ON top.conv_id = m.conv_id AND top.turn = m.turn
"""
