"""Counts, focus topics and one-sentence summaries of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions import rules as R
from memloom.functions.dialect import java

#: In this order texts count and are read for topics.
ORDER = ["decisions", "bugs", "todos", "errors", "resolved"]


def counts(memories: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, one count per category)."""
    return memories.groupBy(key).agg(*(F.count_if(F.col("category") == c).alias(c) for c in R.CATEGORIES))


def status(items: DataFrame, settled: DataFrame, key: str = "ord") -> DataFrame:
    """(category, n, open): items of each category, all of them listed, and how many bugs and to-dos no `settled` key (one column) settles."""
    every = items.sparkSession.createDataFrame([(c,) for c in R.TITLES], "category string")
    done = settled.select(F.col(settled.columns[0]).alias(key)).distinct().withColumn("_done", F.lit(True))
    rows = items.join(done, key, "left").withColumn("_open", F.col("category").isin("bugs", "todos") & F.col("_done").isNull())
    found = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if("_open").alias("open"))
    return every.join(found, "category", "left").fillna(0, ["n", "open"])


def _key(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(t), r"[^a-z0-9]+", " "))


def topics(texts: Column) -> Column:
    """Up to six focus topics of an ordered array of texts: files and phrases first, then words."""
    texts = F.transform(texts, lambda t: F.replace(t, F.lit(R.PLACEHOLDER), F.lit(" ")))
    named = lambda t: F.flatten(F.array(
        F.regexp_extract_all(t, F.lit(java(R.TOPIC_FILE)), F.lit(0)),
        *(F.when(t.rlike("(?i)" + java(p)), F.array(F.lit(name))).otherwise(F.array().cast("array<string>")) for p, name in R.TOPIC_PHRASES),
    ))
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("topics"), empty.alias("seen"))

    def add(state, topic):
        new = (F.size(state["topics"]) < R.TOPICS) & ~F.array_contains(state["seen"], _key(topic)) & (_key(topic) != "")
        grown = F.struct(
            F.concat(state["topics"], F.array(topic)).alias("topics"),
            F.concat(state["seen"], F.array(_key(topic)), F.split(_key(topic), " ")).alias("seen"),
        )
        return F.when(new, grown).otherwise(state)

    def add_word(state, word):
        low = F.lower(word)
        dull = (F.length(low) < 3) | low.isin(*R.TOPIC_STOP) | low.rlike(r"^\d|^rgb$") | F.array_contains(state["seen"], low)
        grown = F.struct(
            F.concat(state["topics"], F.array(F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.lit(1 << 30))))).alias("topics"),
            F.concat(state["seen"], F.array(low)).alias("seen"),
        )
        return F.when((F.size(state["topics"]) < R.TOPICS) & ~dull, grown).otherwise(state)

    named_first = F.aggregate(F.flatten(F.transform(texts, named)), start, add)
    words = F.flatten(F.transform(texts, lambda t: F.filter(F.split(F.regexp_replace(t, r"[^A-Za-z0-9\s]", " "), r"\s+", -1), lambda w: w != "")))
    filled = lambda s: F.when(F.size(s["topics"]) >= 3, s["topics"]).otherwise(F.aggregate(words, s, add_word)["topics"])
    return F.element_at(F.transform(F.array(named_first), filled), 1)


def summary_text(n: dict[str, Column], topics_: Column) -> Column:
    """'This session captured ...' of counts by category; blank if all are 0."""
    parts = [
        F.when(n[c] > 0, F.array(F.concat(n[c].cast("string"), F.lit(f" {R.COUNT_WORDS[c]}"), F.when(n[c] == 1, "").otherwise("s")))).otherwise(
            F.array().cast("array<string>")
        )
        for c in ORDER
    ]
    parts = F.flatten(F.array(*parts))

    def sentence(p):
        listed = F.when(F.size(p) == 1, p[0]).otherwise(
            F.concat(F.array_join(F.slice(p, F.lit(1), F.size(p) - 1), ", "), F.lit(" and "), F.element_at(p, -1))
        )
        focus = F.when(F.size(topics_) > 0, F.concat(F.lit(" Focus areas: "), F.array_join(topics_, ", "), F.lit("."))).otherwise("")
        return F.when(F.size(p) == 0, "").otherwise(F.concat(F.lit("This session captured "), listed, F.lit("."), focus))

    return F.element_at(F.transform(F.array(parts), sentence), 1)


def summaries(memories: DataFrame, key: str = "session_id", order: str = "ord") -> DataFrame:
    """(key, summary) of the memories of each session."""
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("category"))
    listed = F.sort_array(F.collect_list(F.struct(rank.alias("r"), F.col(order).alias("o"), "text")))
    rows = memories.groupBy(key).agg(listed.alias("l"), *(F.count_if(F.col("category") == c).alias(c) for c in ORDER))
    rows = rows.withColumn("topics", topics(F.transform("l", lambda x: x["text"])))
    return rows.select(key, summary_text({c: F.col(c) for c in ORDER}, F.col("topics")).alias("summary"))
