"""Session transcripts and memory files: Markdown in, rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import rules as R

HEADER = {
    "agent": r"agent", "arguments": r"arguments", "started_at": r"started", "ended_at": r"ended", "exit": r"exit code",
}


def _header(raw: Column, label: str) -> Column:
    value = F.regexp_extract(raw, rf"(?im)^\*{{0,2}}{label}:\*{{0,2}}[ \t]*([^\r\n]*?)[ \t]*$", 1)
    return F.nullif(value, F.lit(""))


def parse_sessions(files: DataFrame) -> DataFrame:
    """(session_id, path, agent, arguments, started_at, ended_at, exit_code, signal, mtime, size_bytes, raw_text)
    of (value, path, name, mtime, size): header lines are found anywhere, absent ones are null."""
    raw, exit_ = F.col("value"), _header(F.col("value"), HEADER["exit"])
    return files.select(
        F.regexp_replace("name", r"\.md\z", "").alias("session_id"), "path",
        _header(raw, HEADER["agent"]).alias("agent"), _header(raw, HEADER["arguments"]).alias("arguments"),
        F.try_to_timestamp(_header(raw, HEADER["started_at"])).alias("started_at"),
        F.try_to_timestamp(_header(raw, HEADER["ended_at"])).alias("ended_at"),
        F.regexp_extract(exit_, r"^(\d+)", 1).try_cast("int").alias("exit_code"),
        F.regexp_extract(exit_, r"\(signal (\d+)\)", 1).try_cast("int").alias("signal"),
        "mtime", F.col("size").alias("size_bytes"), raw.alias("raw_text"),
    )


def _whole_files(reader, path: str) -> DataFrame:
    files = reader.format("text").schema("value string").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").load(path)
    m = F.col("_metadata")
    # a written session is named by its folder
    folder = F.regexp_extract(F.url_decode(F.regexp_replace(m["file_path"], r"\+", "%2B")), r"/session_id=([^/]+)/[^/]*\z", 1)
    name = F.when(folder != "", F.concat(folder, F.lit(".md"))).otherwise(m["file_name"])
    return files.select(
        "value", m["file_path"].alias("path"), name.alias("name"), m["file_modification_time"].alias("mtime"),
        m["file_size"].alias("size"),
    )


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """All transcripts of a folder, a row per file; also of one that `write_sessions` made."""
    return parse_sessions(_whole_files(spark.read, path))


def session_text(agent: Column, arguments: Column, started: Column, ended: Column, exit_code: Column, signal: Column, raw: Column) -> Column:
    """The text of a session file, of columns: the header, then the raw transcript in a fence."""
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    code = F.concat(exit_code.cast("string"), F.when(signal.isNotNull(), F.concat(F.lit(" (signal "), signal.cast("string"), F.lit(")"))).otherwise(""))
    head = {"Agent": agent, "Arguments": arguments, "Started": stamp(started), "Ended": stamp(ended), "Exit code": code}
    lines = [F.concat(F.lit(f"**{k}:** "), F.coalesce(v, F.lit(""))) for k, v in head.items()]
    return F.concat(F.lit("# Coding Agent Session\n\n"), F.array_join(F.array(*lines), "\n"), F.lit("\n\n## Transcript\n\n```\n"), raw, F.lit("\n```\n"))


def write_sessions(sessions: DataFrame, path: str) -> None:
    """A file for each session (session_id, agent, arguments, started_at, ended_at, exit_code, signal, raw_text), in a folder of its own."""
    c = F.col
    text = session_text(c("agent"), c("arguments"), c("started_at"), c("ended_at"), c("exit_code"), c("signal"), c("raw_text"))
    rows = sessions.select("session_id", F.regexp_replace(text, r"\n\z", "").alias("value"))  # the writer ends it
    rows.write.mode("append").partitionBy("session_id").option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def stream_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream: each landed file once."""
    return parse_sessions(_whole_files(spark.readStream, path))


def newest_first(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.col("mtime").desc(), F.col("session_id").desc())


def newest(sessions: DataFrame, n: int = 1) -> DataFrame:
    """The n newest: a top-k, no full sort."""
    return newest_first(sessions).limit(n)


def session_document(agent: str, arguments: str, started: str, ended: str, exit_code: int, transcript: str, signal: int | None = None) -> str:
    """The text of a session file."""
    code = f"{exit_code} (signal {signal})" if signal is not None else str(exit_code)
    head = {"Agent": agent, "Arguments": arguments, "Started": started, "Ended": ended, "Exit code": code}
    lines = "\n".join(f"**{k}:** {v}" for k, v in head.items())
    return f"# Coding Agent Session\n\n{lines}\n\n## Transcript\n\n```\n{transcript}\n```\n"


# memory files -----------------------------------------------------------------------


def frontmatter(content: Column) -> Column:
    """Map of the fence at the very start; lines split at their first colon, the last of equal keys wins."""
    body = F.regexp_extract(content, r"\A---\r?\n((?s:.*?))\r?\n---", 1)
    pairs = F.filter(F.transform(F.split(body, r"\r?\n", -1), lambda x: F.split(x, ":", 2)), lambda p: (F.size(p) == 2) & (F.trim(p[0]) != ""))
    entries = F.transform(pairs, lambda p: F.named_struct(F.lit("key"), F.trim(p[0]), F.lit("value"), F.trim(p[1])))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    value = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, value))


def strip_frontmatter(content: Column) -> Column:
    """Every fence goes, wherever it stands."""
    return F.regexp_replace(content, r"---\r?\n(?s:.*?)\r?\n---\r?\n?", "\n")


def bullets(body: Column) -> Column:
    lines = F.transform(F.split(body, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+\z", ""))
    kept = F.filter(lines, lambda x: x.rlike(r"^[-*]\s+"))
    return F.filter(F.transform(kept, lambda x: F.trim(F.regexp_replace(x, r"^[-*]\s+", ""))), lambda x: x != "")


def summary_items(body: Column) -> Column:
    """Bullets, else the whole body as one item."""
    whole = F.regexp_replace(body, r"^\s+|\s+\z", "")
    return F.when(F.size(bullets(body)) > 0, bullets(body)).otherwise(F.filter(F.array(whole), lambda x: x != ""))


def read_memory_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, category, ord, text, metadata) of the items of each memory file."""
    files = _whole_files(spark.read, path)
    category = F.regexp_replace("name", r"\.md\z", "")
    body = strip_frontmatter(F.col("value"))
    items = F.when(category == "summaries", summary_items(body)).otherwise(bullets(body))
    return files.select(F.col("name").alias("file"), category.alias("category"), frontmatter(F.col("value")).alias("metadata"), F.posexplode(items).alias("ord", "text"))


def memory_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, text): every line of every memory file, for search."""
    files = _whole_files(spark.read, path)
    return files.select(F.col("name").alias("file"), F.posexplode(F.split(strip_frontmatter(F.col("value")), "\n", -1)).alias("line_no", "text"))


def memory_lines_of(items: DataFrame) -> DataFrame:
    """(file, line_no, text): stored items as the lines of memory files, frontmatter first.

    Date and source are those of the newest item. A lone summary stands bare, others are bullets.
    """
    heads = items.groupBy("category").agg(F.max_by(F.struct("item_date", "source"), F.struct("item_date", F.col("ord"))).alias("h"), F.count(F.lit(1)).alias("n"))
    lines = F.array(
        F.lit("---"), F.concat(F.lit("type: "), "category"), F.concat(F.lit("date: "), F.coalesce(F.col("h.item_date").cast("string"), F.lit(""))),
        F.concat(F.lit("source: "), F.coalesce("h.source", F.lit(""))), F.lit("---"), F.lit(""),
    )
    head = heads.select("category", F.posexplode(lines).alias("at", "text")).select("category", (F.col("at") - 6).cast("long").alias("line_no"), "text")
    bare = heads.filter("category = 'summaries' AND n = 1").select("category", F.lit(True).alias("_bare"))
    body = items.join(bare, "category", "left")
    body = body.select("category", F.col("ord").alias("line_no"), F.when(F.col("_bare"), F.col("text")).otherwise(F.concat(F.lit("- "), "text")).alias("text"))
    return head.unionAll(body).select(F.concat("category", F.lit(".md")).alias("file"), "line_no", "text")


def display_ids(items: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """decision-1, decision-2, ... by category and `ord`, as in listings.

    Stored items have their place in the category as `ord`. With a scope, each of its
    categories is counted from 1 by the order of `ord`.
    """
    from pyspark.sql import Window

    one = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in R.SINGULAR.items() for x in kv)), F.col("category")), F.col("category"))
    n = F.row_number().over(Window.partitionBy(*scope, "category").orderBy("ord")) if scope else F.col("ord")
    return items.withColumn("id", F.concat(one, F.lit("-"), n.cast("string")))


def chosen(items: DataFrame, ids: list[str]) -> DataFrame:
    """Items (with `id`) of the given ids, whatever their case; `ord` is the place of the id in the list."""
    wanted = list(dict.fromkeys(i.strip().lower() for i in ids if i.strip()))
    place = F.array_position(F.array(*map(F.lit, wanted)), F.lower("id")).cast("long")
    return items.filter(F.lower("id").isin(*wanted)).withColumn("ord", place)


def id_of_text(items: DataFrame) -> DataFrame:
    """(text, id): of items of equal text the last one's id, in listing order."""
    rank = F.array_position(F.array(*map(F.lit, R.TITLES)), F.col("category"))
    return items.groupBy("text").agg(F.max_by("id", F.struct(rank.alias("r"), F.col("ord").alias("o"))).alias("id"))


def by_name(sessions: DataFrame) -> DataFrame:
    """Sessions in the order of their names, over range partitions."""
    return sessions.repartitionByRange("session_id").sortWithinPartitions("session_id")


def marker_name(session: Column) -> Column:
    """Sanitised key under which a session is marked as reviewed."""
    base = F.regexp_replace(F.regexp_extract(session, r"([^/\\]*)\z", 1), r"[^a-zA-Z0-9._-]", "_")
    return F.regexp_replace(base, r"\.md\z", "")


def pending(sessions: DataFrame, markers: DataFrame) -> DataFrame:
    """Sessions without a marker."""
    done = markers.select(marker_name(F.col("session")).alias("_m")).distinct()
    return sessions.join(done, marker_name(F.col("session_id")) == done["_m"], "left_anti")
