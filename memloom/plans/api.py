"""The engine: what a user does with sessions and memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import predicates as P
from memloom.functions import redact as X
from memloom.functions import repair as Rp
from memloom.functions import rules as R
from memloom.functions import text as T
from memloom.functions.dialect import SPARK as d
from memloom.operators import dedupe as D
from memloom.operators import resolve as Rs
from memloom.operators import search as Q
from memloom.operators import segment as G
from memloom.operators.graph import numbered
from memloom.operators.summarize import counts, summaries
from memloom.plans import extract as E
from memloom.plans.session import cut
from memloom.sources import sessions as S
from memloom.sources.store import Store


class Engine:
    """Memories of coding sessions, kept under `root`; `notes` may name a folder of further Markdown files to search."""

    def __init__(self, spark: SparkSession, root: str, notes: str | None = None):
        self.spark, self.store, self.notes = spark, Store(spark, root), notes

    # capture ------------------------------------------------------------------------

    def inspect(self, sessions: DataFrame) -> DataFrame:
        """Per session: metadata, size, counts by category, summary. Stores nothing."""
        rows = cut(E.memories(sessions))
        report = counts(rows, "session_id").join(summaries(rows, "session_id"), "session_id", "left")
        return sessions.drop("raw_text").join(report, "session_id", "left").fillna(0, R.CATEGORIES)

    def cleaned(self, sessions: DataFrame, max_chars: int = R.CLEANED_CHARS) -> DataFrame:
        """(session_id, cleaned_text, truncated): what is left of each transcript, cut for display."""
        lines = G.clean_lines(sessions).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("l"))
        whole = sessions.select("session_id").join(lines, "session_id", "left")
        whole = whole.withColumn("t", F.coalesce(F.array_join(F.transform("l", lambda x: x["text"]), "\n"), F.lit("")))
        return whole.select("session_id", T.truncated(d, F.col("t"), max_chars).alias("cleaned_text"), (F.length("t") > max_chars).alias("truncated"))

    def summarize(self, sessions: DataFrame, dry_run: bool = False) -> dict[str, int]:
        """Extract and store; dry_run counts what would be stored."""
        return self._merge(self._new_items(cut(E.memories(sessions))), dry_run)

    ingest = summarize

    def _new_items(self, rows: DataFrame) -> DataFrame:
        said = rows.select("category", "ord", "text", F.col("session_id").alias("session"))
        told = summaries(rows, "session_id").filter("summary <> ''")
        told = told.select(F.lit("summaries").alias("category"), F.lit(0).cast("long").alias("ord"), F.col("summary").alias("text"), F.col("session_id").alias("session"))
        return said.unionByName(told)

    @staticmethod
    def _cleaned(stored: DataFrame) -> DataFrame:
        """Stored memories, repaired and judged anew: what older rules let in goes. The place is a dense number."""
        fixed = F.explode(F.array(Rp.repair(d, F.col("text"))))  # a fence: the rules are planned once
        rows = stored.withColumn("_fixed", fixed)
        rows = cut(rows.withColumn("_good", (F.col("_fixed") != "") & P.quality(d, F.col("_fixed"), F.col("category"))))
        if rows.filter("NOT _good OR _fixed <> text").isEmpty():
            return rows.drop("_fixed", "_good")
        rows = cut(rows.filter("_good").withColumn("text", F.col("_fixed")).drop("_fixed", "_good"))
        kept = D.dedupe(rows.select("category", "ord", "text"), ["category"]).select("category", "ord", "text")
        return cut(numbered(kept.join(rows.drop("text"), ["category", "ord"]).select(*stored.columns), "category", ["ord"], "_n").withColumn("ord", F.col("_n")).drop("_n"))

    def _merge(self, new: DataFrame, dry_run: bool = False) -> dict[str, int]:
        """New items before stored ones, de-duplicated per category; growth by category (replacing a poorer one adds 0).

        A category without new items stays as it is. The last session's summary replaces the
        stored one. If nothing changes, no version is written.
        """
        new, stored = cut(new), cut(self.store.items())
        grown = sorted(r[0] for r in new.filter("category <> 'summaries'").select("category").distinct().collect())
        out = dict.fromkeys([*R.CATEGORIES, "summaries"], 0)
        rest, changed = stored, False
        if grown:
            had = self._cleaned(stored.filter(F.col("category").isin(*grown)))
            fresh = new.filter("category <> 'summaries'").withColumn("item_date", F.current_date()).withColumn("source", F.col("session"))
            fresh = fresh.withColumn("key", F.struct(F.lit(0).alias("age"), F.col("session").alias("said_in"), F.col("ord").alias("at")))
            before = had.withColumn("key", F.struct(F.lit(1).alias("age"), F.lit("").alias("said_in"), F.col("ord").alias("at")))
            both = cut(fresh.unionByName(before))
            kept = D.dedupe(both.select("category", "key", "text"), ["category"], "key").select("category", "key", "text")
            lineage = both.groupBy("category", "key").agg(F.first("session").alias("session"), F.min("item_date").alias("item_date"), F.first("source").alias("source"))
            merged = cut(numbered(cut(kept.join(lineage, ["category", "key"])), "category", ["key"], "ord").drop("key"))
            place = ["category", "ord", "text"]
            was, now = self._counts(had), self._counts(merged)
            changed = was != now or not merged.select(*place).join(had.select(*place), place, "left_anti").isEmpty()
            out |= {c: max(0, now.get(c, 0) - was.get(c, 0)) for c in grown}
            if changed:
                rest = rest.filter(~F.col("category").isin(*grown)).unionByName(merged.select(*stored.columns))
        last = new.filter("category = 'summaries'").agg(F.max_by(F.struct("text", "session"), F.struct("session", "ord")).alias("s")).first()["s"]
        if last is not None and stored.filter((F.col("category") == "summaries") & (F.col("text") == last["text"])).isEmpty():
            told = self.spark.createDataFrame([("summaries", 1, last["text"], last["session"])], "category string, ord long, text string, session string")
            told = told.withColumn("item_date", F.current_date()).withColumn("source", F.col("session"))
            rest, changed, out["summaries"] = rest.filter("category <> 'summaries'").unionByName(told), True, 1
        if changed and not dry_run:
            self.store.put_items(rest)
        return out

    @staticmethod
    def _counts(items: DataFrame) -> dict[str, int]:
        return {r[0]: r[1] for r in items.groupBy("category").count().collect()}  # a row a category

    def rebuild(self, sessions: DataFrame, dry_run: bool = False) -> DataFrame:
        """Replace the store by what all sessions say, in the order of their names; the version before stays as the backup."""
        said = cut(E.memories(sessions))
        told = summaries(said, "session_id").filter("summary <> ''").select(
            F.lit("summaries").alias("category"), F.struct(F.col("session_id").alias("session"), F.lit(0).cast("long").alias("ord")).alias("key"), F.col("summary").alias("text")
        )
        told = D.dedupe(told, ["category"], "key").select("category", "text", F.col("key.session").alias("session"), F.col("key.ord").alias("at"))
        rows = E.rebuilt(said).select("category", "text", "session", F.col("ord").alias("at")).unionByName(told)
        rows = numbered(cut(rows), "category", ["session", "at"], "ord").drop("at")
        rows = cut(rows.withColumn("item_date", F.current_date()).withColumn("source", F.col("session")))
        if not dry_run:
            self.store.put_items(rows)
        return rows

    # look up ------------------------------------------------------------------------

    def list(self, category: str | None = None) -> DataFrame:
        """(id, category, ord, text, session, item_date, source, resolved) of stored items."""
        if category is not None:
            category = {v: k for k, v in R.SINGULAR.items()}.get(category, category)
            if category not in R.TITLES:
                raise ValueError(f"unknown memory type: {category}")
        rows = S.display_ids(self.store.items())
        open_ = rows.filter("category IN ('bugs', 'todos')").withColumn("k", F.col("id"))
        done = rows.filter("category = 'resolved'").withColumn("k", F.col("id"))
        settled = Rs.resolutions(open_, done, "k").select(F.col("open_key").alias("id")).distinct().withColumn("resolved", F.lit(True))
        rows = rows.join(settled, "id", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))
        return rows.filter(F.col("category") == category) if category else rows

    def show(self, item_id: str) -> DataFrame:
        return self.list().filter(F.lower("id") == item_id.lower())

    def delete(self, item_id: str) -> int:
        """How many items went; those after them move up."""
        rows = cut(S.display_ids(self.store.items()))
        hit = rows.filter(F.lower("id") == item_id.lower())
        n = hit.count()
        if n:
            left = rows.join(hit.select("id"), "id", "left_anti").drop("id")
            self.store.put_items(cut(numbered(left, "category", ["ord"], "_n").withColumn("ord", F.col("_n")).drop("_n")))
        return n

    def lines(self) -> DataFrame:
        """(file, line_no, text) to search: stored items, and every other Markdown file of the notes."""
        own = self.store.items().select(F.concat("category", F.lit(".md")).alias("file"), F.col("ord").alias("line_no"), F.concat(F.lit("- "), "text").alias("text"))
        if self.notes is None:
            return own
        known = [f"{c}.md" for c in R.TITLES]
        more = S.memory_lines(self.spark, self.notes).filter(~F.col("file").isin(*known))
        return own.unionByName(more.withColumn("line_no", F.col("line_no").cast("long")))

    def export(self, path: str) -> None:
        """The store as Markdown text, a folder per memory file, its lines in order over range partitions."""
        rows = S.memory_lines_of(self.store.items()).repartitionByRange("file", "line_no").sortWithinPartitions("file", "line_no")
        rows.select("file", F.col("text").alias("value")).write.mode("overwrite").partitionBy("file").text(path)

    def find(self, query: str) -> DataFrame:
        return Q.find_lines(Q.search(self.lines(), query))

    def inject(self, query: str, max_chars: int = R.CONTEXT_CHARS) -> str:
        return Q.context(self.lines(), query, max_chars)

    def status(self, sessions: DataFrame) -> dict[str, int]:
        """Counts of sessions, reviews and items; all categories are there."""
        markers = self.store.markers()
        by_status = {r[0]: r[1] for r in markers.groupBy("status").count().collect()}
        out = {"sessions": sessions.count(), "pending": S.pending(sessions, markers).count(), "reviewed": sum(by_status.values())}
        out["skipped"] = by_status.get("skipped", 0)
        return out | dict.fromkeys([*R.CATEGORIES, "summaries"], 0) | self._counts(self.store.items())

    # review and resolve -------------------------------------------------------------

    def review(self, session: DataFrame) -> DataFrame:
        """(id, category, ord, text, session, suspicious, redacted): candidates of a session."""
        items = S.display_ids(self._new_items(cut(E.memories(session))), ("session",))
        flags = items.withColumn("suspicious", P.suspicious(d, F.col("text"), F.col("category")))
        return flags.withColumn("redacted", F.contains("text", F.lit(R.PLACEHOLDER)))

    def accept(self, session: DataFrame, ids: str = "all", suspicious: bool = False, summary: bool = True) -> dict[str, int]:
        """Store chosen candidates ('all' but suspicious ones, or ids by comma, in that order) and mark the session."""
        found = cut(self.review(session))
        if ids.strip().lower() == "all":
            chosen = found if suspicious else found.filter("NOT suspicious")
        else:
            wanted = list(dict.fromkeys(x.strip().lower() for x in ids.split(",") if x.strip()))
            known = {r[0].lower() for r in found.select("id").filter(F.lower("id").isin(*wanted)).distinct().collect()}
            if not wanted or set(wanted) - known:
                raise ValueError(f"no such candidates: {sorted(set(wanted) - known)}")
            chosen = S.chosen(found, wanted)
        chosen = chosen if summary else chosen.filter("category <> 'summaries'")
        any_chosen, any_found = not chosen.isEmpty(), not found.isEmpty()
        written = self._merge(chosen.select("category", "ord", "text", "session")) if any_chosen else {}
        if any_chosen or (ids.strip().lower() == "all" and not any_found):
            self.store.mark(session.select(F.col("session_id").alias("session")), "reviewed", written)
        return written

    def skip(self, session: DataFrame) -> None:
        self.store.mark(session.select(F.col("session_id").alias("session")), "skipped", {})

    def pending(self, sessions: DataFrame) -> DataFrame:
        """Unmarked sessions, newest first, with counts by category, `empty` if nothing is to be had, size and day."""
        left = cut(S.pending(sessions, self.store.markers()))
        out = self.inspect(left).withColumn("summary", F.coalesce("summary", F.lit("")))
        nothing = F.col("summary") == ""
        for c in R.CATEGORIES:
            nothing = nothing & (F.col(c) == 0)
        return S.newest_first(out.withColumn("empty", nothing).withColumn("day", F.to_date("mtime")))

    def resolve(self, item: str) -> dict:
        """By id of an open bug or to-do, or by text. Returns what was added and the other open items it settles."""
        hit = self.show(item).first()
        if hit is not None and (hit.category not in ("bugs", "todos") or hit.resolved):
            return {"added": 0, "also": []}
        text = f"Resolved: {hit.text}" if hit is not None else f"Resolved {item}"
        row = self.spark.createDataFrame([("resolved", 0, text, "manual")], "category string, ord long, text string, session string")
        row = row.withColumn("text", Rp.repair(d, F.col("text")))
        row = cut(row.filter(P.quality(d, F.col("text"), F.col("category"))))
        open_ = self.list().filter("category IN ('bugs', 'todos') AND NOT resolved").withColumn("k", F.col("id"))
        also = Rs.resolutions(open_, row.withColumn("k", F.lit("new")), "k").collect()
        also = sorted(r.open_key for r in also if hit is None or r.open_key != hit.id)
        return {"added": self._merge(row)["resolved"], "also": also}


def redacted(text):
    """Redaction as a function of a column, for queries of one's own."""
    return X.redact(d, text)
