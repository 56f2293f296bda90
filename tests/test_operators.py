import random
import re

from pyspark.sql import functions as F

from memloom.functions import rules as R
from memloom.operators import dedupe as D
from memloom.operators import resolve as Rs
from memloom.operators import search as Q
from memloom.operators import segment as G
from memloom.operators.graph import numbered
from memloom.operators.summarize import topics
from memloom.plans import extract as E
from memloom.plans.session import prepared
from memloom.sources import sessions as S

SESSION = "\n".join([
    "We decided to use JWT auth and need to fix Redis blacklist bug!!!", "We decided to use JWT auth and need to fix Redis blacklist bug!!!",
    "We decided to use JWT auth because it's stateless.", "We need to fix Redis blacklist bug.",
    "remaining: add unit tests for auth module", "error: module type not specified",
])
ECHO = "Goal: build it\n- Add a command\n  more\n* x\nWe decided to use project-local storage for memory.\nThe report is incomplete,\nbecause it ends early."


def dice(a, b):
    x, y = ([s[i : i + 2] for i in range(len(s) - 1)] for s in (a, b))
    if not x or not y:
        return 0
    rest, shared = list(y), 0
    for g in x:
        if g in rest:
            rest.remove(g)
            shared += 1
    return 200 * shared / (len(x) + len(y))


def test_extraction(spark):
    prepared(spark)
    rows = spark.createDataFrame([("a", SESSION), ("b", ECHO), ("c", ""), ("d", None)], "session_id string, raw_text string")
    got = {(r.session_id, r.category): r.text for r in E.memories(rows).collect()}
    assert got == {
        ("a", "decisions"): "Use JWT auth because it is stateless.", ("a", "bugs"): "Fix Redis blacklist bug.",
        ("a", "todos"): "Add unit tests for auth module.", ("a", "errors"): "Module type not specified.",
        ("b", "decisions"): "Use project-local storage for memory.", ("b", "bugs"): "The report is incomplete, because it ends early.",
    }


def test_dedupe_equals_the_sequential_way(spark):
    prepared(spark)
    rng = random.Random(4)
    words = "alpha beta gamma delta cache parser token queue".split()
    items = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    items += [x + rng.choice(["", "s", "!", " now"]) for x in items[:40]] + ["a", "ab", ""]
    rows = spark.createDataFrame([("x", i, t) for i, t in enumerate(items)], "scope string, ord long, text string")
    got = [(r.ord, r.text) for r in D.dedupe(rows, ["scope"]).orderBy("ord").collect()]

    norms = {r.ord: r.norm for r in spark.createDataFrame(rows.collect(), rows.schema).select("ord", D.T.normal_form(D.d, F.col("text")).alias("norm")).collect()}
    kept: dict = {}
    for i, t in enumerate(items):
        n = norms[i]
        if n not in kept or len(t) > len(kept[n][1]):
            kept[n] = (kept[n][0] if n in kept else i, t)
    alive = [(o, t, n) for n, (o, t) in kept.items() if not any(len(m) > len(n) and n in m for m in kept)]
    alive.sort()
    keep = [True] * len(alive)
    for i in range(len(alive)):
        for j in range(i + 1, len(alive)):
            if keep[i] and keep[j] and dice(alive[i][2], alive[j][2]) >= 85:
                keep[i if len(alive[j][1]) > len(alive[i][1]) else j] = False
    want = [(o, t) for (o, t, _), k in zip(alive, keep, strict=True) if k]
    assert got == want and len(want) < len(alive)

    # any sortable order will do, and large components are settled in rounds
    packed = rows.withColumn("ord", F.struct(F.lit("s").alias("session"), "ord"))
    left = D.contained(D.exact_distinct(packed, ["scope"]), ["scope"])
    for together in (D.TOGETHER, 0, 3):
        assert sorted((r.ord.ord, r.text) for r in D.similar(left, ["scope"], together=together).collect()) == want


def test_numbers_in_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abb"), rng.random()) for _ in range(300)] + [(None, 0.5)]
    got = numbered(spark.createDataFrame(rows, "scope string, v double").repartition(5), "scope", ["v"], "n").collect()
    want = {s: sorted(v for k, v in rows if k == s) for s in ("a", "b", None)}
    assert sorted((str(r.scope), r.n, r.v) for r in got) == sorted((str(s), k + 1, v) for s, vs in want.items() for k, v in enumerate(vs))


def test_resolution(spark):
    open_ = spark.createDataFrame([("o1", "GUARDRAILS.md is incomplete/truncated: it ends with an unclosed code fence."), ("o2", "Fix Redis blacklist bug.")], "ord string, text string")
    done = spark.createDataFrame([("r1", "Fixed GUARDRAILS.md unclosed code fence."), ("r2", "Fixed unrelated queue bug."), ("r3", "Redis blacklist notes.")], "ord string, text string")
    assert [tuple(r) for r in Rs.resolutions(open_, done).collect()] == [("o1", "r1")]


def test_search_prefers_direct_matches(spark):
    rows = [("a.md", 0, "- README.md is old"), ("a.md", 1, "- docs are old"), ("b.md", 0, "# readme"), *(("c.md", i, f"- cache {i}") for i in range(12))]
    lines = spark.createDataFrame(rows, "file string, line_no int, text string")
    assert Q.search(lines, "README").count() == 1
    assert Q.search(lines, "docs").count() == 2
    assert Q.search(lines, "cache").count() == 8
    assert Q.expand(" Code   Fence ")[1][:2] == ["code fence", "unclosed code fence"]


def test_session_files(spark, tmp_path):
    text = S.session_document("agent", "--fast", "2026-01-01T00:00:00.000Z", "2026-01-01T00:01:00.000Z", 130, "hello", 2)
    (tmp_path / "2026-01-01T00-00-00-000Z.md").write_text(text)
    (tmp_path / "bare.md").write_text("no header")
    rows = {r.session_id: r for r in S.read_sessions(spark, str(tmp_path)).collect()}
    one = rows["2026-01-01T00-00-00-000Z"]
    assert (one.agent, one.arguments, one.exit_code, one.signal) == ("agent", "--fast", 130, 2)
    assert rows["bare"].agent is None and rows["bare"].exit_code is None


def test_written_sessions_read_alike(spark, tmp_path):
    import datetime

    at = datetime.datetime(2026, 1, 1, 0, 1)
    rows = [("2026-01-01T00-00-00-000Z", "agent", "--fast x", at, at, 130, 2, "one\ntwo"), ("b c", "agent", "", at, at, 0, None, "three")]
    schema = "session_id string, agent string, arguments string, started_at timestamp, ended_at timestamp, exit_code int, signal int, raw_text string"
    S.write_sessions(spark.createDataFrame(rows, schema), str(tmp_path / "s"))
    found = {r.session_id: r for r in S.read_sessions(spark, str(tmp_path / "s")).collect()}
    assert found.keys() == {r[0] for r in rows}
    one = found["2026-01-01T00-00-00-000Z"]
    assert (one.agent, one.arguments, one.exit_code, one.signal, one.started_at) == ("agent", "--fast x", 130, 2, at)
    assert one.raw_text == S.session_document("agent", "--fast x", "2026-01-01T00:01:00.000Z", "2026-01-01T00:01:00.000Z", 130, "one\ntwo", 2)
    assert [r.session_id for r in S.by_name(spark.createDataFrame([("b",), ("a",)], "session_id string")).coalesce(1).collect()] == ["a", "b"]


def test_memory_lines(spark):
    import datetime

    day = datetime.date(2026, 1, 2)
    rows = [("todos", 1, "One.", "s", day, "x"), ("todos", 2, "Two.", "s", day, "y"), ("summaries", 1, "All of it.", "s", day, "x")]
    items = spark.createDataFrame(rows, "category string, ord long, text string, session string, item_date date, source string")
    lines: dict = {}
    for r in sorted(S.memory_lines_of(items).collect()):
        lines.setdefault(r.file, []).append(r.text)
    assert lines["todos.md"] == ["---", "type: todos", "date: 2026-01-02", "source: y", "---", "", "- One.", "- Two."]
    assert lines["summaries.md"][-1] == "All of it."
    ids = S.id_of_text(S.display_ids(items).unionByName(S.display_ids(items.filter("ord = 1").withColumn("ord", F.lit(7).cast("long")))))
    assert {r.text: r.id for r in ids.collect()} == {"One.": "todo-7", "Two.": "todo-2", "All of it.": "summary-7"}


def test_memory_files(spark, tmp_path):
    (tmp_path / "todos.md").write_text("---\ntype: todos\ntype: again\nsource: a:b\n---\n\n- One thing.\n* Two things.\nprose\n")
    (tmp_path / "summaries.md").write_text("---\ntype: summaries\n---\nA bare paragraph.\n")
    rows = sorted((r.category, r.ord, r.text, r.metadata.get("source"), r.metadata["type"]) for r in S.read_memory_files(spark, str(tmp_path)).collect())
    assert rows == [("summaries", 0, "A bare paragraph.", None, "summaries"), ("todos", 0, "One thing.", "a:b", "again"), ("todos", 1, "Two things.", "a:b", "again")]


def test_compound_sentences(spark):
    row = spark.createDataFrame([("Use X and then run it. Go on!  Yes",)], "t string").select(F.flatten(F.transform(G.split_sentences(F.col("t")), G.split_compound)).alias("s")).first()
    assert row.s == ["Use X", "run it.", "Go on!", "Yes"]


def test_fuzzy_dedupe_of_long_conversations(spark, tmp_path):
    from memloom.plans.queries import QUERIES

    rows = [
        (1, 100, "user", "the parser cache fails on stale tokens every day"), (2, 0, "user", "a wholly different remark on billing"),
        (3, 0, "user", "the parser cache fails on stale tokens every single day"),
    ]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(r.text for r in QUERIES["fuzzy_dedupe"](spark, str(tmp_path)).collect())
    assert got == ["a wholly different remark on billing", "the parser cache fails on stale tokens every single day"]


def plain_topics(texts):
    topics, seen = [], set()

    def add(topic):
        key = re.sub(r"[^a-z0-9]+", " ", topic.lower()).strip()
        if key and key not in seen and len(topics) < 6:
            seen.update([key, *key.split()])
            topics.append(topic)

    texts = [t.replace("[REDACTED_SECRET]", " ") for t in texts]
    for t in texts:
        for name in re.findall(r"\b[A-Za-z0-9_-]+\.md\b", t):
            add(name)
        phrases = {"project guardrails": "project guardrails", r"(?:unclosed\s+)?code\s+fence": "code fence", "memory extraction": "memory extraction", "markdown": "markdown", "pty": "PTY",
                   "storage": "storage", r"(?:README|GUARDRAILS)\.md\b|\bdocs?\b|\bdocumentation\b|\bmarkdown\b|\bcode\s+fence\b|\bfenced\s+block": "documentation"}
        for p, topic in phrases.items():
            if re.search(rf"\b(?:{p})\b", t, re.I):
                add(topic)
    if len(topics) < 3:
        for w in re.sub(r"[^A-Za-z0-9\s]", " ", " \n ".join(texts)).split():
            low = w.lower()
            if len(low) >= 3 and low not in R.TOPIC_STOP and not re.match(r"\d|rgb$", low) and low not in seen and len(topics) < 6:
                seen.add(low)
                topics.append(w[0].upper() + w[1:])
    return topics


def test_topics(spark):
    rng = random.Random(7)
    words = "README.md GUARDRAILS.md notes.md the parser Storage PTY code fence unclosed docs markdown memory extraction JWT 5xx rgb cache-layer [REDACTED_SECRET] project guardrails Redis we fix failed".split()
    cases = [(k, [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 3))]) for k in range(150)]
    rows = spark.createDataFrame(cases, "k int, texts array<string>").select("k", topics(F.col("texts")).alias("t")).collect()
    got = {r.k: r.t for r in rows}
    assert got == {k: plain_topics(texts) for k, texts in cases}


def plain_tokens(text):
    out, raw = set(), re.sub(r"[^a-z0-9_.\s-]", " ", text.lower().rstrip(".!?")).split()
    for w in (re.sub(r"^[.-]+|[.-]+$", "", x) for x in raw):
        stem = re.match(r"([a-z0-9_-]+)\.[a-z0-9]+$", w)
        for v in [w, *([stem[1]] if stem else [])]:
            c = next((to for at, to in (("truncat", "truncat"), ("fenc", "fence"), ("doc", "document")) if v.startswith(at)), re.sub(r"(?:ing|ed|s)$", "", v))
            if len(c) >= 3 and v not in R.RESOLUTION_STOP and c not in R.RESOLUTION_STOP:
                out.add(c)
    return out


def test_resolutions_equal_a_plain_rule(spark):
    rng = random.Random(3)
    words = "parser cache token queue code fence fenced docs README.md retry login export stale fix the a bug truncated index".split()
    open_ = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 7))) for _ in range(120)})
    done = sorted({rng.choice(["Fixed ", "Resolved the ", "Closed the bug with ", "Notes on ", "It was fixed: "]) + " ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(120)})
    want = set()
    for r in done:
        if r.startswith("Notes"):
            continue
        b = plain_tokens(r)
        for o in open_:
            both = plain_tokens(o) & b
            if {"code", "fence"} <= both or len(both) >= 3 or (len(both) >= 2 and len(both) == len(b)):
                want.add((o, r))
    frame = lambda texts: spark.createDataFrame([(t, t) for t in texts], "ord string, text string")
    got = {(r.open_key, r.resolved_key) for r in Rs.resolutions(frame(open_), frame(done)).collect()}
    assert got == want and want
    first = {r.open_key: r.resolved_key for r in Rs.first_resolver(frame(open_), frame(done)).collect()}
    assert first == {o: min(r for x, r in want if x == o) for o, _ in want}
    assert {r.ord for r in Rs.still_open(frame(open_), frame(done)).collect()} == set(open_) - {o for o, _ in want}
