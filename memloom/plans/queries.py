"""Queries over the given tables, and the SQL that checks each of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import predicates as P
from memloom.functions import redact as X
from memloom.functions import repair as Rp
from memloom.functions import rules as R
from memloom.functions import text as T
from memloom.functions.dialect import DUCK, SPARK, Sql
from memloom.operators import dedupe as D
from memloom.operators import resolve as Rs
from memloom.operators import search as Q
from memloom.operators import segment as G
from memloom.operators.graph import connected_components, numbered
from memloom.operators.summarize import counts, status, summaries
from memloom.plans import extract as E
from memloom.plans.corpus import CORPUS_SQL, transcript_lines, transcripts
from memloom.plans.session import cut, prepared, spread, told
from memloom.sources.sessions import chosen, display_ids, newest, pending

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(prepared(spark), sf_dir)
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


# scalar functions on documents ------------------------------------------------------

_T = Sql("t")
#: Control sequences put around the words of each text, so that stripping has work to do.
_ANSI = "\x1b[31m"


def _scalar(name: str, rule, source: str, key: str, text: str, before: str = "", after: str = ""):
    sql = f"SELECT {key}, {rule(DUCK, _T)} AS result FROM (SELECT {key}, {DUCK.concat(before, Sql(text), after)} AS t FROM {source})"

    @query(name, sql)
    def run(spark, sf_dir):
        rows = _table(spark, sf_dir, source).select(key, F.concat(F.lit(before), F.col(text), F.lit(after)).alias("t"))
        return rows.select(key, rule(SPARK, F.col("t")).alias("result"))


_scalar("normalize_text", T.normal_form, "documents", "doc_id", "text")
_scalar("compact_text", T.compact, "documents", "doc_id", "text")
_scalar("control_strip", T.strip_controls, "documents", "doc_id", "text", f"\x1b]0;title\x07{_ANSI}", "\x1b[0m\r\x1b(B\x08 end")
_scalar("line_normalize", T.normal_line, "documents", "doc_id", "text", "│ ", " ─────\t█")
_scalar("redact_secrets", X.redact, "documents", "doc_id", "text", "DB_PASSWORD=hunter2, https://u:p@h.io/x ", " token ghp_abcdef0123 API_TOKEN: 'a b'")
_scalar("auth_url_scrub", lambda d, t: X.auth_residue_off(d, X.auth_urls_off(d, t)), "pages", "page_id", "url", "see https://x.io/callback?state=1 ", "?state=abc oauth_x")
_scalar("command_like", lambda d, t: T.command_like(d, t), "benchmark", "item_id", "text")
_scalar("meaningful_words", lambda d, t: T.meaningful_words(d, t), "benchmark", "item_id", "text")
_scalar("redaction_only", X.redaction_only, "benchmark", "item_id", "text", "API_KEY=[REDACTED_SECRET] ")


@query("secret_counts", "SELECT kind, CAST(SUM(n) AS BIGINT) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{k}' AS kind, {X.findings(DUCK, Sql('t'), k)} AS n FROM (SELECT text || ' ghp_abcdef0123 API_TOKEN=x1 xoxb-12345678' AS t FROM documents)"
    for k in X.FINDINGS) + ") GROUP BY kind")
def secret_counts(spark, sf_dir):
    t = F.concat("text", F.lit(" ghp_abcdef0123 API_TOKEN=x1 xoxb-12345678"))
    rows = _table(spark, sf_dir, "documents").select(*(F.coalesce(F.sum(X.findings(SPARK, t, k)), F.lit(0)).cast("long").alias(k) for k in X.FINDINGS))
    kinds = ", ".join(f"'{k}', `{k}`" for k in X.FINDINGS)
    return rows.selectExpr(f"stack({len(X.FINDINGS)}, {kinds}) AS (kind, n)")


# lines ------------------------------------------------------------------------------

_LINES_SQL = """ln AS (
  SELECT doc_id, u.i AS line_no, u.line AS text FROM documents d, LATERAL (
    SELECT UNNEST(ls) AS line, UNNEST(range(len(ls))) AS i FROM (SELECT string_split(d.text, chr(10)) AS ls)) u
)"""


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))


@query("line_explode", f"WITH {_LINES_SQL} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, text FROM ln")
def line_explode(spark, sf_dir):
    return document_lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "text")


def _line_rule(name: str, rule):
    @query(name, f"WITH {_LINES_SQL} SELECT doc_id, CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(*) FILTER (WHERE hit) AS BIGINT) AS hits FROM "
           f"(SELECT doc_id, {rule(DUCK, Sql('text'))} AS hit FROM ln) GROUP BY doc_id")  # fmt: skip
    def run(spark, sf_dir):
        rows = document_lines(spark, sf_dir).select("doc_id", rule(SPARK, F.col("text")).alias("hit"))
        return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))


_line_rule("line_filter_symbol_noise", P.high_symbol_noise)
_line_rule("line_filter_code", P.diff_or_code)
_line_rule("line_filter_ui", P.ui_line)
_line_rule("line_filter_noise", P.noisy_line)


@query("line_dedupe_counts", f"WITH {_LINES_SQL} SELECT norm, CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(DISTINCT doc_id) AS BIGINT) AS docs "
       f"FROM (SELECT doc_id, {T.normal_form(DUCK, Sql('text'))} AS norm FROM ln) GROUP BY norm HAVING COUNT(*) > 1")  # fmt: skip
def line_dedupe_counts(spark, sf_dir):
    rows = document_lines(spark, sf_dir).select("doc_id", T.normal_form(SPARK, F.col("text")).alias("norm"))
    # docs first per (norm, doc): no count of distinct values has to hold a group
    pairs = rows.groupBy("norm", "doc_id").agg(F.count(F.lit(1)).alias("k"))
    return pairs.groupBy("norm").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("docs")).filter("n > 1")


# de-duplication ---------------------------------------------------------------------

_CHAT_LINES = f"""ci AS (
  SELECT c.role AS scope, conv_id * 1000000 + turn * 10000 + u.i AS ord, u.line AS text, {T.normal_form(DUCK, Sql("u.line"))} AS norm
  FROM conversations c, LATERAL (SELECT UNNEST(ls) AS line, UNNEST(range(len(ls))) AS i FROM (SELECT string_split(c.text, chr(10)) AS ls)) u
), ex AS (
  SELECT scope, norm, MIN(ord) AS ord, arg_min(text, (-length(text), ord)) AS text FROM ci GROUP BY scope, norm
)"""


def chat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("scope"), F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    return rows.select("scope", (F.col("conv_id") * 1_000_000 + F.col("turn") * 10_000 + F.col("i")).alias("ord"), "text")


@query("exact_dedupe_longest", f"WITH {_CHAT_LINES} SELECT scope, CAST(ord AS BIGINT) AS ord, text, norm FROM ex")
def exact_dedupe_longest(spark, sf_dir):
    return D.exact_distinct(chat_lines(spark, sf_dir), ["scope"])


@query("containment_dedupe", f"WITH {_CHAT_LINES} SELECT scope, CAST(ord AS BIGINT) AS ord, text, norm FROM ex a WHERE NOT EXISTS ("
       "SELECT 1 FROM ex b WHERE b.scope = a.scope AND length(b.norm) > length(a.norm) AND contains(b.norm, a.norm))")  # fmt: skip
def containment_dedupe(spark, sf_dir):
    return D.contained(D.exact_distinct(chat_lines(spark, sf_dir), ["scope"]), ["scope"])


_BENCH_BIGRAMS = f"""b AS (SELECT item_id, {T.normal_form(DUCK, Sql("text"))} AS norm FROM benchmark),
g AS (SELECT item_id, substring(norm, CAST(i AS INTEGER), 2) AS g, COUNT(*) AS n FROM (SELECT item_id, norm, UNNEST(range(1, length(norm))) AS i FROM b) GROUP BY ALL),
s AS (SELECT item_id, SUM(n) AS total FROM g GROUP BY item_id)"""


@query("bigram_profile", f"WITH {_BENCH_BIGRAMS} SELECT item_id, g, CAST(n AS BIGINT) AS n FROM g")
def bigram_profile(spark, sf_dir):
    norm = T.normal_form(SPARK, F.col("text"))
    rows = _table(spark, sf_dir, "benchmark").select("item_id", F.explode(D.bigrams(norm)).alias("b"))
    return rows.groupBy("item_id", F.substring("b", 1, 2).alias("g")).agg(F.count(F.lit(1)).alias("n"))


@query("dice_pairs", f"""WITH {_BENCH_BIGRAMS}, o AS (
  SELECT x.item_id AS a, y.item_id AS b, SUM(LEAST(x.n, y.n)) AS o FROM g x JOIN g y ON x.g = y.g AND x.item_id < y.item_id GROUP BY ALL
) SELECT a, b FROM o JOIN s sa ON sa.item_id = a JOIN s sb ON sb.item_id = b WHERE 200 * o >= 60 * (sa.total + sb.total)""")
def dice_pairs(spark, sf_dir):
    rows = _table(spark, sf_dir, "benchmark").select(F.lit("all").alias("scope"), F.col("item_id").alias("ord"), T.normal_form(SPARK, F.col("text")).alias("norm"))
    return D.similar_pairs(cut(rows), ["scope"], percent=60).select("a", "b")


@query("near_dup_components", f"""WITH RECURSIVE {_BENCH_BIGRAMS}, o AS (
  SELECT x.item_id AS a, y.item_id AS b, SUM(LEAST(x.n, y.n)) AS o FROM g x JOIN g y ON x.g = y.g AND x.item_id < y.item_id GROUP BY ALL
), l AS (SELECT a, b FROM o JOIN s sa ON sa.item_id = a JOIN s sb ON sb.item_id = b WHERE 200 * o >= 60 * (sa.total + sb.total)),
e AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l UNION SELECT a, a FROM l UNION SELECT b, b FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT x AS item_id, MIN(y) AS component FROM r GROUP BY x""")
def near_dup_components(spark, sf_dir):
    rows = _table(spark, sf_dir, "benchmark").select(F.lit("all").alias("scope"), F.col("item_id").cast("long").alias("ord"), T.normal_form(SPARK, F.col("text")).alias("norm"))
    pairs = cut(D.similar_pairs(cut(rows), ["scope"], percent=60).select("a", "b"))
    roots = connected_components(pairs)
    of = roots.select(F.col("node").alias("item_id"), F.col("root").alias("component"))
    return of.unionAll(roots.select(F.col("root").alias("item_id"), F.col("root").alias("component")).distinct())


def _contained_sql(name: str, source: str) -> str:
    """Of (scope, ord, text, norm) those that no longer form of their scope contains."""
    return f"""{name} AS MATERIALIZED (SELECT scope, ord, text, norm FROM {source} a WHERE NOT EXISTS (
  SELECT 1 FROM {source} b WHERE b.scope = a.scope AND length(b.norm) > length(a.norm) AND contains(b.norm, a.norm)))"""


def _greedy_sql(name: str, source: str, p: str = "z") -> str:
    """The greedy over similar rows of (scope, ord, text, norm), pair after pair; ord is unique and sorts."""
    return f"""{p}n AS (SELECT scope, ord, text, ROW_NUMBER() OVER (ORDER BY scope, ord) AS i,
  CASE WHEN length(norm) < 2 THEN [] ELSE list_transform(range(1, length(norm)), lambda k: substring(norm, CAST(k AS INTEGER), 2)) END AS raw FROM {source}),
{p}u AS (SELECT i, g, ROW_NUMBER() OVER (PARTITION BY i, g) AS k FROM (SELECT i, UNNEST(raw) AS g FROM {p}n)),
{p}b AS (SELECT i, list(g || '#' || k) AS bs FROM {p}u GROUP BY i),
{p}m AS MATERIALIZED (SELECT scope, ord, text, n.i, bs, len(bs) AS m FROM {p}n n JOIN {p}b b ON b.i = n.i),
{p}p AS MATERIALIZED (SELECT ROW_NUMBER() OVER (ORDER BY a.i, b.i) AS k, a.i AS a, b.i AS b, CASE WHEN length(b.text) > length(a.text) THEN a.i ELSE b.i END AS loser
  FROM {p}m a JOIN {p}m b ON a.scope = b.scope AND a.i < b.i AND a.m * 115 >= b.m * 85 AND b.m * 115 >= a.m * 85
  WHERE 200 * len(list_intersect(a.bs, b.bs)) >= {R.SIMILAR_PERCENT} * (a.m + b.m)),
{p}g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS dead UNION ALL
  SELECT g.k + 1, CASE WHEN list_contains(g.dead, p.a) OR list_contains(g.dead, p.b) THEN g.dead ELSE list_append(g.dead, p.loser) END
  FROM {p}g g JOIN {p}p p ON p.k = g.k + 1),
{name} AS (SELECT scope, ord, text FROM {p}n WHERE i NOT IN (SELECT UNNEST((SELECT arg_max(dead, k) FROM {p}g))))"""


@query("fuzzy_dedupe", f"""WITH RECURSIVE ci AS (
  SELECT c.role AS scope, lpad(CAST(conv_id AS VARCHAR), 19, '0') || '/' || lpad(CAST(turn AS VARCHAR), 19, '0') || '/' || lpad(CAST(u.i AS VARCHAR), 19, '0') AS ord,
    u.line AS text, {T.normal_form(DUCK, Sql("u.line"))} AS norm
  FROM conversations c, LATERAL (SELECT UNNEST(ls) AS line, UNNEST(range(len(ls))) AS i FROM (SELECT string_split(c.text, chr(10)) AS ls)) u
), ex AS MATERIALIZED (SELECT scope, norm, MIN(ord) AS ord, arg_min(text, (-length(text), ord)) AS text FROM ci GROUP BY scope, norm),
{_contained_sql("ct", "ex")}, {_greedy_sql("gr", "ct")} SELECT scope, gr.ord, gr.text, norm FROM gr JOIN ct USING (scope, ord)""")
def fuzzy_dedupe(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("scope"), F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    # the place as a string that sorts like it: a packed number is not unique beyond 99 turns or 9,999 lines
    place = F.concat_ws("/", *(F.lpad(F.col(c).cast("string"), 19, "0") for c in ("conv_id", "turn", "i")))
    return D.dedupe(rows.select("scope", place.alias("ord"), "text"), ["scope"])


# derived transcripts ----------------------------------------------------------------


@query("transcript_lines", f"WITH {CORPUS_SQL} SELECT session_id, ts, event_id, text FROM tl")
def transcript_lines_(spark, sf_dir):
    return transcript_lines(spark, sf_dir)


@query("transcripts", f"WITH {CORPUS_SQL} SELECT session_id, raw_text FROM tr")
def transcripts_(spark, sf_dir):
    return transcripts(spark, sf_dir)


_SCRUBBED = f"""ls AS (SELECT session_id, string_split({Rp.scrub_document(DUCK, Sql("raw_text"))}, chr(10)) AS ls FROM tr),
l0 AS (SELECT session_id, i AS line_no, {T.normal_line(DUCK, Sql("line"))} AS text FROM (
  SELECT session_id, UNNEST(ls) AS line, UNNEST(range(len(ls))) AS i FROM ls)),
l1 AS (SELECT * FROM l0 WHERE NOT {P.noisy_line(DUCK, Sql("text"))})"""
_BLOCKS = f"""w1 AS (SELECT *, {P.envelope_start(DUCK, Sql("text"))} AS st, {P.envelope_end(DUCK, Sql("text"))} AS en FROM l1),
w2 AS (SELECT *, MAX(CASE WHEN st THEN line_no END) OVER (PARTITION BY session_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ls,
  MAX(CASE WHEN en THEN line_no END) OVER (PARTITION BY session_id ORDER BY line_no) AS le FROM w1),
w3 AS (SELECT session_id, line_no, text, CASE WHEN {P.spec_heading(DUCK, Sql("text"))} THEN 'h' WHEN {P.bullet(DUCK, Sql("text"))} THEN 'b'
  WHEN {P.numbered_or_blank(DUCK, Sql("text"))} THEN 'l' WHEN {P.block_tail(DUCK, Sql("text"))} THEN 't' ELSE 'p' END AS k
  FROM w2 WHERE NOT (st OR COALESCE(ls, -1) > COALESCE(le, -1) OR (ls IS NOT NULL AND ls = le))),
w4 AS (SELECT *, SUM(CASE WHEN k = 'h' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line_no) AS blk FROM w3),
w5 AS (SELECT *, MIN(CASE WHEN k = 'b' THEN line_no END) OVER p AS fb, MIN(CASE WHEN k = 'p' THEN line_no END) OVER p AS fp,
  MIN(CASE WHEN k = 't' THEN line_no END) OVER p AS ft FROM w4 WINDOW p AS (PARTITION BY session_id, blk)),
bl AS (SELECT session_id, line_no, text FROM w5 WHERE blk = 0 OR (k <> 'h' AND (COALESCE(line_no >= fp, FALSE)
  OR (ft IS NOT NULL AND ft < COALESCE(fb, 1000000000) AND line_no >= ft))))"""
_UNWRAP = f"""u1 AS (SELECT *, LAG(text) OVER (PARTITION BY session_id ORDER BY line_no) AS prev FROM bl),
u2 AS (SELECT *, CASE WHEN prev IS NOT NULL AND {P.joins_previous(DUCK, Sql("prev"), Sql("text"))} THEN 0 ELSE 1 END AS fresh FROM u1),
u3 AS (SELECT *, SUM(fresh) OVER (PARTITION BY session_id ORDER BY line_no) AS g FROM u2),
uw AS (SELECT session_id, MIN(line_no) AS line_no, string_agg(text, ' ' ORDER BY line_no) AS text FROM u3 GROUP BY session_id, g)"""
_ENVELOPED = _BLOCKS[: _BLOCKS.index("w3 AS")] + "ev AS (SELECT session_id, line_no, text FROM w2 WHERE NOT (st OR COALESCE(ls, -1) > COALESCE(le, -1) OR (ls IS NOT NULL AND ls = le)))"
_CLEAN = f"""cl AS (SELECT session_id, line_no, {X.redact(DUCK, X.auth_residue_off(DUCK, Sql("text")))} AS text
  FROM uw WHERE NOT {P.noisy_line(DUCK, Sql("text"))})"""


def _halves() -> str:
    cases = []
    for c in R.CONJUNCTIONS:
        at = f"instr(lower(s), '{c}')"
        cases.append(f"WHEN {at} > 0 THEN [trim(substring(s, 1, CAST({at} AS INTEGER) - 1)), trim(substring(s, CAST({at} AS INTEGER) + {len(c)}))]")
    return f"(CASE {' '.join(cases)} ELSE [s] END)"


_SENTENCES = f"""s0 AS (SELECT session_id, line_no, list_filter(list_transform(
  string_split(regexp_replace({T.metadata_off(DUCK, Sql("text"))}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {DUCK.trim(Sql("x"))}), lambda x: x <> '') AS ss FROM cl),
s1 AS (SELECT session_id, line_no, list_filter(flatten(list_transform(ss, lambda s: {_halves()})), lambda x: x <> '') AS ss FROM s0),
se AS (SELECT session_id, line_no, i AS sent_no, text FROM (SELECT session_id, line_no, UNNEST(ss) AS text, UNNEST(range(len(ss))) AS i FROM s1))"""
_CANDIDATES = f"""c1 AS (SELECT *, {P.classify(DUCK, Sql("text"))} AS category FROM se
  WHERE NOT {P.noisy_sentence(DUCK, Sql("text"))} AND NOT {X.redaction_only(DUCK, Sql("text"))}),
c2 AS (SELECT session_id, line_no, sent_no, category, text AS raw, {Rp.repair(DUCK, Sql("text"))} AS text FROM c1 WHERE category IS NOT NULL),
ca AS (SELECT * FROM c2 WHERE text <> '' AND {P.quality(DUCK, Sql("text"), Sql("category"))})"""


def _upto(*parts: str) -> str:
    return "WITH " + ", ".join([CORPUS_SQL, *parts])


_LINE_COLUMNS = "session_id, CAST(line_no AS BIGINT) AS line_no, text"


def _as_long(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.col(n).cast("long") for n in names})


@query("clean_filter", f"{_upto(_SCRUBBED)} SELECT {_LINE_COLUMNS} FROM l1")
def clean_filter(spark, sf_dir):
    return _as_long(G.transcript_lines(transcripts(spark, sf_dir)), "line_no")


#: Lines that open and close an envelope, put over some of each session.
_OPENED = """CASE line_no % 7 WHEN 0 THEN 'We are working on it' WHEN 4 THEN '• done' ELSE text END AS text"""


@query("envelope_drop", f"{_upto(_SCRUBBED.replace('l1 AS', 'lx AS'), f'l1 AS (SELECT session_id, line_no, {_OPENED} FROM lx)', _ENVELOPED)} SELECT {_LINE_COLUMNS} FROM ev")
def envelope_drop(spark, sf_dir):
    lines = G.transcript_lines(transcripts(spark, sf_dir)).selectExpr("session_id", "line_no", _OPENED)
    return _as_long(G.drop_envelopes(lines), "line_no")


@query("spec_block_drop", f"{_upto(_SCRUBBED, _BLOCKS)} SELECT {_LINE_COLUMNS} FROM bl")
def spec_block_drop(spark, sf_dir):
    return _as_long(G.drop_spec_blocks(G.transcript_lines(transcripts(spark, sf_dir))), "line_no")


@query("soft_unwrap", f"{_upto(_SCRUBBED, _BLOCKS, _UNWRAP)} SELECT {_LINE_COLUMNS} FROM uw")
def soft_unwrap(spark, sf_dir):
    return _as_long(G.unwrap(G.drop_spec_blocks(G.transcript_lines(transcripts(spark, sf_dir)))), "line_no")


def _sentences(spark, sf_dir, make=lambda rows: rows) -> DataFrame:
    """What `make` gives of the sentences (..., text) of each distinct line, with the places of that line."""
    rows = G.by_line(transcripts(spark, sf_dir), lambda lines, line: make(G.sentences(lines, line)))
    return _as_long(rows, *(n for n in ("line_no", "sent_no") if n in rows.columns))


def _of_sentences(spark, sf_dir, name: str, rule) -> DataFrame:
    """The result of a rule, worked out once for each distinct sentence."""
    answer = lambda x: x.select("text", F.explode(F.array(rule(F.col("text")))).alias(name))
    return _sentences(spark, sf_dir, lambda rows: told(rows, "text", answer).drop("text"))


@query("clean_transcript", f"{_upto(_SCRUBBED, _BLOCKS, _UNWRAP, _CLEAN)} SELECT {_LINE_COLUMNS} FROM cl")
def clean_transcript(spark, sf_dir):
    return _as_long(G.clean_lines(transcripts(spark, sf_dir)), "line_no")


_TO_SENTENCES = _upto(_SCRUBBED, _BLOCKS, _UNWRAP, _CLEAN, _SENTENCES)
_TO_CANDIDATES = _upto(_SCRUBBED, _BLOCKS, _UNWRAP, _CLEAN, _SENTENCES, _CANDIDATES)
_PLACE = "session_id, CAST(line_no AS BIGINT) AS line_no, CAST(sent_no AS BIGINT) AS sent_no"


@query("sentence_split", f"{_TO_SENTENCES} SELECT {_PLACE}, text FROM se")
def sentence_split(spark, sf_dir):
    return _sentences(spark, sf_dir)


@query("compound_split", f"{_TO_SENTENCES}, sp AS (SELECT session_id, line_no, UNNEST(ss) AS s, UNNEST(range(len(ss))) AS w FROM s0), "
       f"pt AS (SELECT session_id, line_no, w, list_filter({_halves()}, lambda x: x <> '') AS ps FROM sp) "
       "SELECT session_id, CAST(line_no AS BIGINT) AS line_no, CAST(w AS BIGINT) AS whole_no, CAST(UNNEST(range(len(ps))) AS BIGINT) AS part_no, UNNEST(ps) AS text FROM pt")  # fmt: skip
def compound_split(spark, sf_dir):
    return _as_long(G.by_line(transcripts(spark, sf_dir), lambda lines, line: G.compounds(lines, line)), "line_no", "whole_no", "part_no")


@query("classify_counts", f"{_TO_SENTENCES} SELECT category, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT {P.classify(DUCK, Sql('text'))} AS category FROM se) GROUP BY category")
def classify_counts(spark, sf_dir):
    rows = _of_sentences(spark, sf_dir, "category", lambda t: P.classify(SPARK, t))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("quality_gate", f"{_TO_CANDIDATES} SELECT {_PLACE}, category, text, text <> '' AND {P.quality(DUCK, Sql('text'), Sql('category'))} AS good, "
       f"{P.quality(DUCK, Sql('substring(text, 1, 12)'), Sql('category'))} AS good_short FROM c2")  # fmt: skip
def quality_gate(spark, sf_dir):
    short = P.quality(SPARK, F.substring("text", 1, 12), F.col("category"))
    rows = _sentences(spark, sf_dir, lambda rows: G.judged(rows, lambda x: x.select("*", F.explode(F.array(short)).alias("good_short"))))
    return rows.select("session_id", "line_no", "sent_no", "category", "text", "good", "good_short")


@query("classify_rows", f"{_TO_SENTENCES} SELECT {_PLACE}, {P.classify(DUCK, Sql('text'))} AS category FROM se")
def classify_rows(spark, sf_dir):
    rows = _of_sentences(spark, sf_dir, "category", lambda t: P.classify(SPARK, t))
    return rows.select("session_id", "line_no", "sent_no", "category")


@query("repair_text", f"{_TO_SENTENCES} SELECT {_PLACE}, {Rp.repair(DUCK, Sql('text'))} AS text FROM se")
def repair_text(spark, sf_dir):
    rows = _of_sentences(spark, sf_dir, "repaired", lambda t: Rp.repair(SPARK, t))
    return rows.select("session_id", "line_no", "sent_no", F.col("repaired").alias("text"))


@query("reject_reason_counts", f"{_TO_SENTENCES} SELECT r AS reasons, CAST(COUNT(*) AS BIGINT) AS n FROM "
       f"(SELECT {P.reasons_text(DUCK, Sql('text'), DUCK.lit('todos'))} AS r FROM se) GROUP BY r")  # fmt: skip
def reject_reason_counts(spark, sf_dir):
    rows = _of_sentences(spark, sf_dir, "reasons", lambda t: P.reasons_text(SPARK, t, F.lit("todos")))
    return rows.groupBy("reasons").agg(F.count(F.lit(1)).alias("n"))


@query("suspicious_flags", f"{_TO_SENTENCES} SELECT {_PLACE}, {P.suspicious(DUCK, Sql('text'), DUCK.lit('bugs'))} AS suspicious FROM se")
def suspicious_flags(spark, sf_dir):
    rows = _of_sentences(spark, sf_dir, "suspicious", lambda t: P.suspicious(SPARK, t, F.lit("bugs")))
    return rows.select("session_id", "line_no", "sent_no", "suspicious")


@query("extract_candidates", f"{_TO_CANDIDATES} SELECT session_id, CAST(line_no * 10000 + sent_no AS BIGINT) AS ord, category, text FROM ca")
def extract_candidates(spark, sf_dir):
    return E.candidates(transcripts(spark, sf_dir))


@query("candidate_counts", f"{_TO_CANDIDATES} SELECT session_id, " + ", ".join(
    f"CAST(COUNT(*) FILTER (WHERE category = '{c}') AS BIGINT) AS {c}" for c in R.CATEGORIES) + " FROM ca GROUP BY session_id")
def candidate_counts(spark, sf_dir):
    return counts(E.candidates(transcripts(spark, sf_dir)))


@query("category_rollup", f"{_TO_CANDIDATES} SELECT category, CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(DISTINCT session_id) AS BIGINT) AS sessions FROM ca GROUP BY category")
def category_rollup(spark, sf_dir):
    per = E.candidates(transcripts(spark, sf_dir)).groupBy("category", "session_id").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("category").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("sessions"))


_EX = f"""ex AS (SELECT session_id, category, norm, MIN(ord) AS ord, arg_min(text, (-length(text), ord)) AS text FROM (
  SELECT session_id, category, line_no * 10000 + sent_no AS ord, text, {T.normal_form(DUCK, Sql("text"))} AS norm FROM ca) GROUP BY ALL)"""


@query("extract_distinct", f"{_TO_CANDIDATES}, {_EX} SELECT session_id, category, CAST(ord AS BIGINT) AS ord, text FROM ex a WHERE NOT EXISTS ("
       "SELECT 1 FROM ex b WHERE b.session_id = a.session_id AND b.category = a.category AND length(b.norm) > length(a.norm) AND contains(b.norm, a.norm))")  # fmt: skip
def extract_distinct(spark, sf_dir):
    rows = cut(E.candidates(transcripts(spark, sf_dir)))
    scope = ["session_id", "category"]
    return D.contained(cut(D.exact_distinct(rows, scope)), scope).select("session_id", "category", "ord", "text")


#: Ids of every session, as a review shows them.
_IDS = """di AS (SELECT session_id, category, line_no * 10000 + sent_no AS ord, text, (CASE category WHEN 'resolved' THEN 'resolved' ELSE rtrim(category, 's') END) || '-' ||
  ROW_NUMBER() OVER (PARTITION BY session_id, category ORDER BY line_no, sent_no) AS id FROM ca)"""


@query("display_ids", f"{_TO_CANDIDATES}, {_IDS} SELECT session_id, category, CAST(ord AS BIGINT) AS ord, id FROM di")
def display_ids_(spark, sf_dir):
    return display_ids(E.candidates(transcripts(spark, sf_dir)), ("session_id",)).select("session_id", "category", "ord", "id")


_ACCEPTED = ["todo-2", " BUG-1", "decision-1", "todo-2", "error-3"]


@query("accept_ids", f"{_TO_CANDIDATES}, {_IDS} SELECT session_id, id, text, CAST(list_position(['todo-2', 'bug-1', 'decision-1', 'error-3'], id) AS BIGINT) AS ord "
       "FROM di WHERE id IN ('todo-2', 'bug-1', 'decision-1', 'error-3')")  # fmt: skip
def accept_ids(spark, sf_dir):
    rows = display_ids(E.candidates(transcripts(spark, sf_dir)), ("session_id",))
    return chosen(rows, _ACCEPTED).select("session_id", "id", "text", "ord")


#: The memories of each session: exact, contained and similar ones gone.
_MEMORIES = f"""me AS MATERIALIZED (SELECT session_id || chr(1) || category AS scope, norm, MIN(ord) AS ord, arg_min(text, (-length(text), ord)) AS text FROM (
  SELECT session_id, category, line_no * 4294967296 + sent_no AS ord, text, {T.normal_form(DUCK, Sql("text"))} AS norm FROM ca) GROUP BY ALL),
{_contained_sql("mc", "me")}, {_greedy_sql("mg", "mc")},
mm AS MATERIALIZED (SELECT split_part(scope, chr(1), 1) AS session_id, split_part(scope, chr(1), 2) AS category, CAST(ord AS BIGINT) AS ord, text FROM mg)"""
_TO_MEMORIES = _TO_CANDIDATES.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _MEMORIES


@query("extract_signals", f"{_TO_MEMORIES} SELECT session_id, category, ord, text FROM mm")
def extract_signals(spark, sf_dir):
    return E.memories(transcripts(spark, sf_dir))


def _counted(c: str) -> str:
    n, word = f"COUNT(*) FILTER (WHERE category = '{c}')", R.COUNT_WORDS[c]
    return f"CASE WHEN {n} > 0 THEN [{n} || ' {word}' || CASE WHEN {n} = 1 THEN '' ELSE 's' END] ELSE [] END"


_COUNT_ORDER = ["decisions", "bugs", "todos", "errors", "resolved"]


@query("session_summary", f"{_TO_MEMORIES}, sn AS (SELECT session_id, {' || '.join(_counted(c) for c in _COUNT_ORDER)} AS p FROM mm GROUP BY session_id) "
       "SELECT session_id, 'This session captured ' || CASE WHEN len(p) = 1 THEN p[1] ELSE array_to_string(p[1:len(p) - 1], ', ') || ' and ' || p[len(p)] END || '.' AS counts FROM sn")  # fmt: skip
def session_summary(spark, sf_dir):
    """The sentence of counts; topic_focus has what follows it."""
    told = summaries(cut(E.memories(transcripts(spark, sf_dir))))
    return told.select("session_id", F.regexp_replace("summary", r"(?<=\.) Focus areas: .*\z", "").alias("counts"))


@query("topic_focus")
def topic_focus(spark, sf_dir):
    told = summaries(cut(E.memories(transcripts(spark, sf_dir))))
    return told.select("session_id", F.regexp_extract("summary", r" Focus areas: (.*)\.\z", 1).alias("topics"))


@query("rebuild_merge", f"{_TO_MEMORIES}, " + f"""rx AS MATERIALIZED (SELECT category AS scope, norm, MIN(key) AS ord, arg_min(text, (-length(text), key)) AS text FROM (
  SELECT category, session_id || chr(1) || lpad(CAST(ord AS VARCHAR), 19, '0') AS key, text, {T.normal_form(DUCK, Sql("text"))} AS norm FROM mm) GROUP BY ALL),
{_contained_sql("rc", "rx")}, {_greedy_sql("rg", "rc", "y")}
SELECT scope AS category, CAST(split_part(ord, chr(1), 2) AS BIGINT) AS ord, text, split_part(ord, chr(1), 1) AS session FROM rg""")
def rebuild_merge(spark, sf_dir):
    return E.rebuild(transcripts(spark, sf_dir))


# resolution, search -----------------------------------------------------------------


def _distinct_texts(spark, sf_dir) -> DataFrame:
    rows = E.candidates(transcripts(spark, sf_dir)).groupBy("category", "text").agg(F.min(F.struct("session_id", "ord")).alias("k"))
    return cut(rows.select("category", "text", F.concat_ws("/", "category", "k.session_id", F.col("k.ord").cast("string")).alias("ord")))


def _token_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(R.RESOLUTION_STOP))
    raw = rf"string_split_regex(regexp_replace({T.normal_form(DUCK, Sql('text'))}, '[^a-z0-9_.\s-]', ' ', 'g'), '\s+')"
    strip = r"regexp_replace(w, '^[.-]+|[.-]+$', '', 'g')"
    return f"""tk AS (SELECT ord, category, text, c FROM (
  SELECT DISTINCT ord, category, text, w, {T.match_token(DUCK, Sql("w"))} AS c FROM (
    SELECT ord, category, text, UNNEST([w, regexp_extract(w, '^([a-z0-9_-]+)\\.[a-z0-9]+$', 1)]) AS w FROM (
      SELECT ord, category, text, {strip} AS w FROM (SELECT ord, category, text, UNNEST({raw}) AS w FROM dt))))
  WHERE length(c) >= 3 AND w NOT IN ({stop}) AND c NOT IN ({stop}))"""


_RESOLVE = f"""dt AS (SELECT category, text, category || '/' || arg_min(session_id, (session_id, o)) || '/' || arg_min(o, (session_id, o)) AS ord FROM (
  SELECT *, line_no * 10000 + sent_no AS o FROM ca) GROUP BY category, text), {_token_sql()},
tu AS (SELECT DISTINCT ord, category, text, c FROM tk),
rs AS (SELECT a.ord AS open_key, b.ord AS resolved_key FROM tu a JOIN tu b ON a.c = b.c
  JOIN (SELECT ord, COUNT(*) AS n FROM tu GROUP BY ord) k ON k.ord = b.ord
  WHERE a.category IN ('bugs', 'todos') AND b.category = 'resolved' AND {P.resolution(DUCK, Sql("lower(b.text)"))}
  GROUP BY a.ord, b.ord, k.n
  HAVING COUNT(*) >= 3 OR (COUNT(*) >= 2 AND COUNT(*) = k.n) OR COUNT(*) FILTER (WHERE a.c IN ('code', 'fence')) = 2)"""


@query("resolve_pairs", f"{_TO_CANDIDATES}, {_RESOLVE} SELECT open_key, resolved_key FROM rs")
def resolve_pairs(spark, sf_dir):
    rows = _distinct_texts(spark, sf_dir)
    return Rs.resolutions(rows.filter("category IN ('bugs', 'todos')"), rows.filter("category = 'resolved'"))


#: Resolved items of the image worker only, so that other items stay open.
_FEW = "category = 'resolved' AND text LIKE '%image worker%'"


@query("resolve_anti", f"{_TO_CANDIDATES}, {_RESOLVE} SELECT category, text, ord FROM dt WHERE category IN ('bugs', 'todos') AND ord NOT IN "
       f"(SELECT open_key FROM rs WHERE resolved_key IN (SELECT ord FROM dt WHERE {_FEW}))")  # fmt: skip
def resolve_anti(spark, sf_dir):
    rows = _distinct_texts(spark, sf_dir)
    return Rs.still_open(rows.filter("category IN ('bugs', 'todos')"), rows.filter(_FEW)).select("category", "text", "ord")


@query("status_report", f"""{_TO_CANDIDATES}, {_RESOLVE} SELECT category, CAST(COALESCE(n, 0) AS BIGINT) AS n, CAST(COALESCE(o, 0) AS BIGINT) AS open
FROM (SELECT UNNEST([{', '.join(f"'{c}'" for c in R.TITLES)}]) AS category) LEFT JOIN (
  SELECT category, COUNT(*) AS n, COUNT(*) FILTER (WHERE category IN ('bugs', 'todos') AND ord NOT IN (
    SELECT open_key FROM rs)) AS o FROM dt GROUP BY category) USING (category)""")
def status_report(spark, sf_dir):
    rows = _distinct_texts(spark, sf_dir)
    settled = Rs.first_resolver(rows.filter("category IN ('bugs', 'todos')"), rows.filter("category = 'resolved'")).select("open_key")
    return status(rows, settled)


@query("first_resolver", f"{_TO_CANDIDATES}, {_RESOLVE} SELECT open_key, MIN(resolved_key) AS resolved_key FROM rs GROUP BY open_key")
def first_resolver(spark, sf_dir):
    rows = _distinct_texts(spark, sf_dir)
    return Rs.first_resolver(rows.filter("category IN ('bugs', 'todos')"), rows.filter("category = 'resolved'"))


#: A line put under each message, so that aliases and direct matches have work to do.
_NOTES = ["The docs are old", "README.md needs work", "Check the code fence", ""]


def _chat_files(spark, sf_dir) -> DataFrame:
    note = F.element_at(F.array(*map(F.lit, _NOTES)), (F.col("conv_id") % 4 + 1).cast("int"))
    text = F.concat("text", F.lit("\n"), note)
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(text, "\n", -1)).alias("i", "text"))
    return rows.select(F.col("conv_id").cast("string").alias("file"), F.concat_ws("/", F.lpad(F.col("turn").cast("string"), 19, "0"), F.lpad(F.col("i").cast("string"), 19, "0")).alias("line_no"), "text")


def _find(name: str, term: str):
    direct, every = Q.expand(term)
    has = lambda terms: "(" + " OR ".join(f"contains(lower(text), '{t}')" for t in terms) + ")"
    prefers = f"AND ({has(direct)} OR NOT EXISTS (SELECT 1 FROM h WHERE {has(direct)}))" if term.lower() in R.DIRECT_FIRST else ""

    @query(name, f"""WITH f AS (SELECT CAST(conv_id AS VARCHAR) AS file, lpad(CAST(turn AS VARCHAR), 19, '0') || '/' || lpad(CAST(u.i AS VARCHAR), 19, '0') AS line_no, {DUCK.trim(Sql("u.line"))} AS text FROM conversations c, LATERAL (
  SELECT UNNEST(ls) AS line, UNNEST(range(len(ls))) AS i FROM (SELECT string_split(c.text || chr(10) || [{", ".join(f"'{n}'" for n in _NOTES)}][c.conv_id % 4 + 1], chr(10)) AS ls)) u),
h AS (SELECT * FROM f WHERE text <> '' AND NOT starts_with(text, '#') AND {has(every)}),
m AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY file ORDER BY line_no) AS k FROM h WHERE TRUE {prefers})
SELECT file, line_no, text FROM m WHERE k <= {R.MATCHES_PER_FILE}""")
    def run(spark, sf_dir):
        return Q.search(_chat_files(spark, sf_dir), term)


_find("find_keyword", "The")
_find("find_alias", "docs")
_find("find_direct_preferred", "README.md")


@query("inject_context")
def inject_context(spark, sf_dir):
    rows = E.candidates(transcripts(spark, sf_dir)).select(F.concat("category", F.lit(".md")).alias("file"), F.concat_ws("/", "session_id", F.col("ord").cast("string")).alias("k"), "text")
    lines = cut(numbered(rows, "file", ["k"], "line_no").select("file", "line_no", F.concat(F.lit("- "), "text").alias("text")))
    return spark.createDataFrame([(Q.context(lines, "parser"),)], "context string")


def _as_sessions(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("session_id")).agg(F.max("ts").alias("mtime"))


@query("newest_sessions", """SELECT session_id, mtime FROM (
  SELECT CAST(user_id AS VARCHAR) AS session_id, MAX(ts) AS mtime FROM events GROUP BY user_id) ORDER BY mtime DESC, session_id DESC LIMIT 10""")
def newest_sessions(spark, sf_dir):
    return newest(_as_sessions(spark, sf_dir), 10)


#: Every third user was reviewed: markers carry a path, as a review leaves them.
@query("pending_sessions", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS session_id FROM events WHERE user_id % 3 <> 0")
def pending_sessions(spark, sf_dir):
    sessions = _as_sessions(spark, sf_dir)
    markers = sessions.filter("CAST(session_id AS BIGINT) % 3 = 0").select(F.concat(F.lit("sessions/"), "session_id", F.lit(".md")).alias("session"))
    return pending(sessions, markers).select("session_id")
