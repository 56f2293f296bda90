"""What must not grow with repeats, nor with the square of a group."""

from pyspark.sql import functions as F

from memloom.operators import dedupe as D
from memloom.operators import resolve as Rs
from memloom.operators import segment as G
from memloom.plans import queries as library
from memloom.plans.session import prepared, told


def test_rules_see_each_text_once(spark, monkeypatch):
    seen = []

    def watched(rows, on, answer):
        return told(rows, on, lambda x: (seen.append(x.count()), answer(x))[1])

    monkeypatch.setattr(G, "told", watched)
    text = "The parser does not load stale tokens, which is a bug.\nWe decided to use JWT auth for the parser.\n"
    sessions = prepared(spark).createDataFrame([(f"s{k}", text * 5) for k in range(20)], "session_id string, raw_text string")
    rows = G.by_line(sessions, lambda lines, line: G.candidates(G.sentences(lines, line)))
    assert rows.count() == 200  # all places are there
    assert max(seen) <= 3  # two lines and the blank one


def test_told_keeps_nulls_and_repeats(spark):
    rows = prepared(spark).createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "k int, t string")
    out = told(rows, "t", lambda x: x.filter("t IS NULL OR t <> 'b'").select("t", F.length(F.coalesce("t", F.lit(""))).alias("n")))
    assert sorted(map(tuple, out.select("k", "t", "n").collect())) == [(1, "a", 1), (2, "a", 1), (3, None, 0)]


def test_exploded_rows_are_not_broadcast_by_a_guess(spark):
    """The guess for exploded rows is that of the text they came from; only measured sizes count."""
    rows = prepared(spark).createDataFrame([(k, "x" * 50) for k in range(50)], "k int, t string")
    grams = rows.select("k", F.explode(F.split("t", "")).alias("g"))
    plan = grams.join(rows, "k")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_small_scopes_agree_with_grams(spark):
    texts = ["a cat sat on the mat", "cat sat", "the cat sat on the mat here", "", "dog", "a dog ran", "the dog ran off", "dog ran", "Dog ran!"]
    rows = spark.createDataFrame([(s, k, t) for s in ("x", "y", None) for k, t in enumerate(texts)], "scope string, ord long, text string")
    exact = D.exact_distinct(rows, ["scope"])
    few, many = (sorted(map(str, D.contained(exact, ["scope"], few=n).collect())) for n in (500, 0))
    assert few == many
    few, many = (sorted(map(tuple, D.similar_pairs(exact, ["scope"], percent=50, few=n).collect())) for n in (500, 0))
    assert few == many and few


def test_forms_of_all_lengths_are_found_in_large_scopes(spark):
    words = [f"w{(k * k * 7919) % 9973}" for k in range(400)]
    texts = [" ".join(words[k : k + n]) for k in range(0, 380, 7) for n in (1, 2, 4, 7, 12, 19)]
    rows = spark.createDataFrame([("x", k, t[k % 3 :]) for k, t in enumerate(texts)], "scope string, ord long, text string")
    exact = D.exact_distinct(rows, ["scope"])
    norms = [r.norm for r in exact.collect()]
    want = sorted(a for a in norms if not any(len(b) > len(a) and a in b for b in norms))
    assert sorted(r.norm for r in D.contained(exact, ["scope"], few=0).collect()) == want and len(want) < len(norms)


def test_first_resolver_is_the_least_of_all_pairs(spark):
    words = ["parser", "cache", "token", "login", "queue", "code", "fence", "index", "mail"]
    texts = [" ".join(words[(k * j) % 9] for j in range(1, 2 + k % 6)) for k in range(40)]
    long = " ".join(f"word{k}x" for k in range(30))
    rows = [(f"o{k:02}", t) for k, t in enumerate([*texts, long])]
    done = [(f"r{k:02}", "Fixed " + t) for k, t in enumerate([*texts[::-1], long + " more"])]
    a, b = (spark.createDataFrame(x, "ord string, text string") for x in (rows, done))
    least = {}
    for o, r in map(tuple, Rs.resolutions(a, b).collect()):
        least[o] = min(r, least.get(o, r))
    assert least["o40"]
    for together in (20, 3):
        assert dict(map(tuple, Rs.first_resolver(a, b, together=together).collect())) == least


def test_status_is_of_all_resolved_items():
    assert "image worker" not in library.ORACLE_SQL["status_report"].split("SELECT category, CAST(COALESCE")[1]
