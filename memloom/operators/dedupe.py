"""De-duplication of short texts: exact, contained, similar. Nothing compares all pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import text as T
from memloom.functions.dialect import SPARK as d
from memloom.functions.rules import SIMILAR_PERCENT
from memloom.operators.graph import connected_components, numbered
from memloom.plans.session import cut

#: Least length of a form, width of its grams, and how many in a row offer the least of them.
WINDOWS = [(8, 8, 1), (32, 16, 17)]
#: Rows of a scope that are compared with each other as they are, without grams.
FEW = 500


def exact_distinct(items: DataFrame, scope: list[str], order: str = "ord") -> DataFrame:
    """Of equal normal forms the longest text, at the first one's place: (scope, ord, text, norm)."""
    rows = items.withColumn("norm", T.normal_form(d, F.col("text")))
    best = F.min_by("text", F.struct((-F.length("text")).alias("n"), F.col(order).alias("o")))
    return rows.groupBy(*scope, "norm").agg(F.min(order).alias(order), best.alias("text")).select(*scope, order, "text", "norm")


def _grams(width: int):
    starts = F.sequence(F.lit(1), F.greatest(F.length("norm") - width + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.substring("norm", i, F.lit(width)))


def _least_in_windows(items: str, many: int):
    starts = F.sequence(F.lit(1), F.size(items) - (many - 1))
    return F.transform(starts, lambda i: F.array_min(F.slice(items, i, F.lit(many))))


def _by_size(items: DataFrame, scope: list[str], few: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of scopes of up to `few` rows, rows of larger ones if there are any).

    Of large scopes there is at most one to `few` rows: their names are broadcast, so that their rows stay where they are.
    """
    sizes = items.groupBy(*scope).agg(F.count(F.lit(1)).alias("_rows"))
    large = cut(sizes.filter(F.col("_rows") > few).select(*scope))
    if large.isEmpty():
        return items, None
    return tuple(items.join(F.broadcast(large), scope, how).select(*items.columns) for how in ("left_anti", "left_semi"))


def contained(items: DataFrame, scope: list[str], order: str = "ord", few: int = FEW) -> DataFrame:
    """Rows whose normal form stands inside a longer one of their scope are dropped.

    Rows of a scope of up to `few` are compared with each other, those of a larger one by grams.
    """
    small, large = _by_size(items, scope, few)
    lists = small.groupBy(*scope).agg(F.collect_list("norm").alias("_all"))
    inside = F.exists("_all", lambda x: (F.length(x) > F.length("norm")) & F.contains(x, F.col("norm")))
    kept = small.join(lists, scope, "left").filter(~F.coalesce(inside, F.lit(False))).select(*items.columns)
    if large is None:
        return kept
    return kept.unionByName(large.join(_contained_by_grams(large, scope), [*scope, "norm"], "left_anti").select(*items.columns))


def _contained_by_grams(items: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, norm) of rows whose normal form stands inside a longer one of their scope.

    A form of a few characters is a gram of its container. A longer one looks for containers
    through the least hash of its grams: wherever the form stands, that is the least of the
    grams in a row around it, so containers offer only these. Pairs are of numbers; texts are
    fetched for pairs alone.
    """
    rows = cut(items.select(*scope, "norm", F.length("norm").alias("_n"), F.monotonically_increasing_id().alias("_id")))
    least = WINDOWS[0][0]
    hits = rows.filter("_n = 0").join(rows.filter("_n > 0").select(*scope).distinct(), scope, "left_semi").select("_id")
    for (w,) in sorted(map(tuple, rows.filter((F.col("_n") > 0) & (F.col("_n") < least)).select("_n").distinct().collect())):
        offers = rows.filter(F.col("_n") > w).select(*scope, F.explode(F.array_distinct(_grams(w))).alias("norm")).distinct()
        hits = hits.unionAll(rows.filter(F.col("_n") == w).join(offers, [*scope, "norm"], "left_semi").select("_id"))
    for (low, width, many), (high, *_) in zip(WINDOWS, [*WINDOWS[1:], (None,)], strict=True):
        own = rows.filter(F.col("_n") >= low) if high is None else rows.filter((F.col("_n") >= low) & (F.col("_n") < high))
        hashes = F.transform(_grams(width), lambda g: F.xxhash64(g))
        probes = own.select(*scope, F.col("_id").alias("_a"), F.col("_n").alias("_na"), F.array_min(hashes).alias("_h"))
        bound = rows.filter(F.col("_n") > low).select(*scope, F.col("_id").alias("_b"), F.col("_n").alias("_nb"), F.explode(F.array(hashes)).alias("_g"))
        windows = F.col("_g") if many == 1 else _least_in_windows("_g", many)
        offers = bound.select(*scope, "_b", "_nb", F.explode(F.array_distinct(windows)).alias("_h"))
        pairs = probes.join(offers, [*scope, "_h"]).filter("_nb > _na").select("_a", "_b")
        text = lambda n, t: rows.select(F.col("_id").alias(n), F.col("norm").alias(t))
        found = pairs.join(text("_a", "_small"), "_a").join(text("_b", "_big"), "_b").filter(F.contains("_big", "_small"))
        hits = hits.unionAll(found.select(F.col("_a").alias("_id")))
    return rows.join(hits.distinct(), "_id", "left_semi").select(*scope, "norm")


def bigrams(norm):
    """Bigrams of a text, the k-th occurrence marked as such: equal sets are equal multisets."""
    raw = F.when(F.length(norm) >= 2, F.transform(F.sequence(F.lit(1), F.length(norm) - 1), lambda i: F.substring(norm, i, F.lit(2))))
    sorted_ = F.sort_array(F.coalesce(raw, F.array().cast("array<string>")))
    # in the sorted list, the k-th occurrence stands k places after the first
    numbered = lambda s: F.transform(s, lambda x, i: F.concat(x, F.lit("#"), (i + 2 - F.array_position(s, x)).cast("string")))
    return F.element_at(F.transform(F.array(sorted_), numbered), 1)


def _close(percent: int):
    """Of rows with sizes na and nb: whether these allow for a Dice of `percent` / 100."""
    return (F.col("a") < F.col("b")) & (F.col("na") * (200 - percent) >= F.col("nb") * percent) & (F.col("nb") * (200 - percent) >= F.col("na") * percent)


def similar_pairs(items: DataFrame, scope: list[str], order: str = "ord", percent: int = SIMILAR_PERCENT, few: int = FEW) -> DataFrame:
    """(scope, a, b) with a < b in order: pairs whose bigram Dice is at least `percent` / 100.

    Rows of a scope of up to `few` are compared with each other, those of a larger one in blocks.
    """
    small, large = _by_size(items, scope, few)
    lists = small.select(*scope, F.col(order).alias("o"), F.explode(F.array(bigrams(F.col("norm")))).alias("_b"))
    lists = cut(lists.withColumn("n", F.size("_b")).filter("n > 0"))
    a, b = (lists.withColumnsRenamed({"o": x, "_b": f"b{x}", "n": f"n{x}"}) for x in "ab")
    shared = F.size(F.array_intersect("ba", "bb"))
    pairs = a.join(b, scope).filter(_close(percent)).filter(shared * 200 >= (F.col("na") + F.col("nb")) * percent).select(*scope, "a", "b")
    if large is None:
        return pairs
    return pairs.unionByName(_similar_in_blocks(large, scope, order, percent))


#: Rows of a block, and columns of a matrix at once.
BLOCK, COLUMNS = 16_384, 2_048


def _similar_in_blocks(items: DataFrame, scope: list[str], order: str, percent: int) -> DataFrame:
    """The pairs of large scopes: rows by number of bigrams in blocks, a task for each two blocks whose sizes allow for similar rows.

    Lines of a language share most of their bigrams, so no few of them tell candidates apart:
    rows that share a rare one are nearly all pairs, and listing them takes the disk. Here all
    pairs of two blocks are a product of matrices and only similar ones leave the task.
    """
    code = lambda x, i: F.ascii(F.substring(x, i, 1)).cast("long")
    token = lambda x: code(x, 1) + F.shiftleft(code(x, 2), 21) + F.shiftleft(F.substring(x, 4, 20).cast("long"), 42)
    rows = items.select(*scope, F.col(order).alias("o"), F.monotonically_increasing_id().alias("id"), F.explode(F.array(bigrams(F.col("norm")))).alias("_b"))
    rows = cut(rows.select(*scope, "o", "id", F.size("_b").alias("n"), F.transform("_b", token).alias("t")).filter("n > 0"))
    one = rows.withColumn("s", F.to_json(F.struct(*scope)))
    one = numbered(one.select("s", "id", "n", "t"), "s", ["n", "id"], "k").withColumn("x", F.floor((F.col("k") - 1) / BLOCK))
    one = cut(one.drop("k"))
    sizes = one.groupBy("s", "x").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    a, b = sizes.select("s", F.col("x").alias("i"), "high"), sizes.select("s", F.col("x").alias("j"), "low")
    tasks = a.join(b, "s").filter((F.col("i") <= F.col("j")) & (F.col("high") * (200 - percent) >= F.col("low") * percent))
    tasks = cut(tasks.select("s", "i", "j").withColumn("task", F.monotonically_increasing_id()))
    side = lambda c: one.join(tasks.select("s", F.col(c).alias("x"), "task"), ["s", "x"]).select("task", F.lit(c).alias("side"), "id", "n", "t")
    both = side("i").unionAll(side("j").join(tasks.filter("i < j").select("task"), "task", "left_semi"))
    found = cut(both.groupBy("task").applyInPandas(_compared(percent), "x long, y long"))
    ends = rows.select(*scope, "id", "o")
    found = found.join(ends.withColumnsRenamed({"id": "x", "o": "p"}), "x").join(ends.select(F.col("id").alias("y"), F.col("o").alias("q")), "y")
    first = F.col("p") < F.col("q")
    return found.select(*scope, F.when(first, F.col("p")).otherwise(F.col("q")).alias("a"), F.when(first, F.col("q")).otherwise(F.col("p")).alias("b"))


def _compared(percent: int):
    """(x, y) of the rows of two blocks, or of one, whose Dice is at least `percent` / 100."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        a = rows[rows["side"] == "i"]
        alone = not (rows["side"] == "j").any()
        b = a if alone else rows[rows["side"] == "j"]
        known = np.intersect1d(np.unique(np.concatenate(a["t"].to_numpy())), np.unique(np.concatenate(b["t"].to_numpy())))
        na, nb, xs, ys = a["n"].to_numpy(), b["n"].to_numpy(), [], []
        ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
        places = [_places(side, known) for side in ((a,) if alone else (a, b))]
        for at in range(0, len(a), COLUMNS):
            some = slice(at, at + COLUMNS)
            shared = np.zeros((len(na[some]), len(b)), dtype=np.float32)
            for start in range(0, len(known), COLUMNS):
                left = _matrix(places[0], at, min(at + COLUMNS, len(a)), start)
                for row in range(0, len(b), COLUMNS):
                    shared[:, row : row + COLUMNS] += left @ _matrix(places[-1], row, min(row + COLUMNS, len(b)), start).T
            i, j = np.nonzero(shared * 200 >= (na[some, None] + nb[None, :]) * percent)
            if alone:
                i, j = i[i + at < j], j[i + at < j]
            xs.append(ia[i + at])
            ys.append(ib[j])
        return pd.DataFrame({"x": np.concatenate(xs), "y": np.concatenate(ys)})

    return compare


def _places(rows: pd.DataFrame, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the tokens that are known: where each row's end, and their places."""
    tokens, sizes = np.concatenate(rows["t"].to_numpy()), rows["n"].to_numpy()
    place = np.searchsorted(known, tokens)
    good = known[np.minimum(place, len(known) - 1)] == tokens if len(known) else np.zeros(len(tokens), dtype=bool)
    row = np.repeat(np.arange(len(rows)), sizes)[good]
    return np.searchsorted(row, np.arange(len(rows) + 1)), place[good]


def _matrix(places: tuple[np.ndarray, np.ndarray], low: int, high: int, start: int) -> np.ndarray:
    """Ones where rows low to high have the tokens from `start` on."""
    ends, place = places
    out = np.zeros((high - low, COLUMNS), dtype=np.float32)
    row = np.repeat(np.arange(high - low), np.diff(ends[low : high + 1]))
    column = place[ends[low] : ends[high]] - start
    here = (column >= 0) & (column < COLUMNS)
    out[row[here], column[here]] = 1
    return out


#: Links of a component that one task settles; larger ones are settled in rounds.
TOGETHER = 100_000


def similar(items: DataFrame, scope: list[str], order: str = "ord", together: int = TOGETHER) -> DataFrame:
    """Greedy removal of similar rows: in order, of a similar pair the longer text stays, ties the earlier.

    The greedy is exact within a connected component, so components run side by side: those
    of up to `together` links in one task each, larger ones in rounds over all tasks. Orders
    may be of any sortable type; they are unique within a scope.
    """
    node = lambda o: F.xxhash64(*scope, o)
    pairs = cut(similar_pairs(items, scope, order).select(*scope, "a", "b", node("a").alias("na"), node("b").alias("nb")))
    n = pairs.count()
    if not n:
        return items
    if n <= together:  # one task settles them all, so they need not be told apart
        nodes = pairs.select("na").unionAll(pairs.select("nb")).distinct()
        roots = nodes.select(F.col("na").alias("node"), F.lit(0).cast("long").alias("root"))
    else:
        roots = connected_components(pairs.select(F.col("na").alias("a"), F.col("nb").alias("b")))
        roots = cut(roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct()))
    members = items.withColumn("node", node(order)).join(roots, "node")
    # places within a component are whole numbers, whatever the order is made of
    place = F.row_number().over(Window.partitionBy("root").orderBy(*scope, order)).cast("long")
    members = cut(members.select("root", "node", *scope, F.col(order).alias("o"), F.length("text").cast("long").alias("size"), place.alias("k")))
    side = lambda n, k, size: members.select(F.col("node").alias(n), F.col("k").alias(k), F.col("size").alias(size))
    links = pairs.select("na", "nb").join(members.select(F.col("node").alias("na"), "root", F.col("k").alias("i"), F.col("size").alias("si")), "na")
    links = cut(links.join(side("nb", "j", "sj"), "nb").select("root", "i", "j", "si", "sj"))
    small, large = links, None
    if n > together:
        large = cut(links.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > together).select("root"))
        small = links.join(large, "root", "left_anti")
    small = small.groupBy("root").agg(F.collect_list(F.array("i", "j", "si", "sj")).alias("links"))
    gone = small.mapInPandas(_settle, "root long, k long")
    if large is not None and not large.isEmpty():
        gone = gone.unionAll(_settle_in_rounds(cut(links.join(large, "root", "left_semi"))))
    dropped = members.join(gone, ["root", "k"], "left_semi").select(*scope, F.col("o").alias(order))
    return items.join(dropped, [*scope, order], "left_anti").select(*items.columns)


def _settle(batches):
    """The greedy over the links (i, j, size of i, size of j) of whole components."""
    for rows in batches:
        roots, gone = [], []
        for root, links in zip(rows["root"], rows["links"], strict=True):
            dead = set()
            for i, j, si, sj in sorted(map(tuple, links)):
                if i not in dead and j not in dead:
                    dead.add(i if sj > si else j)
            roots += [root] * len(dead)
            gone += dead
        yield pd.DataFrame({"root": pd.Series(roots, dtype="int64"), "k": pd.Series(gone, dtype="int64")})


def _settle_in_rounds(links: DataFrame) -> DataFrame:
    """(root, k) that the greedy removes, all components and all their settled parts at once.

    A row comes next if it is the least of all its neighbours' neighbours: it removes its
    neighbours up to the first longer one, which removes it. The least row of a component
    always comes next, so each round settles some of it.
    """
    found, both = None, lambda x: x.select("root", F.col("i").alias("k"), F.col("j").alias("o")).unionAll(x.select("root", F.col("j").alias("k"), F.col("i").alias("o")))
    while not links.isEmpty():
        least = both(links).groupBy("root", "k").agg(F.min("o").alias("least"))
        seen = links.join(least.select("root", F.col("k").alias("i"), F.col("least").alias("li")), ["root", "i"])
        seen = seen.join(least.select("root", F.col("k").alias("j"), F.col("least").alias("lj")), ["root", "j"])
        own = seen.groupBy("root", "i").agg(
            F.min(F.when((F.col("li") < F.col("i")) | (F.col("lj") < F.col("i")), F.col("j"))).alias("wait"),
            F.min(F.when(F.col("sj") > F.col("si"), F.col("j"))).alias("longer"),
        )
        own = own.withColumn("turn", F.col("longer").isNotNull() & (F.col("wait").isNull() | (F.col("longer") < F.col("wait"))))
        done = links.join(own, ["root", "i"])
        until = F.when(F.col("turn"), F.col("longer")).otherwise(F.col("wait"))
        lost = done.filter(until.isNull() | (F.col("j") < until)).select("root", F.col("j").alias("k"))
        lost = cut(lost.unionAll(own.filter("turn").select("root", F.col("i").alias("k"))).distinct())
        found = lost if found is None else cut(found.unionAll(lost))
        for end in ("i", "j"):
            links = links.join(lost.withColumnRenamed("k", end), ["root", end], "left_anti")
        links = cut(links)
    return found


def dedupe(items: DataFrame, scope: list[str], order: str = "ord") -> DataFrame:
    """Exact, then contained, then similar: (scope, ord, text, norm)."""
    rows = cut(exact_distinct(items.select(*scope, order, "text"), scope, order))
    return similar(cut(contained(rows, scope, order)), scope, order)
