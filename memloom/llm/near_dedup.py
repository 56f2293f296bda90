"""Near dedup by SimHash and anchor-point covering, decided by the Jaccard similarity of word shingles.

Fingerprints only propose. A bit of the SimHash of two sets of Jaccard similarity s differs
with a probability of about acos(2s / (1 + s)) / pi at most, 0.151 at 0.8, so 64 bits and a
small distance lose most pairs; of few shingles up to SMALL times that, 3/16 for 4 of 5. Here a
fingerprint is long and cut into slices. A slice of 16 bits of a pair of 0.8 differs in at most
DISTANCE bits with probability 0.557 (4 of 5: 0.400); that none of 23 does has probability 7e-9
(4 of 5: 8e-6). Larger tables take more and longer slices (`plan`).

Each slice is searched by anchor-point covering as in simhash.py: fingerprints live at home
anchors of a covering code and visit every anchor in reach of DISTANCE changes. A slice is
dealt out by its thirds: of DISTANCE changes one third has none, so a pair agrees in it, and
a task covers the other two thirds of what agrees there. Who meets at an anchor is linked
if PRINT words of the fingerprints differ in no more bits than a pair of the similarity does,
6.5 deviations included. Components of these links are clusters. A family of near copies is
linked anew in every slice; so one slice goes ahead, and the others link its components, not
their documents. Within a cluster shingle sets decide, exactly: its true components over pairs
of at least the similarity keep one row each.

A cluster of up to CHUNK shingles is settled in one task. A larger one is dealt out in
chunks of about that size. Each chunk finds its own components; a few members of the
largest of each chunk show which of these belong together. What is outside of the giant
that so arises meets every chunk. All pairs but those within the giant are so compared,
and no task holds more than two chunks.

Texts are never shuffled, and shingle sets only of documents that are linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from memloom.llm.common import KeyFilter, Scratch, drop_rows, packed, python_workers
from memloom.llm.graph import connected_components
from memloom.llm.rolling import mix64
from memloom.llm.simhash import visits

WIDTH, PERCENT = 5, 80
SEED = 42
#: Changes of a slice that the covering reaches, how much oftener bits of few shingles differ,
#: and the probability with which such a pair may differ more in all slices.
DISTANCE, SMALL, MISSED = 2, 1.24, 1e-5
#: Words of the fingerprint that links are judged by.
PRINT = 3
_PRINTS = [f"p{k}" for k in range(PRINT)]
_SALT = np.random.default_rng(SEED).integers(0, 1 << 64, size=64, dtype=np.uint64)
_BLOCK = 128
#: Rows of a third that a task should have, homes at an anchor beyond which it is crowded, pairs and visitors at once.
DEAL, CROWD, _PAIRS, _VISITORS = 1 << 16, 64, 1 << 20, 4096
_TOP = 1 << 20
#: Slices that go ahead of the others, and prints that a task deals out.
AHEAD, TASK = 1, 4096
#: Shingles that a task compares at once, and members of a chunk's largest component that speak for it.
CHUNK, SPEAKERS = 2_000_000, 16


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct word shingles, A-Z lower-cased; no words: 0; few words: the one of all."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(1, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    last = max(0, len(words) - width)
    starts = np.concatenate([[0], ends])[: last + 1].tolist()
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    found = {joined[a:b] for a, b in zip(starts, stops, strict=True)}
    return np.unique(np.fromiter((xxh64_intdigest(x, SEED) for x in found), dtype=np.uint64, count=len(found)))


class Plan(NamedTuple):
    """How fingerprints are cut and dealt out, for a number of documents."""

    bits: int
    slices: int
    thirds: list[int]
    #: of each third: bits that it is dealt out by, and blocks of the code that covers the others
    dealt: list[int]
    blocks: list[int]
    #: bits in which linked fingerprints differ at most: in the first word, and in PRINT words
    first: int
    most: int


def plan(n: int, percent: int = PERCENT) -> Plan:
    """Longer slices for larger tables, so that few share an anchor by chance, and so many that a pair is missed with MISSED."""
    size = math.log2(max(2, n))
    bits = min(48, max(16, 2 * round((size - 3) / 2)))
    share = percent / 100
    flip = math.acos(2 * share / (1 + share)) / math.pi
    worst = min(0.5, SMALL * flip)
    near = sum(math.comb(bits, k) * worst**k * (1 - worst) ** (bits - k) for k in range(DISTANCE + 1))
    slices = max(math.ceil(64 * PRINT / bits), math.ceil(math.log(MISSED) / math.log1p(-near)) if near < 1 else 1)
    half = bits // 2
    thirds = [2 * (half // 3 + (k >= 3 - half % 3)) for k in range(3)]
    dealt = [min(x, max(0, math.ceil(size - math.log2(DEAL)))) for x in thirds]
    blocks = [min(bits - x, max(2, 2 * round((size - x - 2) / 2))) for x in thirds]
    first, most = (int(w * flip + 6.5 * math.sqrt(w * flip * (1 - flip))) for w in (64, 64 * PRINT))
    return Plan(bits, slices, thirds, dealt, blocks, first, most)


def long_print(hashes: np.ndarray, words: int) -> np.ndarray:
    """The bits, 0 or 1, of a SimHash of `words` words: what over half of the (scrambled) hashes have set.

    The least hash decides ties: without that, few and even hashes would have too many zeros, and be near by chance.
    """
    ones = np.zeros(64 * words, dtype=np.int64)
    for k in range(0, len(hashes), _BLOCK):
        h = mix64(hashes[k : k + _BLOCK, None] ^ _SALT[:words])
        bits = np.unpackbits(h.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
        lead = bits[0] if not k else lead
    return (2 * ones + lead > len(hashes)).astype(np.uint8)


def _without(words: np.ndarray, at: int, size: int) -> np.ndarray:
    """Words without the `size` bits from bit `at` on."""
    low = np.uint64((1 << at) - 1)
    return (words & low) | ((words >> np.uint64(at + size)) << np.uint64(at))


def _printed(width: int, p: Plan):
    """Of each document a row: its long print, as bytes."""
    words = math.ceil(p.slices * p.bits / 64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            packed_bits = [np.packbits(long_print(shingles(t, width), words), bitorder="little").tobytes() for t in rows["t"]]
            yield pd.DataFrame({"id": rows["id"].to_numpy(), "bits": packed_bits})

    return run


def _dealt(p: Plan, first: int, last: int):
    """Of each print, slice from `first` to before `last`, and third a row: where it is dealt to, the slice, and the words that judge."""
    weights = np.uint64(1) << np.arange(p.bits, dtype=np.uint64)
    number = np.arange(first, last, dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            whole = np.stack([np.frombuffer(x, np.uint8) for x in rows["bits"]])
            prints = np.ascontiguousarray(whole[:, : 8 * PRINT]).view("<i8")
            cut = np.unpackbits(whole, axis=1, bitorder="little")[:, first * p.bits : last * p.bits].reshape(len(rows), len(number), p.bits)
            slices = (cut * weights).sum(axis=2, dtype=np.uint64)
            for third, size in enumerate(p.thirds):
                value = (slices >> np.uint64(sum(p.thirds[:third]))) & np.uint64((1 << size) - 1)
                deal = (number * np.uint64(3) + np.uint64(third)) * np.uint64(_TOP) + (value >> np.uint64(size - p.dealt[third]))
                out = {"deal": deal.ravel().view(np.int64), "id": np.repeat(rows["id"].to_numpy(), len(number)), "word": slices.ravel().view(np.int64)}
                yield pd.DataFrame(out | {c: np.repeat(prints[:, k], len(number)) for k, c in enumerate(_PRINTS)})

    return run


def _dealt_rows(width: int, p: Plan):
    """Texts as the rows of all slices at once."""
    return lambda batches: _dealt(p, 0, p.slices)(_printed(width, p)(batches))


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least indices of components, with links (i, j) added."""
    while len(i):
        low = np.minimum(label[i], label[j])
        for x in (label[i], label[j]):
            np.minimum.at(label, x, low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return label


def _spread(who: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for each i of `who` and each j of its range, some _PAIRS at a time."""
    n = high - low
    some = n > 0
    who, low, n = who[some], low[some], n[some]
    ends = np.cumsum(n)
    cuts = np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, _PAIRS), "left").tolist() + [len(n)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            m = n[a:b]
            yield np.repeat(who[a:b], m), np.repeat(low[a:b] - np.cumsum(m) + m, m) + np.arange(m.sum())


def _met(p: Plan):
    """Rows that agree in (a part of) a third of a slice: a spanning forest (a, b) of the links between those who meet at an anchor.

    Rows of one id are linked from the start. The least id of a tree names it, so that forests of several slices share links.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        third = int(rows["deal"].iloc[0]) // _TOP % 3
        size, at, blocks = p.thirds[third], sum(p.thirds[:third]), p.blocks[third]
        words = rows["word"].to_numpy().view(np.uint64)
        agreed = ((words >> np.uint64(at)) & np.uint64((1 << size - p.dealt[third]) - 1)) << np.uint64(blocks)
        others, free = _without(words, at, size), p.bits - size
        homes = agreed | visits(others, blocks, 0, free)[0]
        order = np.argsort(homes, kind="stable")
        homes, agreed, others = homes[order], agreed[order], others[order]
        ids, prints = rows["id"].to_numpy()[order], [rows[c].to_numpy()[order].view(np.uint64) for c in _PRINTS]
        starts = np.searchsorted(homes, np.arange((1 << blocks + size - p.dealt[third]) + 1, dtype=np.uint64))
        _, lead, at_id = np.unique(ids, return_index=True, return_inverse=True)
        label = lead[at_id]

        def near(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            d = np.bitwise_count(prints[0][i] ^ prints[0][j])
            some = np.flatnonzero(d <= p.first)
            i, j, d = i[some], j[some], d[some].astype(np.int64)
            for x in prints[1:]:
                d += np.bitwise_count(x[i] ^ x[j])
            return i[d <= p.most], j[d <= p.most]

        def reached(visitors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(visitor, anchor) up to the own home: of a pair one visits the other."""
            anchors, who, _ = visits(others[visitors], blocks, DISTANCE, free)
            who = visitors[who]
            anchors = anchors | agreed[who]
            up = anchors <= homes[who]
            return who[up], anchors[up].astype(np.int64)

        crowded = np.diff(starts) > CROWD
        if crowded.any():  # links to one of each crowded anchor tell which pairs need no comparison
            rng, there = np.random.default_rng(SEED), np.flatnonzero(crowded)
            members = np.flatnonzero(crowded[homes.astype(np.int64)])
            for _ in range(4):
                pick = np.zeros(len(crowded), dtype=np.int64)
                pick[there] = rng.integers(starts[there], starts[there + 1])
                label = _joined(label, *near(members, pick[homes[members].astype(np.int64)]))
                who, anchor = reached(pick[there])
                label = _joined(label, *near(who[crowded[anchor]], pick[anchor[crowded[anchor]]]))
        # homes of an anchor stand by their label, and a visitor passes over those of its own
        named = label.copy()
        by = np.lexsort((named, homes))
        place = homes[by].astype(np.int64) * len(rows) + named[by]
        for k in range(0, len(rows), _VISITORS):
            who, anchor = reached(np.arange(k, min(k + _VISITORS, len(rows))))
            low, high = starts[anchor], starts[anchor + 1]
            full = crowded[anchor]
            own = anchor[full] * len(rows) + named[who[full]]
            mid = high.copy()
            mid[full] = np.searchsorted(place, own, "left")
            after = np.searchsorted(place, own, "right")
            for i, j in _spread(np.concatenate([who, who[full]]), np.concatenate([low, after]), np.concatenate([mid, high[full]])):
                label = _joined(label, *near(i, by[j]))
        least = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids)
        out = pd.DataFrame({"a": ids, "b": least[label]})
        return out[out["a"] != out["b"]].drop_duplicates()

    return run


def linked(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Of each set the least index that pairs of a Jaccard similarity of `percent` or more reach."""
    label = np.full(len(sets), -1)
    sizes = np.array([len(x) for x in sets])
    left, indexed = len(sets), 1 << 62
    for start in range(len(sets)):
        if label[start] >= 0:
            continue
        label[start], left, due = start, left - 1, [start]
        while due and left:
            x = sets[due.pop()]
            if 2 * left <= indexed:  # an index of what is not reached yet
                rest = np.flatnonzero(label < 0)
                flat, owner = np.concatenate([sets[k] for k in rest]), np.repeat(rest, sizes[rest])
                order = np.argsort(flat)
                flat, owner, indexed = flat[order], owner[order], left
            a, b = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
            n = b - a
            shared = np.bincount(owner[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))
            near = np.flatnonzero((shared > 0) & (label < 0) & (shared * 100 >= percent * (sizes + len(x) - shared)))
            label[near] = start
            left -= len(near)
            due += near.tolist()
    return label


def _labels(rows: pd.DataFrame, percent: int) -> np.ndarray:
    """Of each row the id of the first row, by (last, k, id), of its component; rows are in that order."""
    return rows["id"].to_numpy()[linked([np.frombuffer(x, "<u8") for x in rows["shingles"]], percent)]


def _copies(percent: int):
    """A cluster: the rows that are not the first of their component."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["last", "k", "id"])
        return pd.DataFrame({"id": rows["id"].to_numpy()[rows["id"].to_numpy() != _labels(rows, percent)]})

    return run


def _chunk(percent: int):
    """A chunk: its rows with their labels, the size of their component, and whether they speak for the largest one."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["last", "k", "id"])
        label = _labels(rows, percent)
        _, at, sizes = np.unique(label, return_inverse=True, return_counts=True)
        giant = np.flatnonzero(at == sizes.argmax())
        speaks = np.zeros(len(rows), dtype=bool)
        speaks[giant[:: max(1, len(giant) // SPEAKERS)][:SPEAKERS]] = True
        return rows.assign(label=label, n=sizes[at], speaks=speaks)

    return run


def _meeting(percent: int):
    """The speakers of a cluster: (root, label, to, giant), which components of chunks are one, and which make up the largest."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["last", "k", "id"])
        label, one = rows["label"].to_numpy(), _labels(rows, percent)
        # a component that several groups of speakers reach joins them
        edges = pd.DataFrame({"label": np.concatenate([label, one]), "to": np.concatenate([one, label])})
        name = {x: x for x in np.unique(edges.to_numpy())}
        moved = True
        while moved:
            moved = False
            for a, b in zip(edges["label"], edges["to"], strict=True):
                low = min(name[a], name[b])
                moved |= name[a] != low or name[b] != low
                name[a] = name[b] = low
        firsts = rows.drop_duplicates("label")
        to = firsts["label"].map(name)
        weight = firsts["n"].groupby(to.to_numpy()).sum()
        return pd.DataFrame({"root": firsts["root"], "label": firsts["label"], "to": to, "giant": to == weight.idxmax()})

    return run


def _across(percent: int):
    """A chunk and what is outside of the giant: (a, b) links between labels."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["last", "k", "id"]).drop_duplicates("id")
        first = rows.set_index("id")["label"]
        links = pd.DataFrame({"a": rows["label"].to_numpy(), "b": first[_labels(rows, percent)].to_numpy()})
        return links[links["a"] != links["b"]].drop_duplicates()

    return run


def _settle_large(sets: DataFrame, sizes: DataFrame, kind: str, scratch: Scratch, percent: int, chunk: int) -> DataFrame:
    """(id) of the rows that are not the first of their component, of clusters of any size."""
    chunks = sizes.select("root", F.ceil(F.col("weight") / chunk).cast("long").alias("chunks"))
    dealt = sets.join(chunks, "root").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    fields = f"root long, chunk long, id long, last boolean, k {kind}, shingles binary"
    rows = dealt.select("root", "chunk", "id", "last", "k", "shingles").groupBy("root", "chunk")
    found = scratch.keep(rows.applyInPandas(_chunk(percent), f"{fields}, label long, n long, speaks boolean"))
    met = found.filter("speaks").drop("chunk", "speaks").groupBy("root").applyInPandas(_meeting(percent), "root long, label long, to long, giant boolean")
    met = scratch.keep(met)
    # what is not of the giant meets every chunk, in parts as large as a chunk
    outside = found.join(met.filter("giant").select("label"), "label", "left_anti")
    weight = outside.groupBy("root").agg(F.ceil(F.sum(F.octet_length("shingles")) / (8 * chunk)).cast("long").alias("parts"))
    plan = scratch.keep(weight.join(chunks, "root"))
    columns = ["root", "chunk", "part", "id", "last", "k", "shingles", "label"]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    guests = outside.drop("chunk").join(plan, "root").withColumn("part", F.pmod(F.xxhash64("label", "id"), F.col("parts"))).withColumn("chunk", every("chunks"))
    hosts = found.join(plan, "root").withColumn("part", every("parts"))
    meeting = guests.select(*columns).unionAll(hosts.select(*columns)).groupBy("root", "chunk", "part")
    links = meeting.applyInPandas(_across(percent), "a long, b long").unionAll(met.select(F.col("label").alias("a"), F.col("to").alias("b")))
    names = scratch.keep(connected_components(scratch.keep(links.distinct()), scratch))
    # a row that names its component in a chunk stays if it is the first of all that its component has
    firsts = found.filter("id = label").join(names.select(F.col("node").alias("label"), F.col("root").alias("named")), "label", "left")
    firsts = scratch.keep(firsts.select("id", F.coalesce("named", "label").alias("one"), F.struct("last", "k", "id").alias("place")))
    least = firsts.groupBy("one").agg(F.min("place").alias("least"))
    beaten = firsts.join(least, "one").filter("place <> least").select("id")
    return found.filter("id <> label").select("id").unionAll(beaten)


def _clusters(prints: DataFrame, n: int, p: Plan, scratch: Scratch) -> DataFrame:
    """(node, root) of all that the slices link, roots included, of `prints` (id, bits) of `n` documents.

    The first slices go ahead. After them a document goes by the root of its component, so that
    the others hand on links between components only, and not each a forest over a whole family.
    """
    clusters = None
    for first, last in ((0, AHEAD), (AHEAD, p.slices)):
        rows = prints
        if clusters is not None:
            rows = prints.join(clusters.withColumnRenamed("node", "id"), "id", "left").select(F.coalesce("root", "id").alias("id"), "bits")
        rows = rows.repartition(max(1, n // TASK)).mapInPandas(_dealt(p, first, last), f"deal long, id long, word long, {', '.join(f'{c} long' for c in _PRINTS)}")
        links = rows.groupBy("deal").applyInPandas(_met(p), "a long, b long")
        found = connected_components(scratch.keep(links.distinct()), scratch)
        if clusters is not None:
            moved = clusters.join(found.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
            found = moved.select("node", F.coalesce("to", "root").alias("root")).unionAll(found)
        clusters = scratch.keep(found)
    return scratch.keep(clusters.unionAll(clusters.select(F.col("root").alias("node"), "root").distinct()))


def keep_one(
    docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, chunk: int = CHUNK
) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of each component the one with the least key.

    Components are over pairs whose sets of `width`-word shingles have a Jaccard similarity
    of `percent` / 100 or more. A null key is larger than any other; of rows that share a
    key the least hash of the text stays. Rows equal in key and text stay or go together.
    Texts without words are copies of each other. Empty table: empty result.
    """
    python_workers(docs.sparkSession)
    rows = packed(docs, _id=F.xxhash64(F.col(key), F.col(text)), _text=F.col(text))
    n = docs.count()
    p = plan(n, percent)
    prints = rows.select(F.col("_id").alias("id"), F.col("_text").alias("t")).mapInPandas(_printed(width, p), "id long, bits binary")
    clusters = _clusters(scratch.keep(prints), n, p, scratch)

    def with_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t, width).astype("<u8").tobytes() for t in batch["t"]]
            yield batch.drop(columns="t").assign(shingles=sets)

    kind = docs.schema[key].dataType.simpleString()
    k = F.coalesce(F.col(f"_row.{key}"), F.lit(0).cast(kind))  # no null goes through pandas, where it would round the others
    suspects = KeyFilter.of(clusters.select(F.xxhash64("node")), scratch)
    some = rows if suspects is None else suspects.suspects(rows, F.xxhash64("_id"), "_due").filter("_due")
    some = some.select(F.col("_id").alias("id"), F.col(f"_row.{key}").isNull().alias("last"), k.alias("k"), F.col("_text").alias("t"))
    some = some.join(clusters.select(F.col("node").alias("id")), "id", "left_semi") if suspects is None else some
    # rows equal in key and text have one id, and count once
    sets = some.mapInPandas(with_sets, f"id long, last boolean, k {kind}, shingles binary")
    sets = scratch.keep(sets.join(clusters.withColumnRenamed("node", "id"), "id"))
    sizes = scratch.keep(sets.groupBy("root").agg(F.sum(F.octet_length("shingles") / 8).alias("weight")).filter(F.col("weight") > chunk))
    large = not sizes.isEmpty()
    small = sets.join(sizes, "root", "left_anti") if large else sets
    gone = small.groupBy("root").applyInPandas(_copies(percent), "id long")
    if large:
        gone = gone.unionAll(_settle_large(sets.dropDuplicates(["id"]), sizes, kind, scratch, percent, chunk))
    gone = scratch.keep(gone.select(F.col("id").alias("_id")).distinct())
    return drop_rows(rows, gone, ["_id"], scratch)
