"""SimHash near-dedup by anchor-point covering.

The anchors are the words of a covering code of 64 bits: a product of repetition
codes over blocks of odd length. A fingerprint's home is the anchor that has the
majority bit of each block; every fingerprint is within the covering radius of its
home. If x and y differ in at most t bits, then y lies within radius + t of x's home,
and some change of t bits takes y into x's cell. So each fingerprint visits every
anchor whose cell it reaches with t changes, and x meets y at the home of x.

The number of blocks follows the number of distinct fingerprints. Anchors that more
than HOT fingerprints visit are covered again by a code of more and shorter blocks; with
64 blocks of one bit an anchor has at most 2081 visitors, so no task holds more.
Within an anchor only a spanning forest of the links is handed on, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from memloom.llm.common import Scratch, bounded_chunks, map_rows, table
from memloom.llm.graph import connected_components

SEED = 42
#: Visitors of an anchor beyond which a finer code takes over.
HOT = 16_384
#: Home fingerprints that an anchor should have, about.
PER_ANCHOR = 16
_BLOCK = 1 << 16


# fingerprints -----------------------------------------------------------------------


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, its A-Z lower-cased; no words: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - width + 1]
    stops = ends[width - 1 :] - 1
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(starts), _BLOCK):
        block = zip(starts[k : k + _BLOCK].tolist(), stops[k : k + _BLOCK].tolist(), strict=True)
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in block], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fp): the fingerprint as a signed long."""

    def prepare():
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return lambda rows: ([(signed(fingerprint(t, width)),) for t in part] for _, part in bounded_chunks([t or "" for t in rows["t"]]))

    return map_rows(docs, key, {"t": F.col(text)}, "fp long", prepare)


# anchors ----------------------------------------------------------------------------


def block_lengths(blocks: int, bits: int = 64) -> list[int]:
    """An even number of bits as an even number of blocks of odd, nearly equal length."""
    short = bits // blocks
    short -= 1 - short % 2
    longer = (bits - blocks * short) // 2
    return [short + 2] * longer + [short] * (blocks - longer)


def _weights(fps: np.ndarray, lengths: list[int]) -> np.ndarray:
    """Ones of each fingerprint in each block."""
    out, at = np.empty((len(fps), len(lengths)), dtype=np.int8), 0
    for j, n in enumerate(lengths):
        mask = np.uint64(((1 << n) - 1) << at)
        out[:, j] = np.bitwise_count(fps & mask)
        at += n
    return out


def visits(fps: np.ndarray, blocks: int, distance: int = 2, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index of the fingerprint, home?) of each fingerprint and anchor in its reach."""
    lengths = np.array(block_lengths(blocks, bits), dtype=np.int8)
    ones = _weights(fps, lengths.tolist())
    major = ones * 2 > lengths
    bit = np.uint64(1) << np.arange(blocks, dtype=np.uint64)
    home = (major * bit).sum(axis=1, dtype=np.uint64)
    # changes that turn the majority of a block
    cost = np.where(major, ones - lengths // 2, lengths // 2 + 1 - ones)
    index = np.arange(len(fps))
    anchors, owners = [home], [index]
    reach = [(index, home, np.full(len(fps), -1), np.zeros(len(fps), dtype=np.int64))]
    for _ in range(distance):  # sets of turned blocks, each built in rising order
        grown = []
        for who, anchor, last, spent in reach:
            for j in range(blocks):
                ok = (last < j) & (spent + cost[who, j] <= distance)
                if ok.any():
                    w = who[ok]
                    grown.append((w, anchor[ok] ^ bit[j], np.full(len(w), j), spent[ok] + cost[w, j]))
        reach = [tuple(np.concatenate(x) for x in zip(*grown, strict=True))] if grown else []
        for who, anchor, _, _ in reach:
            anchors.append(anchor)
            owners.append(who)
    anchors, owners = np.concatenate(anchors), np.concatenate(owners)
    return anchors, owners, np.arange(len(anchors)) < len(fps)


def forest(members: np.ndarray, homes: np.ndarray, distance: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (member, root) of the links between `homes` and `members`."""
    members = np.unique(members)
    label = np.arange(len(members))
    at = np.searchsorted(members, np.unique(homes))
    rows = max(1, 2_000_000 // max(1, len(members)))
    for k in range(0, len(at), rows):
        i, j = np.nonzero(np.bitwise_count(members[at[k : k + rows], None] ^ members[None, :]) <= distance)
        i = at[k : k + rows][i]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        while len(i):
            low = np.minimum(label[i], label[j])
            for x in (label[i], label[j]):  # hang the roots of both ends lower
                np.minimum.at(label, x, low)
            while (label[label] != label).any():
                label = label[label]
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
    hung = np.flatnonzero(label != np.arange(len(members)))
    return members[hung], members[label[hung]]


def _visit_rows(blocks: int, distance: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            fps = rows["fp"].to_numpy().view(np.uint64)
            for k in range(0, len(fps), 2000):
                part = fps[k : k + 2000]
                anchor, who, home = visits(part, blocks, distance)
                yield pd.DataFrame({"anchor": anchor.view(np.int64), "fp": part[who].view(np.int64), "home": home})

    return run


def _visit_counts(blocks: int, distance: int):
    """A row per anchor and task: visits are summed up before they leave the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        for rows in batches:
            fps = rows["fp"].to_numpy().view(np.uint64)
            for k in range(0, len(fps), 20_000):
                anchor, n = np.unique(visits(fps[k : k + 20_000], blocks, distance)[0], return_counts=True)
                anchors, at = np.unique(np.concatenate([anchors, anchor]), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(anchors)).astype(np.int64)
                if len(anchors) > 2_000_000:
                    yield pd.DataFrame({"anchor": anchors.view(np.int64), "n": counts})
                    anchors, counts = anchors[:0], counts[:0]
        yield pd.DataFrame({"anchor": anchors.view(np.int64), "n": counts})

    return run


def _compare(distance: int):
    """Rows come sorted by anchor; an anchor's rows may span batches."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        anchor = rows["anchor"].to_numpy()
        fps, home = rows["fp"].to_numpy().view(np.uint64), rows["home"].to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1], [True]]))
        found = [(np.zeros(0, np.uint64),) * 2]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a > 1 and home[a:b].any():
                found.append(forest(fps[a:b], fps[a:b][home[a:b]], distance))
        x, y = (np.concatenate(side).view(np.int64) for side in zip(*found, strict=True))
        return pd.DataFrame({"a": x, "b": y}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for rows in batches:
            if not len(rows):
                continue
            rows = pd.concat([*held, rows], ignore_index=True) if held else rows
            last = int(np.searchsorted(rows["anchor"].to_numpy(), rows["anchor"].iloc[-1]))
            if last:
                yield links(rows.iloc[:last])
            held = [rows.iloc[last:]]
        if held:
            yield links(held[0])

    return run


def fingerprint_links(distinct: DataFrame, scratch: Scratch, distance: int = 2, hot: int = HOT) -> DataFrame:
    """(a, b) links that connect what `distance` connects, of a table of distinct `fp`."""
    n = distinct.count()
    blocks = min(64, max(2, 2 * round((np.log2(max(2, n)) - np.log2(PER_ANCHOR)) / 2)))
    members, homes, found = distinct.select("fp"), None, []
    while True:
        counts = members.mapInPandas(_visit_counts(blocks, distance), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
        busy = scratch.keep(counts.filter(F.col("n") > hot).select("anchor")) if blocks < 64 else None
        rows = members.mapInPandas(_visit_rows(blocks, distance), "anchor long, fp long, home boolean")
        if homes is not None:  # a finer code: only what lives at a busy anchor still needs its links
            rows = rows.join(homes.withColumn("due", F.lit(True)), "fp", "left")
            rows = rows.select("anchor", "fp", (F.col("home") & F.coalesce("due", F.lit(False))).alias("home"))
        is_busy = busy is not None and not busy.isEmpty()
        calm = rows.join(busy, "anchor", "left_anti") if is_busy else rows
        links = calm.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(_compare(distance), "a long, b long")
        found.append(scratch.keep(links.distinct()))
        if not is_busy:
            break
        crowd = scratch.keep(rows.join(busy, "anchor", "left_semi").groupBy("fp").agg(F.max("home").alias("home")))
        members, homes, blocks = crowd.select("fp"), crowd.filter("home").select("fp"), min(64, blocks + 10)
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def simhash_components(
    docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", width: int = 3, distance: int = 2, hot: int = HOT
) -> DataFrame:
    """(key, fp, component_id) for every row of `docs`.

    component_id is the least key reachable over links of `distance` or fewer bits.
    Null and empty texts and texts of white space have fingerprint 0 and link to each other.
    Fewer words than `width`: the one shingle of all words. Rows with a null key take part
    but name no component while another key is there. Repeated rows come back as often as
    they stand. Empty table: empty result.
    """
    fps = scratch.keep(fingerprints(docs, key, text, width))
    distinct = scratch.keep(fps.groupBy("fp").agg(F.min(key).alias("least")))
    links = fingerprint_links(distinct, scratch, distance, hot)
    roots = connected_components(links, scratch)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # written, so that joins have plain exchanges on both sides: rows of one fingerprint or component can be split
    rooted = scratch.keep(rooted.select("fp", "root", "least"))
    names = scratch.keep(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = scratch.keep(rooted.join(names, "root").select("fp", "component_id"))
    return fps.join(named, "fp").select(key, "fp", "component_id")


def hex16(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, fingerprint, component_id."""
    docs = table(spark, sf_dir, "documents")
    found = simhash_components(docs, Scratch(spark, "simhash"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
