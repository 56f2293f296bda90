"""Removal of repeated 50-byte strings by prefix doubling over sampled suffixes.

A string of WIDTH bytes repeats when its first half and its second half, WIDTH / 2 bytes
on, have equal ranks: one doubling step from ranks of 25 bytes to ranks of 50. Ranking
every byte would shuffle some 20 bytes per byte of text and round, so ranks are hashes
of content (equal strings, equal ranks, with no need of a global order) and the first
round ranks sampled suffixes only: the positions that hold the least 25-byte rank of some
50-byte string (minimizers). Equal 50-byte strings hold the same sampled suffix at the
same place, so nothing is lost.

Round 1: Spark sorts a row per sample by (rank, context, document). A rank of one document
is unique and drops out. A sample whose whole context (all 50-byte strings around it)
also stands in a smaller document is removed at once. What is left - samples that share
their rank but not their context with a smaller document - goes to round 2: Spark sorts
their contexts by (rank, document), the strings around them are ranked anew by all their
50 bytes, and those of the smallest document of each stay.

Both rounds read sorted rows in a stream that holds no more than the rows of one rank.
Of samples of equal rank and context those of the smallest document leave a load of texts,
all of its places; the others are removed on the spot, so that copies of a text leave a
row per load. The edge of a passage that very many documents share has one rank and a
context in each of them. Ranks with more than HOT contexts in a load are dealt out by
context, but for the load's smallest document, whose rows tell all others of the rank that
it is open. In round 2 each string of such a rank is a row of its own, dealt by its hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from memloom.llm.common import Scratch, bounded_chunks, python_workers, table
from memloom.llm.rolling import _BASE, _BASE_INV, _powers, mix64, sliding, window_hashes

WIDTH = 50
#: Bytes of text per block of documents.
BLOCK_BYTES = 8_000_000
_CHUNK = 500_000
#: Contexts of a rank in a load beyond which its samples are spread.
HOT = 64
#: Rows that a stream of sorted rows settles at once, at least.
_AT_ONCE = 100_000
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW48 = np.uint64((1 << 48) - 1)
#: What a row of round 1 is, in the top byte of its place.
SAMPLE, RANGE, OPEN, SPREAD = 0, 1, 2, 3
_KIND, _PLACE = 56, (1 << 56) - 1


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Mask of the first row of each run of equal keys."""
    out = np.zeros(len(keys[0]), dtype=bool)
    if len(out):
        out[0] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _grouped_min(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Least value of each row's run."""
    if not len(first):
        return values
    return np.minimum.reduceat(values, np.flatnonzero(first))[np.cumsum(first) - 1]


# texts ------------------------------------------------------------------------------


def _pieces(texts: list[bytes], size: int = _CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, start in bytes, document, offset in document) of pieces, in loads of about `size`.

    A longer text is cut so that each 50-byte string lies in exactly one piece.
    """
    load, held = [], 0
    for k, t in enumerate(texts):
        for off in range(0, max(1, len(t) - WIDTH + 1), size):
            part = t[off : off + size + WIDTH - 1]
            load.append((part, k, off))
            held += len(part)
            if held >= size:
                yield _joined(load)
                load, held = [], 0
    if load:
        yield _joined(load)


def _joined(load: list[tuple[bytes, int, int]]):
    sizes = np.array([len(p) for p, _, _ in load])
    return (
        np.frombuffer(b"".join(p for p, _, _ in load), dtype=np.uint8), np.cumsum(sizes) - sizes,
        np.array([k for _, k, _ in load]), np.array([o for _, _, o in load]),
    )


def _half_ranks(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rank of the half at each place, least half rank of the string at each place, piece, piece end).

    Ranks that would cross a piece end are the last value, strings that would have 0.
    """
    half, n = WIDTH // 2, len(data)
    sizes = np.diff(np.concatenate([starts, [n]]))
    piece = np.repeat(np.arange(len(starts), dtype=np.int32), sizes)
    end = np.repeat(starts + sizes, sizes)
    place = np.arange(n)
    h = np.full(n, _LAST)
    w = window_hashes(data, half)
    h[: len(w)] = np.minimum(np.maximum(w, np.uint64(1)), _LAST - np.uint64(1))
    h[place + half > end] = _LAST
    low = np.zeros(n, dtype=np.uint64)
    s = sliding(h, WIDTH - half + 1, np.minimum) if n >= WIDTH - half + 1 else np.zeros(0, np.uint64)
    low[: len(s)] = s
    low[place + WIDTH > end] = 0
    return h, low, piece, end


def _samples(data: np.ndarray, starts: np.ndarray):
    """(place, rank, context rank, piece, context start, context stop) of the sampled suffixes."""
    half = WIDTH // 2
    h, low, piece, end = _half_ranks(data, starts)
    span = WIDTH - half
    back = sliding(np.concatenate([np.zeros(span, np.uint64), low]), span + 1, np.maximum)
    place = np.flatnonzero((back == h) & (h != _LAST))
    own = piece[place]
    lo, hi = np.maximum(starts[own], place - span), np.minimum(end[place], place + WIDTH)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers("up", _BASE, len(data)), out=sums[1:])
    context = (sums[hi] - sums[lo]) * _powers("down", _BASE_INV, len(data) + 1)[lo]
    context = mix64(context ^ ((place - lo).astype(np.uint64) << np.uint64(56)) ^ ((hi - place).astype(np.uint64) << np.uint64(48)))
    return place, h[place], context, own, lo, hi


def _loads(batches: Iterator[pa.RecordBatch], size: int = 6 * _CHUNK) -> Iterator[list]:
    """Columns of batches put together up to about `size` characters; `t` is the last one."""
    held, chars = [], 0
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        held.append([*(batch.column(k).to_numpy() for k in range(batch.num_columns - 1)), texts])
        chars += sum(map(len, texts))
        if chars >= size:
            yield [np.concatenate(c) for c in list(zip(*held, strict=True))[:-1]] + [[t for h in held for t in h[-1]]]
            held, chars = [], 0
    if held:
        yield [np.concatenate(c) for c in list(zip(*held, strict=True))[:-1]] + [[t for h in held for t in h[-1]]]


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names)


# round 1 ----------------------------------------------------------------------------

_SAMPLES = ["rank", "context", "id", "rk", "spot"]
_LISTED = ["kind", "id", "rk", "lo", "size", "hot", "rank"]


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Samples, and ranges removed on the spot, of rows (id, rk, t)."""
    for all_ids, all_rks, all_texts in _loads(batches):
        for at, part in bounded_chunks(all_texts, 8 * _CHUNK):
            texts = [t.encode("utf-8", errors="surrogatepass") for t in part]
            found = [[], [], [], [], [], []]
            for data, starts, doc, off in _pieces(texts):
                place, rank, context, own, lo, hi = _samples(data, starts)
                shift = (off - starts)[own]
                # a context cut by a piece, not by the text, equals no other: round 2 sees to it
                stop = np.concatenate([starts[1:], [len(data)]])
                inner = np.array([o + n < len(texts[d]) for o, n, d in zip(off, stop - starts, doc, strict=True)])[own]
                cut = ((off[own] > 0) & (place - lo < WIDTH - WIDTH // 2)) | (inner & (hi - place < WIDTH))
                context[cut] = mix64((place + shift + all_rks[doc[own] + at]).astype(np.uint64))[cut]
                for out, x in zip(found, (doc[own] + at, place + shift, rank, context, lo + shift, hi + shift), strict=True):
                    out.append(x)
            who, place, rank, context, lo, hi = (np.concatenate(x) for x in found)
            if not len(who):
                continue
            rank, context = (rank & _LOW48).astype(np.int64), (context & _LOW48).astype(np.int64)
            order = np.lexsort((all_ids[who], context, rank))
            ids = all_ids[who[order]]
            by_rank, by_context = _runs(rank[order]), _runs(rank[order], context[order])
            gone, kind = np.zeros(len(who), dtype=bool), np.zeros(len(who), dtype=np.int64)
            gone[order] = ids > _grouped_min(by_context, ids)  # the same context in a smaller document of this load
            contexts = np.add.reduceat(by_context.astype(np.int64), np.flatnonzero(by_rank))[np.cumsum(by_rank) - 1]
            kind[order] = np.where(contexts <= HOT, SAMPLE, np.where(ids > _grouped_min(by_rank, ids), SPREAD, OPEN))
            # every place of the least document goes on: another load may hold a smaller one; in the order of the texts rows compress best
            keep = np.flatnonzero(~gone)
            rows = _batch(_SAMPLES, rank[keep], context[keep], all_ids[who[keep]], all_rks[who[keep]], place[keep] | kind[keep] << _KIND)
            yield from (rows.slice(k, _AT_ONCE) for k in range(0, rows.num_rows, _AT_ONCE))
            if gone.any():
                who, lo, hi = _united(who[gone], lo[gone], hi[gone])
                yield _batch(_SAMPLES, lo, np.zeros(len(who), dtype=np.int64), all_ids[who], all_rks[who], hi | RANGE << _KIND)


def _united(who: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges that touch, as one."""
    order = np.lexsort((lo, who))
    who, lo, hi = who[order], lo[order], hi[order]
    base = who.astype(np.int64) * (int(hi.max()) + 1)
    reach = np.maximum.accumulate(hi + base) - base
    first = np.ones(len(who), dtype=bool)
    first[1:] = (who[1:] != who[:-1]) | (lo[1:] > reach[:-1])
    at = np.flatnonzero(first)
    return who[at], lo[at], reach[np.concatenate([at[1:], [len(who)]]) - 1]


def _streamed(batches: Iterator[pa.RecordBatch], by: int, pick, settle) -> Iterator[pa.RecordBatch]:
    """`settle` over whole runs of equal values of column `by` of sorted rows, that come in batches.

    `pick` takes the columns of a batch and gives (rows to pass on at once, the columns to hold).
    """
    held, n, most = [], 0, _AT_ONCE
    for batch in batches:
        at_once, columns = pick(batch)
        if at_once is not None:
            yield at_once
        held.append(columns)
        n += len(columns[by])
        if n < most:
            continue
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        cut = int(np.searchsorted(columns[by], columns[by][-1]))
        if cut:
            yield settle(*(c[:cut] for c in columns))
        held, n = [[c[cut:] for c in columns]], len(columns[by]) - cut
        most = max(_AT_ONCE, 2 * n)  # a long run is put together a few times, not for each batch
    if n:
        yield settle(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of samples sorted by (rank, context, id): removed ranges (kind 1) and places that need round 2 (kind 2)."""
    span = WIDTH - WIDTH // 2

    def pick(batch):
        columns = [batch.column(k).to_numpy() for k in range(5)]
        done = columns[4] >> _KIND == RANGE
        if not done.any():
            return None, columns
        lo, _, ids, rks, spot = (c[done] for c in columns)
        n = len(lo)
        ranges = _batch(_LISTED, np.ones(n, np.int32), ids, rks, lo, (spot & _PLACE) - lo, np.zeros(n, bool), np.zeros(n, np.int64))
        return ranges, [c[~done] for c in columns]

    def judged(rank, context, ids, rks, spot, spread):
        if not len(rank):
            return []
        place, told = spot & _PLACE, spot >> _KIND == OPEN
        by_rank, by_context = _runs(rank), _runs(rank, context)
        least, least_here = _grouped_min(by_rank, ids), _grouped_min(by_context, ids)
        done = ids > least_here
        if spread:  # all are open; the least document of each context may go
            need, hot = ~done, np.ones(len(rank), dtype=bool)
        else:
            may_go = ~done & (ids > least)
            group = np.cumsum(by_rank) - 1
            is_open, is_hot = np.zeros(group[-1] + 1, dtype=bool), np.zeros(group[-1] + 1, dtype=bool)
            is_open[group[may_go | told]] = True
            is_hot[group[told]] = True
            need, hot = (by_context | may_go) & is_open[group], is_hot[group]  # one holder of each context, all places that may go
        # clipped contexts are as wide as the text allows; their ends are set right against the text
        lo = np.maximum(0, place - span)
        out = [(np.full(done.sum(), 1), ids[done], rks[done], lo[done], (place + WIDTH - lo)[done], hot[done], rank[done])]
        return [*out, (np.full(need.sum(), 2), ids[need], rks[need], place[need], 0 * place[need], hot[need], rank[need])]

    def settle(rank, context, ids, rks, spot):
        spread = spot >> _KIND == SPREAD
        parts = [x for wide in (False, True) for x in judged(*(c[spread == wide] for c in (rank, context, ids, rks, spot)), wide)]
        kind, *columns = (np.concatenate(c) for c in zip(*parts, strict=True))
        return _batch(_LISTED, kind.astype(np.int32), *columns)

    yield from _streamed(batches, 0, pick, settle)


# round 2 ----------------------------------------------------------------------------

_CONTEXTS = "kind int, rank long, id long, rk long, lo long, lead int, body binary"


def _of_rows(rks: np.ndarray, lo: np.ndarray, *more: np.ndarray) -> dict[int, list[np.ndarray]]:
    """Row key -> columns sorted by `lo`."""
    if not len(rks):
        return {}
    order = np.lexsort((lo, rks))
    columns = [c[order] for c in (lo, *more)]
    cuts = np.flatnonzero(_runs(rks[order]))
    return {int(rks[order[a]]): [c[a:b] for c in columns] for a, b in zip(cuts, [*cuts[1:], len(rks)], strict=True)}


def _context_rows(docs: pd.DataFrame, need: pd.DataFrame) -> pd.DataFrame:
    """A block: the bytes around each needed place, or, of hot ranks, each string of them (kind 0); removed ranges (kind 1)."""
    span = WIDTH - WIDTH // 2
    wanted = _of_rows(need["rk"].to_numpy(), need["lo"].to_numpy(), need["hot"].to_numpy(), need["rank"].to_numpy())
    docs = docs[docs["rk"].isin(wanted)].drop_duplicates("rk").sort_values("id", kind="stable")
    out, least = [], {}
    for i, rk, t in zip(docs["id"].tolist(), docs["rk"].tolist(), docs["t"], strict=True):
        text = t.encode("utf-8", errors="surrogatepass")
        places, hot, ranks = wanted[rk]
        single: set[int] = set()
        for p, h, r in zip(places.tolist(), hot.tolist(), ranks.tolist(), strict=True):
            begin = max(0, p - span)
            if h:
                single.update(range(begin, min(p, len(text) - WIDTH) + 1))
            else:
                out.append((0, r, i, rk, p, p - begin, text[begin : p + WIDTH]))
        for s in sorted(single):
            body = text[s : s + WIDTH]
            if least.setdefault(body, i) < i:  # the same string in a smaller document of this block
                out.append((1, 0, i, rk, s, WIDTH, b""))
            else:
                out.append((0, xxh64_intdigest(body, 1) & ((1 << 48) - 1), i, rk, s, 0, body))
    return pd.DataFrame(out, columns=["kind", "rank", "id", "rk", "lo", "lead", "body"])


def _second_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of contexts sorted by (rank, id): ranges of strings that also stand in a smaller document."""

    def listed(ids, rks, lo, size):
        n = len(ids)
        return _batch(_LISTED, np.ones(n, np.int32), ids, rks, lo, size, np.zeros(n, bool), np.zeros(n, np.int64))

    def pick(batch):
        kind, rank, ids, rks, lo, lead = (batch.column(k).to_numpy() for k in range(6))
        body = np.array(batch.column(6).to_pylist() + [None], dtype=object)[:-1]
        done, columns = kind == 1, (rank, ids, rks, lo, lead.astype(np.int64), body)
        if not done.any():
            return None, columns
        return listed(ids[done], rks[done], lo[done], columns[4][done]), [c[~done] for c in columns]

    def settle(rank, ids, rks, lo, lead, body):
        sizes = np.fromiter(map(len, body), dtype=np.int64, count=len(body))
        begin = np.cumsum(sizes) - sizes
        hashes = window_hashes(np.frombuffer(b"".join(body), dtype=np.uint8), WIDTH)
        counts = np.maximum(0, np.minimum(lead, sizes - WIDTH) + 1)
        row = np.repeat(np.arange(len(rank)), counts)
        step = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        h = hashes[begin[row] + step]
        order = np.lexsort((ids[row], h, rank[row]))
        row, step, h = row[order], step[order], h[order]
        later = ids[row] > _grouped_min(_runs(rank[row], h), ids[row])
        row, step = row[later], step[later]
        # strings around one place overlap: what goes of them is one range
        order = np.lexsort((step, row))
        row, step = row[order], step[order]
        first = np.flatnonzero(_runs(row)) if len(row) else np.zeros(0, dtype=np.int64)
        last = np.concatenate([first[1:], [len(row)]])[: len(first)] - 1
        one = row[first]
        return listed(ids[one], rks[one], lo[one] - lead[one] + step[first], step[last] - step[first] + WIDTH)

    yield from _streamed(batches, 0, pick, settle)


# documents --------------------------------------------------------------------------


def kept_bytes(text: bytes, lo: np.ndarray, size: np.ndarray) -> tuple[bytes, int, list[tuple[int, int]]]:
    """(what is left, bytes removed, maximal removed runs) after removing the ranges."""
    edge = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(edge, np.minimum(lo, len(text)), 1)
    np.add.at(edge, np.minimum(lo + size, len(text)), -1)
    gone = np.cumsum(edge[:-1]) > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    left = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
    return left, int(gone.sum()), list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))


def _finish(docs: pd.DataFrame, ranges: pd.DataFrame) -> pd.DataFrame:
    gone = _of_rows(ranges["rk"].to_numpy(), ranges["lo"].to_numpy(), ranges["size"].to_numpy())
    none = [np.zeros(0, dtype=np.int64)] * 2
    out = []
    for k, none_, rk, t in zip(docs["id"], docs["no_key"], docs["rk"], docs["t"], strict=True):
        text = t.encode("utf-8", errors="surrogatepass")
        left, removed, spans = kept_bytes(text, *gone.get(rk, none))
        spans = [{"start": a, "stop": b} for a, b in spans]
        out.append((k, none_, len(text), removed, spans, hashlib.sha256(left).hexdigest()))
    return pd.DataFrame(out, columns=["id", "no_key", "n_bytes", "n_removed", "spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, spans, kept_sha256) for every row; spans: removed byte ranges.

    A byte goes if a 50-byte string over it also starts in a row with a smaller key (a
    long). A null key is larger than any other. Null text counts as empty. Rows that
    repeat a key do not remove from each other. Strings are compared by hashes of 96 bits
    and more. Empty table: empty result.
    """
    python_workers(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    whole = F.coalesce(F.col(key), F.lit((1 << 63) - 1)).cast("long")
    # the key never goes through pandas beside a null, where it would be a float
    rows = docs.select(F.col(key).isNull().alias("no_key"), whole.alias("id"), body.alias("t"))
    rows = rows.withColumn("rk", F.xxhash64("id", "t").bitwiseAND(F.lit((1 << 63) - 1)))
    blocks = 1 + (rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // BLOCK_BYTES
    in_block = F.pmod("rk", F.lit(blocks)).alias("block")

    samples = rows.select("id", "rk", "t").mapInArrow(_sample_rows, ", ".join(f"{c} long" for c in _SAMPLES))
    kind = F.shiftright("spot", _KIND)
    deal = F.when(kind == RANGE, F.xxhash64("rk", "rank")).when(kind == SPREAD, F.xxhash64("rank", "context")).otherwise(F.col("rank"))
    listed = "kind int, id long, rk long, lo long, size long, hot boolean, rank long"
    first = scratch.keep(samples.repartition(deal).sortWithinPartitions("rank", "context", "id").mapInArrow(_first_round, listed))

    placed = rows.select("*", in_block)
    need = first.filter("kind = 2").select(in_block, "rk", "lo", "hot", "rank")
    contexts = placed.select("block", "id", "rk", "t").groupBy("block").cogroup(need.groupBy("block")).applyInPandas(_context_rows, _CONTEXTS)
    deal = F.when(F.col("kind") == 1, F.xxhash64("rk", "lo")).otherwise(F.col("rank"))
    second = scratch.keep(contexts.repartition(deal).sortWithinPartitions("rank", "id").mapInArrow(_second_round, listed))

    gone = first.filter("kind = 1").unionAll(second).select(in_block, "rk", "lo", "size")
    schema = "id long, no_key boolean, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept_sha256 string"
    out = placed.select("block", "id", "no_key", "rk", "t").groupBy("block").cogroup(gone.groupBy("block")).applyInPandas(_finish, schema)
    kind = docs.schema[key].dataType.simpleString()
    return out.select(F.when(~F.col("no_key"), F.col("id")).cast(kind).alias(key), "n_bytes", "n_removed", "spans", "kept_sha256")


def op10_repeats(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    found = remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark, "repeats"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


#: Every 50-byte string of every document, as hex digits; documents are cut first, for a slice of a long text is dear.
OP10_SQL = f"""
WITH d AS (
  SELECT ROW_NUMBER() OVER () AS rid, doc_id, COALESCE(doc_id, 9223372036854775807) AS k, h, length(h) // 2 AS n
  FROM (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h FROM documents)
), c AS (
  SELECT rid, k, o, substring(h, 2 * o + 1, {2 * (1000 + WIDTH - 1)}) AS p
  FROM (SELECT *, UNNEST(range(0, greatest(n - {WIDTH - 1}, 0), 1000)) AS o FROM d)
), s AS (
  SELECT rid, k, o + i AS pos, substring(p, 2 * i + 1, {2 * WIDTH}) AS w FROM (SELECT *, UNNEST(range(0, length(p) // 2 - {WIDTH - 1})) AS i FROM c)
), m AS (
  SELECT w, MIN(k) AS lo FROM s GROUP BY w HAVING MIN(k) < MAX(k)
), g AS (
  SELECT rid, pos, CASE WHEN pos - LAG(pos) OVER (PARTITION BY rid ORDER BY pos) <= {WIDTH} THEN 0 ELSE 1 END AS fresh
  FROM s JOIN m USING (w) WHERE k > lo
), r AS (
  SELECT rid, MIN(pos) AS a, MAX(pos) + {WIDTH} AS b
  FROM (SELECT rid, pos, SUM(fresh) OVER (PARTITION BY rid ORDER BY pos) AS run FROM g) GROUP BY rid, run
), l AS (
  SELECT rid, COALESCE(LAG(b) OVER (PARTITION BY rid ORDER BY a), 0) AS x, a AS y FROM r
  UNION ALL SELECT rid, MAX(b), NULL FROM r GROUP BY rid
), t AS (
  SELECT rid, string_agg(substring(h, 2 * x + 1, 2 * (COALESCE(y, n) - x)), '' ORDER BY x) AS left_ FROM l JOIN d USING (rid) GROUP BY rid
), u AS (
  SELECT rid, SUM(b - a) AS n_removed, COUNT(*) AS n_spans FROM r GROUP BY rid
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, CAST(COALESCE(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(COALESCE(left_, h))) AS kept_sha256
FROM d LEFT JOIN t USING (rid) LEFT JOIN u USING (rid)
"""
