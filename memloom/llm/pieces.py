"""SentencePiece BPE with seeded merge-dropout, and its lossless decoder.

A text gets a leading space; spaces become the piece mark. Candidate merges wait in an
agenda by score, then position; the k-th one that comes up is skipped if a keyed hash of
(seed, document, place of the segment, k) falls below the dropout. A skipped candidate
comes back only if a neighbour's merge makes a new one. No merge crosses the start of a
run of marks or a line end (no piece does), so segments between them are encoded alone.
Each occurrence of a segment so has skips of its own.

Agendas of a load of text run side by side in numpy: a step takes the best candidate of
each segment at once. Segments without a skip share one result, which a worker keeps.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.common import bounded_chunks, python_workers, table
from memloom.llm.rolling import mix64

MARK = "▁"
DROPOUT, SEED = 0.1, 17
#: Segments without a skip that a worker keeps before it starts anew.
KEPT = 300_000
#: Longer segments have an agenda of their own, as a heap.
MOST_CHARS = 48
#: Candidates of an occurrence whose skips are drawn for a whole load; the rest when it gets that far.
FIRST = 24
#: Characters of a load, and segments of a part of a longer text.
LOAD_CHARS, LOAD_SEGMENTS = 1_000_000, 200_000
_SEGMENT = re.compile(r" *[^ \n]+|\n| +")
_M = (1 << 64) - 1
#: No candidate; ranks are shifted by 6 bits for the place. Pairs of symbols are 2 x 21 bits.
_NEVER, _NO_PAIR, _SPREAD = 1 << 30, np.uint64(_M), np.uint64(0x9E3779B97F4A7C15)
#: Segments whose agendas run side by side.
_ROWS = 100_000


class Pieces:
    """A BPE vocabulary with byte pieces: list of (piece, score, is_byte), by id."""

    def __init__(self, vocabulary: list[tuple[str, float, bool]]):
        self.vocabulary = vocabulary
        self.ready = False

    def __getstate__(self):
        return {"vocabulary": self.vocabulary, "ready": False}

    def prepare(self) -> Pieces:
        if self.ready:
            return self
        self.ids = {p: i for i, (p, _, is_byte) in enumerate(self.vocabulary) if not is_byte and p}
        # agenda order: higher score first; equal scores go by position
        scores = sorted({-s for _, s, is_byte in self.vocabulary if not is_byte})
        order = {s: k for k, s in enumerate(scores)}
        self.rank = {p: order[-s] for p, s, is_byte in self.vocabulary if not is_byte and p}
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, is_byte) in enumerate(self.vocabulary) if is_byte}
        self.byte_ids = np.array([self.byte_id.get(b, 0) for b in range(256)], dtype=np.int32)
        self.raw = [
            bytes([int(p[3:5], 16)]) if is_byte else p.replace(MARK, " ").encode() for p, _, is_byte in self.vocabulary
        ]
        ends = np.cumsum([len(r) for r in self.raw])
        self.raw_stop, self.raw_start = ends, ends - [len(r) for r in self.raw]
        self.raw_bytes = np.frombuffer(b"".join(self.raw), dtype=np.uint8)
        self._symbols()
        self._forget()
        self.ready = True
        return self

    @staticmethod
    def load(path: str | None = None) -> Pieces:
        """Read a SentencePiece model on the driver; the default is the installed public one."""
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return Pieces([
            ("" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i), sp.get_score(i), sp.is_byte(i))
            for i in range(sp.get_piece_size())
        ])

    # encoding -----------------------------------------------------------------------

    def _ids(self, symbols: list[str]) -> tuple[int, ...]:
        out: list[int] = []
        for s in symbols:
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            else:
                out.extend(self.byte_id[b] for b in (MARK if s == "\0mark" else s).encode())
        return tuple(out)

    def segment(self, text: str, skips: int = 0) -> tuple[int, ...]:
        """Ids of one segment; the k-th candidate that comes up is skipped if bit k of `skips` is set.

        Spaces are marks here; a mark of the text itself stays bytes.
        """
        return self._ids(self._long([MARK if c == " " else "\0mark" if c == MARK else c for c in text], skips))

    def _long(self, symbols: list[str], skips: int) -> list[str]:
        """The agenda of a segment of any length, as a heap."""
        rank, n = self.rank, len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n:
                merged = symbols[a] + symbols[b]
                if (r := rank.get(merged)) is not None:
                    heapq.heappush(agenda, (r, a, merged))

        for k in range(n - 1):
            offer(k, k + 1)
        came, due = 0, np.unpackbits(np.frombuffer(skips.to_bytes(max(3 * n, skips.bit_length()) // 8 + 1, "little"), np.uint8), bitorder="little").tolist()
        while agenda:
            _, a, merged = heapq.heappop(agenda)
            b = after[a]
            if not symbols[a] or b >= n or symbols[a] + symbols[b] != merged:
                continue
            came += 1
            if due[came - 1]:
                continue
            symbols[a], symbols[b] = merged, ""
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [s for s in symbols if s]

    # many segments side by side -----------------------------------------------------

    def _symbols(self) -> None:
        """Numbers for symbols: a piece's id, or beyond them the character; and what pairs of them merge to."""
        n = len(self.vocabulary)
        number = lambda x: self.ids.get(x, n + ord(x) if len(x) == 1 else -1)
        self.of_char = np.arange(n, n + 0x110000, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.of_char[ord(" ")], self.of_char[ord(MARK)] = self.of_char[ord(MARK)], n + ord(MARK)
        own_mark = self.of_char[ord(" ")]
        found = [
            (own_mark if p[:k] == MARK else number(p[:k]), own_mark if p[k:] == MARK else number(p[k:]), self.rank[p], i)
            for p, i in self.ids.items() for k in range(1, len(p))
        ]
        a, b, rank, merged = np.array([x for x in found if x[0] >= 0 and x[1] >= 0], dtype=np.int64).reshape(-1, 4).T
        # an open table of pairs, a quarter full
        bits = max(4, int(4 * len(a)).bit_length())
        self.shift, pairs = np.uint64(64 - bits), (a << 21 | b).astype(np.uint64)
        self.pair_of = np.full(1 << bits, _NO_PAIR, dtype=np.uint64)
        self.rank_of, self.merged_of = np.full(1 << bits, _NEVER >> 6, dtype=np.int32), np.zeros(1 << bits, dtype=np.int32)
        slot, due = (pairs * _SPREAD >> self.shift).astype(np.int64), np.arange(len(pairs))
        while len(due):
            free = np.flatnonzero(self.pair_of[slot[due]] == _NO_PAIR)
            at, k = np.unique(slot[due[free]], return_index=True)
            put = due[free[k]]
            self.pair_of[at], self.rank_of[at], self.merged_of[at] = pairs[put], rank[put], merged[put]
            due = np.setdiff1d(due, put)
            slot[due] = (slot[due] + 1) & ((1 << bits) - 1)

    def _merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each pair of symbols in the table; a slot without a pair ranks last."""
        pairs = a.astype(np.uint64) << np.uint64(21) | b.astype(np.uint64)
        slot = (pairs * _SPREAD >> self.shift).astype(np.int64)
        have = self.pair_of[slot]
        due = np.flatnonzero((have != pairs) & (have != _NO_PAIR))
        while len(due):
            slot[due] = (slot[due] + 1) & (len(self.pair_of) - 1)
            have = self.pair_of[slot[due]]
            due = due[(have != pairs[due]) & (have != _NO_PAIR)]
        return slot

    def agendas(self, symbols: np.ndarray, sizes: np.ndarray, skips: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols in a row, number of each segment, candidates that came up) of segments (a column each).

        Of a segment more than `known` candidates of which come up, the number is known + 1.
        """
        width, n = symbols.shape
        sym, sizes = symbols.ravel(), sizes.astype(np.int64)
        place = np.arange(width)[:, None]
        slots = self._merge(symbols[:-1].ravel(), symbols[1:].ravel()).reshape(width - 1, n) if width > 1 else np.zeros((0, n), np.int64)
        merged, best = np.zeros((width, n), dtype=np.int32), np.full((width, n), _NEVER, dtype=np.int32)
        merged[:-1] = self.merged_of[slots]
        best[:-1] = np.where(place[1:] < sizes, self.rank_of[slots] << 6 | place[:-1], _NEVER)
        merged, flat = merged.ravel(), best.ravel()
        after, before = np.repeat(np.arange(1, width + 1), n), np.repeat(np.arange(-1, width - 1), n)
        alive, came = (place < sizes).ravel(), np.zeros(n, dtype=np.int64)
        while True:
            first = best.min(axis=0)  # rank and place in one number
            at = np.flatnonzero(first < _NEVER & ~63)
            if not len(at):
                break
            late = came[at] >= known
            if late.any():
                best[:, at[late]] = _NEVER
                came[at[late]] = known + 1
                at = at[~late]
            k = (first[at] & 63) * n + at
            skip = (skips[at] >> came[at].astype(np.uint64) & np.uint64(1)).astype(bool)
            came[at] += 1
            flat[k[skip]] = _NEVER
            at, k = at[~skip], k[~skip]
            gone, new = after[k] * n + at, merged[k]
            then, left = after[gone], before[k]
            sym[k], alive[gone], flat[gone], after[k] = new, False, _NEVER, then
            on = then < sizes[at]
            flat[k[~on]] = _NEVER
            x, right = k[on], then[on] * n + at[on]
            before[right] = x // n
            slot = self._merge(new[on], sym[right])
            flat[x], merged[x] = self.rank_of[slot] << 6 | (x // n), self.merged_of[slot]
            on = left >= 0
            x = left[on] * n + at[on]
            slot = self._merge(sym[x], new[on])
            flat[x], merged[x] = self.rank_of[slot] << 6 | left[on], self.merged_of[slot]
        alive = alive.reshape(width, n)
        return sym.reshape(width, n).T[alive.T], alive.sum(axis=0), came

    def _many(self, segments: list[str], skips: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids in a row, where the ids of each segment end, candidates that came up), by classes of length."""
        lengths = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        order = np.argsort(lengths, kind="stable")
        came, size, parts, at = np.zeros(len(segments), dtype=np.int64), np.zeros(len(segments), dtype=np.int64), [], 0
        while at < len(order):  # longer ones share a matrix if padding stays small
            least = int(lengths[order[at]])
            to = int(np.searchsorted(lengths[order], max(least + 1, least * 5 // 4), "right"))
            some = order[at : min(to, at + _ROWS)]
            at += len(some)
            width = int(lengths[some[-1]])
            chars = np.array([segments[k] for k in some.tolist()], dtype=f"<U{width}").view(np.uint32).reshape(-1, width)
            symbols = np.ascontiguousarray(self.of_char[chars].T)
            flat, n, came[some] = self.agendas(symbols, lengths[some], skips[some], known)
            ids, wide = self._bytes(flat)
            size[some] = np.add.reduceat(wide, np.cumsum(n) - n)
            parts.append(ids)
        ends = np.cumsum(size[order])
        stop = np.empty(len(order), dtype=np.int64)
        stop[order] = ends
        return np.concatenate(parts), stop, came

    def _bytes(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each symbol): characters without a piece become bytes."""
        bare = symbols >= len(self.vocabulary)
        wide = np.ones(len(symbols), dtype=np.int64)
        if not bare.any():
            return symbols, wide
        chars = symbols[bare] - len(self.vocabulary)
        wide[bare] += (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        raw = np.frombuffer("".join(map(chr, chars.tolist())).encode("utf-8", errors="surrogatepass"), dtype=np.uint8)
        out = np.repeat(symbols, wide)
        out[np.repeat(bare, wide)] = self.byte_ids[raw]
        return out, wide

    def _forget(self) -> None:
        self.kept: dict[str, int] = {}  # segment -> row of the arrays
        self.ids_of, self.filled = np.zeros(0, dtype=np.int32), 0
        self.begin, self.stop, self.came = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def _keep(self, segments: list[str], known: int) -> None:
        """Results without skips of new segments."""
        ids, stop, came = self._many(segments, np.zeros(len(segments), dtype=np.uint64), known)
        if self.filled + len(ids) > len(self.ids_of):
            self.ids_of = np.concatenate([self.ids_of[: self.filled], ids, np.zeros(self.filled + len(ids), dtype=np.int32)])
        else:
            self.ids_of[self.filled : self.filled + len(ids)] = ids
        size = np.diff(np.sort(stop), prepend=0)[np.argsort(np.argsort(stop, kind="stable"), kind="stable")]
        self.kept.update(zip(segments, range(len(self.kept), len(self.kept) + len(segments)), strict=True))
        self.begin = np.concatenate([self.begin, self.filled + stop - size])
        self.stop = np.concatenate([self.stop, self.filled + stop])
        self.came = np.concatenate([self.came, came])
        self.filled += len(ids)

    def _alone(self, segment: str, key: np.ndarray, limit: np.uint64) -> tuple[int, ...]:
        """An occurrence with as many draws as it may need: fewer than three candidates a character come up."""
        first = int(_skips(key, FIRST, limit)[0])
        blocks = [_skips(key + np.uint64(k + 1), 32, limit) for k in range(0, 3 * len(segment), 32)]
        more = int.from_bytes(np.concatenate(blocks).astype("<u4").tobytes(), "little")
        return self.segment(segment, more << FIRST | first)

    def _load(self, segments: list[str], keys: np.ndarray, limit: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each occurrence)."""
        if len(self.kept) > KEPT:
            self._forget()
        known = FIRST if limit else 3 * MOST_CHARS
        new = [s for s in set(segments).difference(self.kept) if len(s) <= MOST_CHARS]
        if new:
            self._keep(new, known)
        row = np.fromiter(map(self.kept.get, segments, repeat(-1)), dtype=np.int64, count=len(segments))
        short = row >= 0
        begin, size = np.zeros(len(row), dtype=np.int64), np.zeros(len(row), dtype=np.int64)
        begin[short], size[short] = self.begin[row[short]], (self.stop - self.begin)[row[short]]
        late, found = ~short, [self.ids_of]
        if limit:
            came = np.zeros(len(row), dtype=np.int64)
            came[short] = self.came[row[short]]
            late |= came > known
            skips = _skips(keys, FIRST, limit)
            due = np.flatnonzero(~late & ((skips & ((np.uint64(1) << came.astype(np.uint64)) - np.uint64(1))) != 0))
            if len(due):
                ids, stop, came = self._many([segments[k] for k in due.tolist()], skips[due], known)
                late[due[came > known]] = True
                order = np.argsort(stop, kind="stable")
                size[due[order]] = np.diff(stop[order], prepend=0)
                begin[due] = len(self.ids_of) + stop - size[due]
                found.append(ids)
        late = np.flatnonzero(late)
        if len(late):
            own = [self._alone(segments[k], keys[k : k + 1], limit) if limit else self.segment(segments[k]) for k in late.tolist()]
            size[late] = [len(x) for x in own]
            begin[late] = sum(map(len, found)) + np.cumsum(size[late]) - size[late]
            found += [np.array(x, dtype=np.int32) for x in own]
        ids, ends = np.concatenate(found), np.cumsum(size)
        return ids[np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], size

    def encode_many(self, texts: list[str], keys: Iterable[int], seed: int = SEED, dropout: float = DROPOUT) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each); dropout 0 gives the plain segmentation."""
        self.prepare()
        limit = np.uint64(int(dropout * (1 << 32)))
        keys = [np.uint64((k * 0x9E3779B97F4A7C15 + seed * 0xC2B2AE3D27D4EB4F) & _M) for k in keys]
        flat, sizes = [], np.zeros(len(texts), dtype=np.int64)
        for at, part in bounded_chunks(texts, LOAD_CHARS):
            if len(part) == 1 and len(part[0]) > LOAD_CHARS:  # a long text goes segment after segment
                found, place = (m[0] for m in _SEGMENT.finditer(" " + part[0])), 0
                while segments := list(islice(found, LOAD_SEGMENTS)):
                    ids, _ = self._load(segments, mix64(np.arange(place, place + len(segments), dtype=np.uint64) + keys[at]), limit)
                    flat.append(ids)
                    sizes[at] += len(ids)
                    place += len(segments)
                continue
            each = [_SEGMENT.findall(" " + t) if t else [] for t in part]
            counts = np.array([len(x) for x in each])
            ends = np.cumsum(counts)
            place = np.arange(ends[-1], dtype=np.uint64) - np.repeat(ends - counts, counts).astype(np.uint64)
            own = np.repeat(np.array(keys[at : at + len(part)], dtype=np.uint64), counts)
            ids, size = self._load([s for x in each for s in x], mix64(place + own), limit)
            flat.append(ids)
            total = np.concatenate([[0], np.cumsum(size)])
            sizes[at : at + len(part)] = total[ends] - total[ends - counts]
        return np.concatenate(flat) if flat else np.zeros(0, dtype=np.int32), sizes

    def encode(self, text: str, key: int = 0, seed: int = SEED, dropout: float = DROPOUT) -> list[int]:
        """Ids of a whole text; the empty text has none."""
        return self.encode_many([text], [key], seed, dropout)[0].tolist()

    def decode_many(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The texts of `sizes` ids each."""
        self.prepare()
        out, at = [], 0
        for _, part in _runs(sizes):
            own = ids[at : at + int(part.sum())]
            at += len(own)
            begin, size = self.raw_start[own], self.raw_stop[own] - self.raw_start[own]
            ends = np.cumsum(size)
            raw = self.raw_bytes[np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
            cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(part)])].tolist()
            out += [raw[a:b].decode("utf-8", errors="replace")[1:] for a, b in zip(cuts, cuts[1:])]
        return out

    def decode(self, ids) -> str:
        ids = np.asarray(ids, dtype=np.int64)
        return self.decode_many(ids, np.array([len(ids)]))[0]


def _runs(sizes: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the first, sizes) in runs that sum to about `most`; a larger one stands alone."""
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield at, sizes[at:to]
        at = to


def _skips(keys: np.ndarray, n: int, limit: np.uint64) -> np.ndarray:
    """A mask for each key: bit k is set if its k-th draw of 32 bits, of n, is below the limit."""
    out = np.zeros(len(keys), dtype=np.uint64)
    for k in range(0, n, 2):
        h = mix64(keys + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & _M))
        out |= ((h & np.uint64(0xFFFFFFFF)) < limit).astype(np.uint64) << np.uint64(k)
        out |= ((h >> np.uint64(32)) < limit).astype(np.uint64) << np.uint64(k + 1)
    return out


def _shared(spark: SparkSession, pieces: Pieces):
    python_workers(spark)
    return spark.sparkContext.broadcast(pieces)  # the vocabulary: its size does not follow the data


def encode(
    docs: DataFrame, pieces: Pieces, key: str = "doc_id", text: str = "text", seed: int = SEED, dropout: float = DROPOUT,
    turns: bool = False, back: bool = False,
) -> DataFrame:
    """(key, ids) for every row: array of int; null text: null; empty text: empty array.

    Reruns agree: draws depend on seed, key and place alone, so repeated rows encode alike.
    With `turns`, rows of one key that stand one after the other are numbered and draw
    apart. With `back`, a column `text` has what the ids decode to. Null keys draw alike.
    Columns of `docs` but key and text play no part. Empty table: empty result.
    """
    shared = _shared(docs.sparkSession, pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, turn = shared.value.prepare(), None, 0
        for batch in batches:  # the key goes by as it is: pandas would round a long beside a null
            texts = batch.column(2).to_pylist()
            drawn = batch.column(1).to_pylist()
            if turns:
                for k, h in enumerate(drawn):
                    turn = turn + 1 if h == last else 0
                    last, drawn[k] = h, h + turn * 0xD6E8FEB86659FD93
            for at, part in bounded_chunks([t or "" for t in texts], 4 * LOAD_CHARS):
                ids, sizes = own.encode_many(part, drawn[at : at + len(part)], seed, dropout)
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), type=pa.int32())
                none = pa.array([t is None for t in texts[at : at + len(part)]])
                columns = [batch.column(0).slice(at, len(part)), pa.ListArray.from_arrays(ends, pa.array(ids, type=pa.int32()), mask=none)]
                if back:
                    said = own.decode_many(ids, sizes)
                    columns.append(pa.array([None if t is None else x for t, x in zip(texts[at : at + len(part)], said, strict=True)], type=pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["k", "ids", "text"][: len(columns)])

    kind = docs.schema[key].dataType.simpleString()
    h = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("0")))
    rows = docs.select(F.col(key).alias("k"), h.alias("h"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"k {kind}, ids array<int>" + ", text string" * back).withColumnRenamed("k", key)


def decode(encoded: DataFrame, pieces: Pieces, key: str = "doc_id") -> DataFrame:
    """(key, text) of (key, ids): exactly the text that was encoded; null ids: null."""
    shared = _shared(encoded.sparkSession, pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.prepare()
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            said = own.decode_many(lists.flatten().to_numpy(), sizes)
            texts = [x if ok else None for x, ok in zip(said, lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], ["k", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("k"), "ids").mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)


def op5_pieces(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, ids, n_ids, decoded_sha256 (of the text that the ids decode to)."""
    encoded = encode(table(spark, sf_dir, "documents"), Pieces.load(), back=True)
    size = F.when(F.col("ids").isNotNull(), F.size("ids")).otherwise(0).cast("long")
    return encoded.select("doc_id", "ids", size.alias("n_ids"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
