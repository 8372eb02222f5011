"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

The merges of a piece model are replayed by an agenda: the adjacent pair whose joined piece has the
best score is merged first, the left one among equals. A candidate merge is skipped for good if the
keyed hash of its place (where it starts, joins and ends), its unit, the unit's place in the text,
the document's id and the seed falls below ``dropout``; so one seed gives one segmentation of a
document, other seeds and documents others, and without dropout the model's own. The units of a text
are varied each on its own, the repeats of a unit too. Text decodes to itself: characters without a piece
become byte pieces, and so does the sign that stands for a space in piece names.

Text falls into units at places that no piece spans. Without dropout a unit is segmented once and
remembered; with dropout every occurrence is segmented, as each has skips of its own. Short units are
segmented side by side, as linked lists in arrays; longer ones with a heap; both give the same.

Defined cases. Null text gives null ids, empty text none. A null doc_id counts as one id. Repeated
rows each get the same ids. Columns besides doc_id and text are passed on; those with the name of a
result column, in any case, give way to it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchlife.llm.bytescan import U64, mix, span_hashes, texts
from merchlife.llm.bytescan import pieces as cut
from merchlife.llm.storage import replaced
from merchlife.llm.unitmemo import UnitMemo

SPACE = "▁"
NONE = np.int32(1 << 30)  # the rank of pairs that do not join
WIDE = 40  # characters of units that are segmented side by side
WIDTHS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 20, 28, WIDE)  # units of like lengths go together
_A, _B, _C = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@dataclass(frozen=True)
class Dropout:
    rate: float = 0.1
    seed: int = 20240601


class PieceModel:
    """A merge-type piece model: symbols, the pairs that join, and the bytes of each id."""

    def __init__(self, path: str):
        source = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = source.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * self.size
        self.byte_id = np.zeros(256, np.int32)
        self.symbol: dict[str, int] = {}
        score: dict[int, float] = {}
        for i in range(self.size):
            name = source.id_to_piece(i)
            if source.is_byte(i):
                self.bytes_of[i] = bytes([int(name[3:5], 16)])
                self.byte_id[int(name[3:5], 16)] = i
            elif not (source.is_control(i) or source.is_unknown(i) or source.is_unused(i)):
                text = name.replace(SPACE, " ")
                self.bytes_of[i], self.symbol[text], score[i] = text.encode(), i, source.get_score(i)
        spelled = dict(self.symbol)
        for text in spelled:
            for char in text:
                self.symbol.setdefault(char, len(self.symbol) + self.size)
        self.of_code = np.full(0x10000, -1, np.int32)
        for char, i in self.symbol.items():
            if len(char) == 1 and ord(char) < 0xFFFF:
                self.of_code[ord(char)] = i
        order = {i: n for n, i in enumerate(sorted(score, key=lambda i: -score[i]))}
        self.joins: dict[tuple[int, int], tuple[int, int]] = {}
        for text, i in spelled.items():
            for at in range(1, len(text)):
                left, right = self.symbol.get(text[:at]), self.symbol.get(text[at:])
                if left is not None and right is not None:
                    self.joins[left, right] = (order[i], i)
        self._table()
        self.spans = np.zeros((256, 256), bool)  # last byte of a character, first byte of the next, inside a piece
        for text in spelled:
            for a, b in zip(text, text[1:], strict=False):
                self.spans[a.encode()[-1], b.encode()[0]] = True
        self.length = np.array([len(b) for b in self.bytes_of], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def _table(self) -> None:
        """The joins as an open hash table that arrays of pairs can be looked up in."""
        bits = max(4, int(len(self.joins) * 4).bit_length())
        self.shift = U64(64 - bits)
        keys = np.array([left << 32 | right for left, right in self.joins], U64)
        rank = np.array([r for r, _ in self.joins.values()], np.int32)
        into = np.array([i for _, i in self.joins.values()], np.int32)
        self.key = np.full((1 << bits) + 64, U64(2**64 - 1))
        self.rank, self.into = np.full(len(self.key), NONE), np.zeros(len(self.key), np.int32)
        self.probes = 0
        todo = np.arange(len(keys))
        while len(todo):
            slot = ((keys[todo] * U64(_A)) >> self.shift).astype(np.int64) + self.probes
            free = self.key[slot] == U64(2**64 - 1)
            slot, mine = slot[free], todo[free]
            slot, once = np.unique(slot, return_index=True)
            self.key[slot], self.rank[slot], self.into[slot] = keys[mine[once]], rank[mine[once]], into[mine[once]]
            todo = np.setdiff1d(todo, mine[once], assume_unique=True)
            self.probes += 1

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joined piece of pairs; rank NONE where nothing joins."""
        keys = left.astype(np.int64).astype(U64) << U64(32) | right.astype(np.int64).astype(U64)
        keys[(left < 0) | (right < 0)] = U64(2**64 - 2)
        slot = ((keys * U64(_A)) >> self.shift).astype(np.int64)
        found = self.key[slot]
        rank, into = self.rank[slot], self.into[slot]
        rank[found != keys] = NONE
        todo = np.flatnonzero((found != keys) & (found != U64(2**64 - 1)))
        while len(todo):
            slot[todo] += 1
            at = slot[todo]
            found = self.key[at]
            hit = found == keys[todo]
            on = todo[hit]
            rank[on], into[on] = self.rank[at[hit]], self.into[at[hit]]
            todo = todo[~hit & (found != U64(2**64 - 1))]
        return rank, into

    def boundaries(self, data: np.ndarray) -> np.ndarray:
        """Places where a unit starts, the first byte's apart."""
        inner = (data[1:] & 0xC0) == 0x80
        return np.flatnonzero(~inner & ~self.spans[data[:-1], data[1:]]) + 1

    def segment(self, text: str, start: np.ndarray, end: np.ndarray, salts: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units text[start:end], one after the other, and how many each has."""
        symbols, lengths = self._symbols(text), end - start
        first, count, pool, size = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), [], 0
        for low, high in (*zip(WIDTHS, WIDTHS[1:], strict=False), (WIDE, None)):
            pick = np.flatnonzero((lengths > low) & (lengths <= high if high else True))
            for part in np.array_split(pick, max(1, len(pick) // 20_000)):
                if not len(part):
                    continue
                if high:
                    flat, n = self._side_by_side(text, symbols, start[part], lengths[part], salts[part], rate)
                else:
                    one = [self.agenda(text[a:b], x, rate) for a, b, x in zip(start[part].tolist(), end[part].tolist(), salts[part].tolist(), strict=True)]
                    flat, n = np.array([i for o in one for i in o], np.int32), np.array([len(o) for o in one], np.int64)
                first[part], count[part] = size + np.cumsum(n) - n, n
                pool.append(flat)
                size += len(flat)
        if not pool:
            return np.empty(0, np.int32), count
        before = np.cumsum(count) - count
        return np.concatenate(pool)[np.arange(size) + np.repeat(first - before, count)], count

    def segment_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same of separate units without dropout."""
        chars = [u.decode("utf-8") for u in units]
        end = np.cumsum(np.fromiter(map(len, chars), np.int64, len(chars)))
        return self.segment("".join(chars), np.concatenate([[0], end[:-1]]), end, np.zeros(len(chars), U64), 0.0)

    def _spelled(self, symbols: list[int], char_at: list[str]) -> list[int]:
        """Symbols without an id as byte pieces."""
        out: list[int] = []
        for symbol, text in zip(symbols, char_at, strict=True):
            if 0 <= symbol < self.size:
                out.append(symbol)
            else:
                out.extend(self.byte_id[b] for b in text.encode())
        return out

    def _side_by_side(self, text: str, symbols: np.ndarray, start: np.ndarray, lengths: np.ndarray, salts: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
        """Units as rows of linked lists: a place is a character, or the piece that starts there if it is alive."""
        n, wide = len(start), int(lengths.max()) + 1  # a place more, for the end
        alive = np.arange(wide, dtype=np.int32)[None] < lengths[:, None]
        inside = np.flatnonzero(alive)
        alive = alive.reshape(-1)
        row = np.repeat(np.arange(n, dtype=np.int64), lengths)
        sym = np.full(n * wide, -1, np.int32)
        sym[inside] = symbols[np.arange(len(inside)) + np.repeat(start - np.cumsum(lengths) + lengths, lengths)]
        after = np.tile(np.arange(1, wide + 1, dtype=np.int32), n)
        before = np.tile(np.arange(-1, wide - 1, dtype=np.int32), n)
        rank, into = np.full(n * wide, NONE), np.zeros(n * wide, np.int32)

        def offer(left: np.ndarray, right: np.ndarray, row: np.ndarray) -> None:
            r, t = self.lookup(sym[left], sym[right])
            if rate > 0:
                on = np.flatnonzero(r < NONE)
                a, b, base = left[on], right[on], row[on] * wide
                r[on[self._skipped(salts[row[on]], a - base, b - base, after[b], rate)]] = NONE
            rank[left], into[left] = r, t

        pairs = inside[inside - row * wide < lengths[row] - 1]
        offer(pairs, pairs + 1, pairs // wide)
        rows, table = np.arange(n), rank.reshape(n, wide)
        while True:
            best = table[rows].argmin(1) if len(rows) < n else table.argmin(1)
            on = rank[rows * wide + best] < NONE
            rows, best = rows[on], best[on]
            if not len(rows):
                break
            base = rows * wide
            left = base + best
            gone = base + after[left]
            right = base + after[gone]
            sym[left], after[left], before[right] = into[left], after[gone], best
            rank[gone], rank[left], alive[gone] = NONE, NONE, False
            ahead = after[left] < lengths[rows]  # another piece follows
            behind = before[left] >= 0
            offer(np.concatenate([left[ahead], (base + before[left])[behind]]), np.concatenate([right[ahead], left[behind]]), np.concatenate([rows[ahead], rows[behind]]))
        count = alive.reshape(n, wide).sum(1)
        out = sym[alive]
        odd = (out < 0) | (out >= self.size)
        if not odd.any():
            return out, count
        pieces_of: list[list[int]] = [[i] for i in out.tolist()]
        at = np.flatnonzero(alive)
        owner = at // wide
        for i in np.flatnonzero(odd).tolist():
            low = int(start[owner[i]] + at[i] - owner[i] * wide)
            pieces_of[i] = [int(self.byte_id[b]) for b in text[low : low + int(after[at[i]] - at[i] + owner[i] * wide)].encode()]
        sizes = np.fromiter(map(len, pieces_of), np.int64, len(pieces_of))
        return np.array([x for p in pieces_of for x in p], np.int32), np.bincount(owner, weights=sizes, minlength=n).astype(np.int64)

    def _symbols(self, text: str) -> np.ndarray:
        """The symbol of each character, -1 where there is none."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        symbols = self.of_code[np.minimum(codes, 0xFFFF)]
        for i in np.flatnonzero(codes >= 0xFFFF).tolist():
            symbols[i] = self.symbol.get(text[i], -1)
        return symbols

    @staticmethod
    def _skipped(salt: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, rate: float) -> np.ndarray:
        key = start.astype(U64) * U64(_A) + middle.astype(U64) * U64(_B) + end.astype(U64) * U64(_C)
        return mix(key + salt) < U64(int(rate * 2.0**64) if rate < 1 else 2**64 - 1)

    def agenda(self, text: str, salt: int, rate: float) -> list[int]:
        """The same with a heap: for long units, in time n log n."""
        n = len(text)
        sym = [self.symbol.get(c, -1) for c in text]
        end = list(range(1, n + 1))
        before, heap = list(range(-1, n - 1)), []

        def offer(i: int) -> None:
            j = end[i]
            if i < 0 or j >= n:
                return
            join = self.joins.get((sym[i], sym[j]))
            if join is None:
                return
            one = lambda x: np.array([x], np.int64)
            if rate > 0 and self._skipped(np.array([salt], U64), one(i), one(j), one(end[j]), rate)[0]:
                return
            heapq.heappush(heap, (join[0], i, j, end[j], join[1]))

        alive = [True] * n
        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, k, piece = heapq.heappop(heap)
            if not (alive[i] and j < n and alive[j] and end[i] == j and end[j] == k):
                continue
            sym[i], end[i], alive[j] = piece, k, False
            if k < n:
                before[k] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        starts = [i for i in range(n) if alive[i]]
        return self._spelled([sym[i] for i in starts], [text[i : end[i]] for i in starts])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows and where each starts; the space put before each text is taken off."""
        n = self.length[ids]
        before = np.cumsum(n) - n
        data = self.all_bytes[np.arange(int(n.sum())) + np.repeat(self.first[ids] - before, n)]
        total = np.concatenate([[0], np.cumsum(n)])
        ends = np.concatenate([[0], np.cumsum(counts)])
        offsets = total[ends]
        keep = np.ones(len(data), bool)
        keep[offsets[:-1][counts > 0]] = False
        return data[keep], offsets - np.concatenate([[0], np.cumsum(counts > 0)])


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """Once for each worker."""
    return PieceModel(path)


def unit_salts(data: np.ndarray, start: np.ndarray, end: np.ndarray, place: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A salt for each unit data[start:end], from its bytes, its place in its text and the salt of its document."""
    return mix(mix(salt + place.astype(U64) * U64(_A)) + span_hashes(data, start, end))


def encode_column(m: PieceModel, memo: UnitMemo, column: pa.Array, salt: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and how many each has. A space goes before each text that is not empty."""
    data, offsets = texts(column)
    n = len(column)
    lengths = np.diff(offsets)
    some = lengths > 0
    first = np.cumsum(lengths + some) - lengths - some
    flat = np.full(len(data) + int(some.sum()), 32, np.uint8)
    flat[np.arange(len(data)) + np.repeat(np.cumsum(some), lengths)] = data
    if not len(flat):
        return np.empty(0, np.int32), np.zeros(n, np.int64)
    start = np.union1d(first[some], m.boundaries(flat))
    end = np.append(start[1:], len(flat))
    owner = np.searchsorted(first[some], start, "right") - 1
    rows = np.flatnonzero(some)[owner]
    if rate > 0:
        chars = np.cumsum((flat & 0xC0) != 0x80)  # characters up to each byte
        stop = chars[end - 1]
        salts = unit_salts(flat, start, end, start - first[rows], salt[rows])
        ids, counts = m.segment(flat.tobytes().decode("utf-8"), np.concatenate([[0], stop[:-1]]), stop, salts, rate)
    else:
        ids, counts = memo.ids(flat, start, end)
    return ids, np.bincount(rows, weights=counts, minlength=n).astype(np.int64)


def _salts(keys: pa.Array, dropout: Dropout) -> np.ndarray:
    document = mix(np.asarray(keys.fill_null(0)).astype(np.int64).view(U64) + U64(dropout.seed % 2**64))
    return mix(document + U64(dropout.seed * 2654435761 % 2**64))


def encode(docs: DataFrame, path: str, dropout: Dropout = Dropout()) -> DataFrame:
    """``docs`` with ``ids`` (array of int), ``n_pieces`` and ``lossless`` (the ids decode to the text); columns of these names give way."""
    kept = [c for c in docs.columns if c != "text"]
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), "text", key_of().alias("key"))
    schema = T.StructType([row.schema["row"], T.StructField("text", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("lossless", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        memo = UnitMemo(lambda units, _: m.segment_units(units))
        for batch in cut(batches):
            column = batch.column("text")
            ids, counts = encode_column(m, memo, column, _salts(batch.column("key"), dropout), dropout.rate)
            back, at = m.decode(ids, counts)
            data, offsets = texts(column)
            if len(back) == len(data) and np.array_equal(at, offsets):
                wrong = np.searchsorted(offsets, np.flatnonzero(back != data), "right") - 1
                same = np.ones(len(batch), bool)
                same[wrong] = False
            else:
                same = np.array([back[at[i] : at[i + 1]].tobytes() == data[offsets[i] : offsets[i + 1]].tobytes() for i in range(len(batch))], bool)
            cuts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            none = np.asarray(column.is_null())
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids.astype(np.int32)), mask=pa.array(none))
            yield pa.record_batch([batch.column("row"), column, lists, pa.array(counts), pa.array(same)], names=["row", "text", "ids", "n_pieces", "lossless"])

    out = row.mapInArrow(run, schema)
    results = ("ids", "n_pieces", "lossless")
    return out.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in results), *results)


def key_of() -> Column:
    return F.coalesce(F.xxhash64(F.col("doc_id").cast("string")), F.lit(0))


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``text`` made from column ``ids``; null ids give null. A column named text gives way."""
    row = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.col(ids).alias("ids"))
    schema = T.StructType([row.schema["row"], T.StructField("text", T.StringType())])

    def run(batches):
        m = model(path)
        for batch in batches:
            column = batch.column("ids")
            counts = np.asarray(pa.compute.list_value_length(column).fill_null(0)).astype(np.int64)
            data, at = m.decode(np.asarray(column.flatten()).astype(np.int64), counts)
            made = [None if null else data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace") for i, null in enumerate(column.is_null().to_pylist())]
            yield pa.record_batch([batch.column("row"), pa.array(made, pa.string())], names=["row", "text"])

    return replaced(row.mapInArrow(run, schema), rows.columns, text=F.col("text"))
