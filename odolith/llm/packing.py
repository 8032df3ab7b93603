"""Best-fit packing of documents into sequences of fixed length by exact-complement hashing.

Only the histogram of piece lengths decides the plan, and it has at most `capacity` entries whatever the corpus holds.
An index of the sums of one, two and three lengths is built once. From the longest length down, the gap left by a piece
is looked up there; a combination that fills it exactly is consumed as often as all its lengths are available, and
entries whose lengths have run out leave the index.
What no combination fills is placed by best fit: into the open sequence whose gap is the smallest that is wide enough.
The plan is a list of patterns with repeat counts. Pieces get ranks within their length by counts for each task and
length, and a rank names its pattern, repeat and place, so no task sees more than its own rows.

Nulls and edges: a null text is empty (one end id); a null doc_id is kept as it is; repeated rows are packed each;
an empty table gives no rows; a document of exactly the capacity is one piece; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odolith.llm.encoding import encoder
from odolith.llm.text import ragged, slices
from odolith.session import scratch_path, ship

CAPACITY = 1024

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"


def cut_pieces(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents of such sizes: owner, number, start and length of each piece. The first piece of a long document takes what does not fill a sequence."""
    count = np.maximum(1, -(-sizes // capacity))
    owner = np.repeat(np.arange(len(sizes)), count)
    number = ragged(np.zeros(len(sizes), np.int64), count)
    lead = sizes - (count - 1) * capacity
    start = np.where(number == 0, 0, lead[owner] + (number - 1) * capacity)
    return owner, number, start, np.where(number == 0, lead[owner], capacity)


def write_pieces(docs: DataFrame, path: str, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> None:
    """Tokenise docs (doc_id, text) and write a row for each piece; nth numbers the pieces of one length in one task (part)."""
    ship(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, size=2 << 20):
            ids, sizes = enc.encode(batch.column("text"), end_id)
            owner, number, start, length = cut_pieces(sizes, capacity)
            at = (np.cumsum(sizes) - sizes)[owner] + start
            body = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(body[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            same = length[order]
            fresh = np.flatnonzero(np.diff(same, prepend=-1))
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(same)) - np.repeat(fresh, np.diff(np.append(fresh, len(same)))) + seen[same]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()).take(pa.array(owner)), pa.array(number, pa.int32()), pa.array(start), pa.array(length, pa.int32()),
                pa.array(crc, pa.int64()), pa.array(np.full(len(owner), part), pa.int32()), pa.array(nth),
            ], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, PIECES).write.parquet(path)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one sequence) and how often each is used, for so many pieces of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def consume(pattern: tuple[int, ...]) -> int:
        need = np.bincount(pattern, minlength=capacity + 1)
        times = int((left[need > 0] // need[need > 0]).min())
        left[need > 0] -= times * need[need > 0]
        out.append((pattern, times))
        return times

    if left[capacity]:
        consume((capacity,))
    sums = Sums(left)
    for length in range(capacity - 1, 0, -1):
        while left[length]:
            sums.take(length)
            fill = sums.find(capacity - length)
            if fill is None:
                # nothing fills its gap now, so it fills no other's later
                sums.drop(length)
                break
            pattern = (length, *fill)
            times = consume(pattern)
            sums.take(length, -1)
            for x in pattern:
                sums.take(x, times)
    # best fit of the rest, with equal sequences taken together: gap -> {contents: how many}
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        for gap in range(length, capacity):
            while n and open_.get(gap):
                held, many = open_[gap].popitem()
                each = min(gap // length, max(1, n // many))
                used = min(many, n // each)
                if many > used:
                    open_[gap][held] = many - used
                add(open_, out, held + (length,) * each, used, capacity)
                n -= used * each
            if not n:
                break
        fit = capacity // length
        if n >= fit:
            add(open_, out, (length,) * fit, n // fit, capacity)
        if n % fit:
            add(open_, out, (length,) * (n % fit), 1, capacity)
    return out + [x for held in open_.values() for x in held.items()]


def add(open_: dict, out: list, held: tuple[int, ...], many: int, capacity: int) -> None:
    gap = capacity - sum(held)
    if not gap:
        out.append((held, many))
    else:
        open_[gap][held] = open_[gap].get(held, 0) + many


class Sums:
    """Which available lengths sum to a total, one, two or three of them.

    Built once: for each total a bit set of the longer halves of its pairs, and one of the longest parts of its triples.
    Pieces only ever leave, so an entry whose lengths have run out is struck when it is met, for good.
    """

    def __init__(self, have: np.ndarray):
        self.have, n = have.tolist(), len(have)
        ok, every = have > 0, np.arange(n)
        shortest = np.full(n, n)
        self.pairs, self.triples = [0] * n, [0] * n
        for total in range(2, n):
            longer = every[(total + 1) // 2 : total]
            good = longer[ok[longer] & ok[total - longer]]
            self.pairs[total] = bits(good, n)
            shortest[total] = good[0] if len(good) else n
        for total in range(3, n):
            longest = every[-(-total // 3) : total - 1]
            self.triples[total] = bits(longest[ok[longest] & (shortest[total - longest] <= longest)], n)

    def take(self, length: int, n: int = 1) -> None:
        self.have[length] -= n

    def drop(self, length: int) -> None:
        self.have[length] = 0

    def pair(self, total: int, most: int, strike: bool) -> tuple[int, int] | None:
        held = self.pairs[total] & ((2 << most) - 1)
        while held:
            a = held.bit_length() - 1
            b = total - a
            if self.have[a] > (a == b) and self.have[b] > 0:
                return a, b
            held ^= 1 << a
            if strike:
                self.pairs[total] ^= 1 << a
        return None

    def find(self, total: int) -> tuple[int, ...] | None:
        """The fewest lengths that sum to total, the longest first; None if no three do."""
        if self.have[total] > 0:
            return (total,)
        if found := self.pair(total, total - 1, strike=True):
            return found
        while self.triples[total]:
            a = self.triples[total].bit_length() - 1
            if self.have[a] > 0:
                self.have[a] -= 1
                found = self.pair(total - a, a, strike=False)
                self.have[a] += 1
                if found:
                    return (a, *found)
            self.triples[total] ^= 1 << a
        return None


def bits(members: np.ndarray, n: int) -> int:
    held = np.zeros(n, np.uint8)
    held[members] = 1
    return int.from_bytes(np.packbits(held, bitorder="little").tobytes(), "little")


class Places:
    """Where the piece of each rank within its length goes: runs of ranks that share a pattern and a place in it."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY):
        taken, runs, first = [0] * (capacity + 1), [[] for _ in range(capacity + 1)], 0
        for pattern, times in patterns:
            at = 0
            for length in pattern:
                runs[length].append((taken[length], first, at))
                taken[length] += times
                at += length
            first += times
        self.sequences = first
        self.runs = [np.array(r, np.int64).reshape(-1, 3) for r in runs]

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset."""
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for x in np.unique(length).tolist():
            own = np.flatnonzero(length == x)
            run = self.runs[x][np.searchsorted(self.runs[x][:, 0], rank[own], "right") - 1]
            sequence[own], offset[own] = run[:, 1] + rank[own] - run[:, 0], run[:, 2]
        return sequence, offset


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (as written by write_pieces) with sequence_id and offset."""
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    places = Places(plan(histogram, capacity), capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            keep = [batch.column(k) for k in ("doc_id", "piece", "start")]
            yield pa.RecordBatch.from_arrays(
                [*keep, batch.column("length").cast(pa.int64()), batch.column("ids_crc32"), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise and pack docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "pieces")
    write_pieces(docs, path, tokenizer, end_id, capacity)
    return place(spark.read.schema(PIECES).parquet(path), capacity)
