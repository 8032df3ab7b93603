"""Benchmark decontamination over a distributed positional inverted index.

The corpus is indexed once, in segments of whole documents, one row each: for every term, the ascending list of its
positions. Positions count words across the segment, with a gap after each document, so a phrase never crosses
documents. A segment holds about `SEGMENT_BYTES` of text, or one longer document.

Query phrases are answered in a segment all together. The positions of each phrase's rarest term, less the term's
offset, are its candidate starts; a phrase with a term that the segment lacks has none. They are intersected with the
offset-adjusted list of the next rarest term, and so on. With `slop` above 0 a start also counts as a proximity match
if each term has a position within `slop` words of its place in the phrase.

Test items go through in blocks of bounded size against the same index, so their number has no limit; a block is the
only thing that is sent to the tasks. No shuffle carries text or postings; matches of several blocks are merged by the
segment and place of their document, which the index holds.

Nulls and edges: a null or empty text has no words; items without words never match; a null doc_id is kept as it is;
repeated documents are each answered; an empty benchmark or document table gives zero counts or no rows; item ids
are compared as strings, and items that share an id count once; items with a null id count like one item, a null entry
of `items` that has no part in the joined ids; further columns of either table are ignored, but for those named in
`keep`, which stand in for doc_id in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odolith.llm.text import LOWER_WORDS, ragged, slices, words
from odolith.session import cut, scratch_path, ship

SEGMENT_BYTES = 8 << 20
#: Text of test items that one block holds.
ITEM_BYTES = 4 << 20
#: Candidate starts that are intersected at once.
CANDIDATES = 1 << 20
WINDOW = 10
GAP = 1

#: A row is a segment of some MB. Parquet looks at the size of pages and row groups after 100 rows at first, so a task's whole input would be one page, in memory when written and when read.
ROW_BY_ROW = {"compression": "zstd", "parquet.block.size": 4 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}

POSTINGS = "segment long, n_words array<bigint>, terms array<string>, counts array<int>, positions binary"


class Phrases:
    """One block of test items: its dictionary of terms and its distinct windows, a row of terms each (-1 after the last)."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        flat, counts = words(pa.array([text for _, text in items], pa.string()), LOWER_WORDS)
        coded = flat.dictionary_encode()
        self.terms: pa.Array = coded.dictionary.cast(pa.string())
        codes, at = np.asarray(coded.indices).astype(np.int32), 0
        found: dict[tuple[int, ...], set[str | None]] = {}
        for (item, _), n in zip(items, counts.tolist()):
            own = codes[at : at + n].tolist()
            for i in range(max(1, n - window + 1) if n else 0):
                found.setdefault(tuple(own[i : i + window]), set()).add(item)
            at += n
        self.items = [in_order(x) for x in found.values()]
        self.size = np.array([len(w) for w in found], np.int64)
        self.grid = np.full((len(found), window), -1, np.int32)
        for k, w in enumerate(found):
            self.grid[k, : len(w)] = w

    def order_by(self, frequency: np.ndarray) -> None:
        """Offsets of each window's terms, the rarest first; windows with a term that the corpus lacks go."""
        often = np.where(self.grid >= 0, np.append(frequency, 0)[self.grid], np.iinfo(np.int64).max)
        some = np.flatnonzero((often > 0).all(axis=1))
        self.items, self.size, self.grid = [self.items[i] for i in some.tolist()], self.size[some], self.grid[some]
        self.order = np.argsort(often[some], axis=1, kind="stable")


def blocks_of(benchmark: DataFrame, item_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """The test items, block by block; each has about item_bytes of text."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // item_bytes) + 1
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r.item, r.text) for r in part.collect()]


def build_index(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write the positional index of docs to path: POSTINGS, and the columns `keep` of each document as `rows`."""
    ship(docs.sparkSession)
    columns = docs.select("text", F.struct(*keep).alias("kept"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, batch in enumerate(slices(batches, size=segment_bytes)):
            flat, counts = words(batch.column("text"), LOWER_WORDS)
            coded = flat.dictionary_encode()
            term = np.asarray(coded.indices)
            place = np.arange(len(term), dtype=np.int32) + np.repeat(np.arange(len(counts), dtype=np.int32) * GAP, counts)
            order = np.argsort(term, kind="stable")
            size = np.bincount(term, minlength=len(coded.dictionary)).astype(np.int32)
            one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
            yield pa.RecordBatch.from_arrays([
                pa.array([task << 32 | k]), one(pa.array(counts)), one(coded.dictionary.cast(pa.string())), one(pa.array(size)), pa.array([place[order].astype("<i4").tobytes()]), one(batch.column("kept")),
            ], names=["segment", "n_words", "terms", "counts", "positions", "rows"])

    kept = columns.schema["kept"].dataType.simpleString()
    columns.mapInArrow(segments, f"{POSTINGS}, rows array<{kept}>").write.options(**ROW_BY_ROW).parquet(path)


def term_counts(index: DataFrame, terms: pa.Array) -> np.ndarray:
    """Occurrences of each term of a block in the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                at = found_in(terms, batch.column("terms")[k].values)
                total[at >= 0] += batch.column("counts")[k].values.to_numpy()[at[at >= 0]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    out = np.zeros(len(terms), np.int64)
    for r in index.select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return out


def found_in(terms: pa.Array, dictionary: pa.Array) -> np.ndarray:
    """The place of each term in a segment's dictionary, or -1."""
    return pc.fill_null(pc.index_in(terms, value_set=dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64)


class Segment:
    """The postings of one segment: sorted keys, each a term's place in the dictionary and a position."""

    def __init__(self, counts: np.ndarray, positions: bytes):
        self.counts, self.begin = counts.astype(np.int64), np.cumsum(counts, dtype=np.int64) - counts
        self.positions = np.frombuffer(positions, "<i4").astype(np.int64)
        self.keys = (np.repeat(np.arange(len(counts)), counts) << 32) + self.positions

    def near(self, term: np.ndarray, wanted: np.ndarray, slop: int) -> np.ndarray:
        """Whether each term has a position within `slop` of the wanted one."""
        base = term << 32
        i = np.searchsorted(self.keys, base + np.maximum(wanted - slop, 0))
        return (i < len(self.keys)) & (self.keys[np.minimum(i, len(self.keys) - 1)] <= base + wanted + slop)

    def starts(self, phrases: Phrases, term: np.ndarray, slop: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows, starts) of all matches. term: the place of each of the block's terms here, or -1."""
        grid = np.where(phrases.grid >= 0, term[phrases.grid], 0) if len(phrases.grid) else phrases.grid
        held = np.flatnonzero((grid >= 0).all(axis=1))
        if not len(held) or not len(self.keys):
            return
        first = phrases.order[held, 0]
        many = self.counts[grid[held, first]]
        ends = np.cumsum(many)
        at = 0
        while at < len(held):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CANDIDATES, "right")))
            own, n = held[at:to], many[at:to]
            w = np.repeat(own, n)
            start = self.positions[ragged(self.begin[grid[own, first[at:to]]], n)] - np.repeat(first[at:to], n)
            for k in range(1, phrases.grid.shape[1]):
                i = phrases.order[w, k]
                ok = (k >= phrases.size[w]) | self.near(grid[w, i].astype(np.int64), start + i, slop)
                w, start = w[ok], start[ok]
            ok = start >= 0
            yield w[ok], start[ok]
            at = to


def matches(index: DataFrame, phrases: Phrases, slop: int = 0) -> DataFrame:
    """One row for each document with a match: segment, nth, runs (merged word spans of exact matches, end exclusive), items, near_items."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                n_words = batch.column("n_words")[k].values.to_numpy()
                segment = Segment(batch.column("counts")[k].values.to_numpy(), batch.column("positions")[k].as_buffer())
                term = found_in(phrases.terms, batch.column("terms")[k].values)
                first = np.cumsum(n_words + GAP) - (n_words + GAP)
                hit: dict[int, list[tuple[int, int]]] = {}
                items: dict[int, set[str | None]] = {}
                close: dict[int, set[str | None]] = {}
                for w, start in segment.starts(phrases, term):
                    doc = np.searchsorted(first, start, "right") - 1
                    for d, s, x in zip(doc.tolist(), start.tolist(), w.tolist()):
                        hit.setdefault(d, []).append((s, s + int(phrases.size[x])))
                        items.setdefault(d, set()).update(phrases.items[x])
                for w, start in segment.starts(phrases, term, slop) if slop else ():
                    doc = np.maximum(np.searchsorted(first, start, "right") - 1, 0)
                    inside = (start >= first[doc]) & (start + phrases.size[w] <= (first + n_words)[doc])
                    for d, x in zip(doc[inside].tolist(), w[inside].tolist()):
                        close.setdefault(d, set()).update(phrases.items[x])
                some = sorted({*hit, *close})
                yield pa.RecordBatch.from_pydict({
                    "segment": [batch.column("segment")[k].as_py()] * len(some), "nth": some,
                    "runs": [[{"lo": a - int(first[d]), "hi": b - int(first[d])} for a, b in merged(hit.get(d, []))] for d in some],
                    "items": [in_order(items.get(d, set())) for d in some], "near_items": [in_order(close.get(d, set()) - items.get(d, set())) for d in some],
                }, schema=MATCH_SCHEMA)

    postings = index.select("segment", "n_words", "terms", "counts", "positions")
    return postings.mapInArrow(answer, "segment long, nth int, runs array<struct<lo:bigint,hi:bigint>>, items array<string>, near_items array<string>")


MATCH_SCHEMA = pa.schema([
    ("segment", pa.int64()), ("nth", pa.int32()), ("runs", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string())),
])


def in_order(ids: set[str | None]) -> list[str | None]:
    """Sorted, a null last."""
    return sorted(ids, key=lambda x: (x is None, x or ""))


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, item_bytes: int = ITEM_BYTES, segment_bytes: int = SEGMENT_BYTES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, n_words, n_hit (words inside an exact match), runs, items and near_items of every document."""
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "postings")
    build_index(docs, path, keep, segment_bytes)
    index = spark.read.parquet(path)
    found = None
    for items in blocks_of(benchmark, item_bytes):
        phrases = Phrases(items, window)
        phrases.order_by(term_counts(index, phrases.terms))
        block = cut(matches(index, phrases, slop), "matches")
        found = block if found is None else found.unionByName(block)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    # a document has one row in each block at most
    found = found.groupBy("segment", "nth").agg(join_runs(F.array_sort(F.flatten(F.collect_list("runs")))).alias("runs"), union("items").alias("items"), union("near_items").alias("near_items"))
    found = found.withColumn("near_items", F.array_except("near_items", "items"))
    rows = index.select("segment", F.posexplode(F.arrays_zip("rows", "n_words")).alias("nth", "row"))
    out = rows.join(found, ["segment", "nth"], "left").select("row.rows.*", F.col("row.n_words").alias("n_words"), *[or_empty(found, c) for c in ("runs", "items", "near_items")])
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r.hi - r.lo)
    return out.select(*keep, "n_words", n_hit.alias("n_hit"), "runs", "items", "near_items")


def or_empty(found: DataFrame, name: str) -> Column:
    return F.coalesce(name, F.array().cast(found.schema[name].dataType)).alias(name)


def join_runs(runs):
    """Sorted spans with those that touch or overlap made one."""
    empty = F.array().cast("array<struct<lo:bigint,hi:bigint>>")

    def step(done, r):
        last = F.element_at(done, -1)
        wider = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last.lo.alias("lo"), F.greatest(last.hi, r.hi).alias("hi"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)).hi >= r.lo), wider).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(runs, empty, step)


def digest(found: DataFrame) -> DataFrame:
    """The report columns of find_contamination()."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
