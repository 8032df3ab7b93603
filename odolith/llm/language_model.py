"""A hierarchical Pitman-Yor language model of words in context and of their spelling.

Every word, and an end token for each text, is a customer of the restaurant of the word before it (the end token before
the first). Its parent is the restaurant of words without context, whose base measure spells a word letter by letter:
the restaurant of a context of up to four letters has that of the context without its first letter as parent, down to
the empty context and a uniform choice of code points. A table in a restaurant is a customer of its parent; tables of
the words' restaurant are customers of the spelling. A word that training lacks has the probability of its spelling, so
all strings together have probability 1 in every context. (The base score counts all unknown words as one outcome, so
that only known tokens compare directly; `score_known` and `base_known` are those parts.)

Seating is a Gibbs sampler (see `seating`): the tables of a dish are redrawn given those of all others. It alternates
between blocks: word contexts given the words, spelling given the tables of words, words given spelling and contexts,
word contexts again. Blocks are drawn in parallel with the other blocks' counts as of the round before; a block burns in
anew each time. Probabilities are averaged over the last `samples` sweeps.

Shards: contexts are dealt by word, words by word, both known by 64-bit hashes (two words with one hash, 1 in 10^7 for
millions of words, would count as one). Contexts with more than a 4 x shards'th of all tokens, of which there are fewer
than that, are dealt by the next word as well, so that no shard holds a frequent word's followers alone; they are
broadcast as three numbers each. The number of shards follows the tokens, and there are four shards of contexts for one
of words. A shard of contexts asks a shard of words by one message, so there are at most as many messages as distinct
words in all shards of contexts together, however many shards there are. Spelling contexts are dealt by their last two
letters over as many groups as the words need, the level of one letter by that, and the empty context is a row for each
letter; what one pair of letters holds is bounded by the alphabet. Text moves once for words and once as hashed word
pairs. The first seating of the contexts keeps the distinct pairs of its shard, and of each slice of texts which of them
occur where, in buckets of shards; the second reads these where they lie. Ids of texts go with one message of their
slice, and sums of a slice's texts come back packed, one row a shard.

Nulls and edges: a null text is an empty one, scored by its end token; a null doc_id trains; repeated rows count each;
an empty table gives no rows; without training rows each letter is uniform; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odolith.llm.seating import DISCOUNT, STRENGTH, Restaurants
from odolith.llm.text import LOWER, byte_view, ragged, slices, words
from odolith.session import cut, scratch_path, ship

ORDER, SAMPLES, BURN_IN, ROUNDS = 4, 3, 3, 2
#: Bytes of text that are hashed at once, and tokens of a shard.
BATCH_BYTES, SHARD_TOKENS = 12 << 20, 1_500_000
#: Whole numbers from which on they are compressed.
PACKED_FROM, ZSTD = 256, pa.Codec("zstd")
#: Shards of contexts for each shard of words, and the fewest of either.
CONTEXTS_A_WORD, LEAST_SHARDS = 4, 8
#: Groups of spelling contexts for each shard of words.
SPELLING_GROUPS = 8
START, STOP = 0x110000, 0x110001
CODE_POINTS = 0x110001
LETTER = np.int64(1) << 21


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 2 by 7; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def narrow(a: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the greatest needs, after that number; many of them compressed, after their number."""
    width = next(w for w in (1, 2, 4, 8) if not len(a) or int(a.max()) < 1 << 8 * w)
    body = a.astype(f"<u{width}").tobytes()
    if len(a) < PACKED_FROM:
        return bytes([width]) + body
    return bytes([width | 16]) + len(a).to_bytes(8, "little") + ZSTD.compress(body, asbytes=True)


def wide(body: bytes | pa.Buffer) -> np.ndarray:
    body = memoryview(body)
    width = body[0] & 15
    if body[0] & 16:
        return np.frombuffer(ZSTD.decompress(body[9:], int.from_bytes(body[1:9], "little") * width), f"<u{width}").astype(np.int64)
    return np.frombuffer(body, f"<u{width}", offset=1).astype(np.int64)


def hashes(values: pa.Array) -> np.ndarray:
    data, at = byte_view(values)
    bounds, data = at.tolist(), bytes(data)
    return np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(bounds, bounds[1:])), np.uint64, len(values))


END = np.uint64(xxhash.xxh3_64_intdigest(b""))


def one(values: pa.Array) -> pa.Array:
    """An array that holds one list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def ascending(key: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 and below a bound in ascending order, and where each stood."""
    bits = len(key).bit_length()
    if below.bit_length() + bits > 63:
        order = np.argsort(key)
        return key[order], order
    # numbers with their places below them: sorting these is cheaper than finding an order
    both = np.sort(key << bits | np.arange(len(key)))
    return both >> bits, both & ((1 << bits) - 1)


class Hot:
    """Frequent contexts, by hash in ascending order: customers of each, and tables where they are known."""

    def __init__(self, rows: dict[int, tuple[int, int]]):
        self.hash = np.array(sorted(rows), np.uint64)
        self.customers, self.tables = (np.array([rows[k][i] for k in sorted(rows)], np.int64) for i in (0, 1))

    def among(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes v are frequent contexts, and their places here."""
        if not len(self.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hash, v), len(self.hash) - 1)
        found = np.flatnonzero(self.hash[at] == v)
        return found, at[found]


class Batch:
    """The tokens of a slice of the texts: the end token is word 0, and each text ends with it."""

    def __init__(self, batch: pa.RecordBatch):
        flat, sizes = words(batch.column("text"), LOWER)
        coded = flat.dictionary_encode()
        self.words = pa.concat_arrays([pa.array([""], pa.large_string()), coded.dictionary.cast(pa.large_string())])
        ends = np.cumsum(sizes + 1) - 1
        self.token = np.zeros(len(flat) + len(sizes), np.int32)
        inside = np.ones(len(self.token), bool)
        inside[ends] = False
        self.token[inside] = np.asarray(coded.indices) + 1
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
        self.train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
        # each text begins after an end token
        self.before = np.concatenate([self.token[:0], np.zeros(min(1, len(self.token)), np.int32), self.token[:-1]])


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about BATCH_BYTES of text, over the bounds of the batches: the larger a slice, the fewer hashes are sent twice."""
    held, size = [], 0
    for batch in slices(batches, size=BATCH_BYTES):
        own = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if held and size + own > BATCH_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += own
    if held:
        yield pa.concat_batches(held)


def words_of(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, words, hash, c): the distinct words of docs (text, train), dealt by hash in its order, and their training counts."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merged(batches):
            b = Batch(batch)
            c, h = np.bincount(b.token[b.train[b.doc]], minlength=len(b.words)), hashes(b.words)
            shard = (h % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                yield pa.RecordBatch.from_arrays([pa.array([shard[own[0]]], pa.int32()), one(b.words.take(pa.array(own)).cast(pa.string())), pa.array([h[own].tobytes()]), pa.array([narrow(c[own])])], names=["shard", "words", "hash", "c"])

    def union(rows: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["hash"].to_pylist()])
        c = np.concatenate([wide(x) for x in rows["c"].to_pylist()])
        distinct, first, place = np.unique(h, return_index=True, return_inverse=True)
        held = rows["words"].combine_chunks().flatten().take(pa.array(first))
        return pa.Table.from_arrays([rows["shard"].slice(0, 1), one(held), one(pa.array(distinct.view(np.int64))), one(pa.array(np.bincount(place, weights=c, minlength=len(distinct)).astype(np.int64)))], names=["shard", "words", "hash", "c"])

    dealt = docs.mapInArrow(parts, "shard int, words array<string>, hash binary, c binary")
    return dealt.groupBy("shard").applyInArrow(union, "shard int, words array<string>, hash array<bigint>, c array<bigint>")


PAIRS = "shard int, row0 long, doc_ids binary, known_ids binary, train binary, v binary, vn binary, w binary, wi binary, c binary, n binary, doc binary"


def pairs_of(docs: DataFrame, shards: int, hot: Broadcast) -> DataFrame:
    """The word pairs of docs (doc_id, text, train), a row for each shard and slice of texts.

    v: distinct contexts in ascending order, vn: the pairs of each; w: distinct next words, wi: each pair's place among
    them; c: how often each pair occurs in training, n: anywhere; doc: the text of each occurrence; and, in one row of each
    slice, doc_ids, known_ids and train of its texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row0 = TaskContext.get().partitionId() << 40
        for batch in merged(batches):
            b = Batch(batch)
            h = hashes(b.words)
            # words in the order of their hashes, so that pairs sort by them
            rank = np.empty(len(h), np.int64)
            rank[np.argsort(h)] = np.arange(len(h))
            h = np.sort(h)
            key, order = ascending(rank[b.before] * len(h) + rank[b.token], len(h) ** 2)
            begin = np.flatnonzero(np.diff(key, prepend=-1))
            many = np.diff(np.append(begin, len(key)))
            v, w = (key[begin] // len(h)).astype(np.int32), (key[begin] % len(h)).astype(np.int32)
            del key
            often = np.zeros(len(h), bool)
            often[hot.value.among(h)[0]] = True
            often = often[v]
            shard = np.where(often, h[v] + h[w], h[v]) % np.uint64(shards)
            doc = b.doc[order]
            count = np.add.reduceat(b.train[doc].astype(np.int64), begin)
            ids = batch.column("doc_id")
            texts = [narrow(np.asarray(ids.fill_null(0)).view(np.uint64)), np.packbits(np.asarray(ids.is_valid())).tobytes(), np.packbits(b.train).tobytes()]
            # a stable order; whole numbers of two bytes are sorted by digits
            place = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
            for own in np.split(place, np.flatnonzero(np.diff(shard[place])) + 1):
                vs, vn = np.unique(v[own], return_counts=True)
                ws, wi = np.unique(w[own], return_inverse=True)
                row = [*texts, h[vs].tobytes(), narrow(vn), h[ws].tobytes(), narrow(wi), narrow(count[own]), narrow(many[own]), narrow(doc[ragged(begin[own], many[own])])]
                texts = [b"", b"", b""]
                yield pa.RecordBatch.from_arrays([pa.array([int(shard[own[0]])], pa.int32()), pa.array([row0]), *(pa.array([x], pa.binary()) for x in row)], names=[x.split()[0] for x in PAIRS.split(", ")])
            row0 += batch.num_rows

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "train").mapInArrow(run, PAIRS)


def numbered(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of all parts in ascending order, and the place among them of each hash of the parts, one part after another."""
    distinct_, place = np.unique(np.concatenate(parts), return_inverse=True)
    return distinct_, place


class Pairs:
    """The distinct pairs of one shard in ascending order: v and w, the distinct contexts and next words; key, a pair's place in v x len(w) + that in w; c, its training count; places, those of each row's pairs."""

    def __init__(self, rows: pa.Table):
        get = lambda k: [rows[k][i].as_buffer() for i in range(rows.num_rows)]
        self.v, house = numbered([np.frombuffer(x, np.uint64) for x in get("v")])
        self.w, word = numbered([np.frombuffer(x, np.uint64) for x in get("w")])
        house = np.repeat(house, np.concatenate([wide(x) for x in get("vn")]))
        dish, at, sizes = [], 0, []
        for w, wi in zip(get("w"), get("wi")):
            own = wide(wi)
            dish.append(word[at : at + len(w) // 8][own])
            at += len(w) // 8
            sizes.append(len(own))
        key = house * len(self.w) + np.concatenate(dish)
        del house, dish
        key, order = ascending(key, len(self.v) * len(self.w))
        fresh = np.diff(key, prepend=-1) > 0
        self.key = key[fresh]
        place = np.empty(len(key), np.int32)
        place[order] = np.cumsum(fresh) - 1
        del key, order
        self.c = np.bincount(place, weights=np.concatenate([wide(x) for x in get("c")]), minlength=len(self.key)).astype(np.int64)
        self.places = np.split(place, np.cumsum(sizes)[:-1])


class Contexts:
    """The word contexts of one shard and their restaurants: pairs by key and training count, next words by number, and of the frequent contexts which they are and their hashes."""

    def __init__(self, key: np.ndarray, c: np.ndarray, words_: int, frequent: np.ndarray, hashes_: np.ndarray, hot: Hot, shards: int):
        house, self.dish = np.divmod(key, words_)
        self.words, self.hot = words_, frequent
        held = np.bincount(house, weights=c)
        known = hot.among(hashes_)[1]
        held[frequent] = hot.customers[known]
        self.seats = Restaurants(house, c, held)
        # a context that is dealt over all shards has about as many tables in each of the others
        self.seats.scale[frequent] = shards
        tables = hot.tables[known]
        told, tables = frequent[tables > 0], tables[tables > 0]
        self.seats.outside[told], self.seats.scale[told] = np.maximum(0, tables - self.seats.tables()[told] / shards), 1

    def by_word(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.dish, weights=values, minlength=self.words)


def dealt(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The shards of words among those of all words, and the places of their words, in their order."""
    order = np.argsort(to, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
        yield int(to[own[0]]), own


STATE = "kind int, key long, n long, words array<string>, c array<bigint>, tables array<bigint>, shards array<int>, places array<binary>"


KEPT = "shard int, kind int, key long, n long, w binary, t binary, pairs binary, c binary, to binary, frequent binary, hashes binary, row0 long, doc_ids binary, known_ids binary, train binary, place binary, many binary, doc binary"
TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
KEPT_SCHEMA = pa.schema([(n, TYPES[t]) for n, t in (x.split() for x in KEPT.split(", "))])


def kept_pairs(docs: DataFrame, hot: Broadcast, shards: int, word_shards: int, seed: int) -> DataFrame:
    """Seat the word contexts once, and keep the pairs for the next time, so that texts are split into pairs once only.

    Rows by kind: 0, for a shard of words (key) those that the shard asks for and the tables that are their customers; 1,
    the tables (n) of a frequent context; 2, how many pairs (n) are seen once or twice; 3, the distinct pairs of the
    shard; 4, one for each slice of texts: its pairs' places among them, and their texts.
    """

    def seat(rows: pa.Table) -> pa.Table:
        shard = rows["shard"][0].as_py()
        here, rng = Pairs(rows), np.random.default_rng([seed, shard])
        frequent = hot.value.among(here.v)[0]
        contexts = Contexts(here.key, here.c, len(here.w), frequent, here.v[frequent], hot.value, shards)
        seats = contexts.seats
        # where nothing else is known, a word is as frequent as its contexts in this shard
        seen = contexts.by_word(seats.c > 0) + 0.5
        base = (seen / seen.sum())[contexts.dish]
        for _ in range(BURN_IN):
            seats.sweep(base, rng)
        tables, own_tables, to = contexts.by_word(seats.t).astype(np.int64), seats.own_tables(), (here.w % np.uint64(word_shards)).astype(np.int64)
        out = [{"kind": 0, "key": k, "w": here.w[own].tobytes(), "t": narrow(tables[own])} for k, own in dealt(to)]
        out += [{"kind": 1, "key": int(here.v[k].view(np.int64)), "n": int(own_tables[k])} for k in frequent.tolist()]
        out += [{"kind": 2, "key": k, "n": int((here.c == k).sum())} for k in (1, 2)]
        del seats, contexts, base
        out.append({"kind": 3, "pairs": narrow(np.diff(here.key, prepend=0)), "c": narrow(here.c), "to": narrow(to), "frequent": narrow(frequent), "hashes": here.v[frequent].tobytes()})
        for i, place in enumerate(here.places):
            texts = {k: rows[k][i].as_py() for k in ("row0", "doc_ids", "known_ids", "train", "doc")}
            # a row's pairs ascend
            out.append({"kind": 4, **texts, "many": rows["n"][i].as_py(), "place": narrow(np.diff(place, prepend=0))})
        return pa.Table.from_pylist([{"shard": shard, **x} for x in out], schema=KEPT_SCHEMA)

    return pairs_of(docs, shards, hot).groupBy("shard").applyInArrow(seat, KEPT)


FREE_SHUFFLE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bucketed(df: DataFrame, column: str, buckets: int, name: str) -> DataFrame:
    """Write df once as a Parquet table in the shared folder, in buckets of a column: what groups by it needs no further shuffle."""
    spark, table = df.sparkSession, f"spark_catalog.default.{name}_{uuid.uuid4().hex}"
    # the shuffle goes with the write, not when the driver next collects garbage
    usual = spark.conf.get(FREE_SHUFFLE, None)
    spark.conf.set(FREE_SHUFFLE, "true")
    try:
        df.write.format("parquet").bucketBy(buckets, column).option("compression", "zstd").option("path", scratch_path(spark, name)).saveAsTable(table)
    finally:
        spark.conf.unset(FREE_SHUFFLE) if usual is None else spark.conf.set(FREE_SHUFFLE, usual)
    held = spark.table(table)
    # only the name goes, the files stay
    spark.sql(f"DROP TABLE {table}")
    return held


def context_tables(kept: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows by kind: 0, a shard of words with the tables that are their customers and, for each shard of contexts, the places of the words that it asks for; 1, the tables of a frequent context; 2, pairs seen once or twice."""
    asked = kept.filter("kind < 3").select("kind", "key", "shard", "w", "t", "n")
    nothing = [F.lit(None).cast(k).alias(n) for n, k in (("shard", "int"), ("w", "binary"), ("t", "binary"), ("n", "long"))]
    held = vocabulary.select(F.lit(0).alias("kind"), F.col("shard").cast("long").alias("key"), *nothing, "words", "hash", "c")
    both = asked.select("*", *[F.lit(None).cast(k).alias(n) for n, k in (("words", "array<string>"), ("hash", "array<bigint>"), ("c", "array<bigint>"))]).unionByName(held)

    def add(rows: pa.Table) -> pa.Table:
        kind, key = rows["kind"][0].as_py(), rows["key"][0].as_py()
        names, lists = [x.split()[0] for x in STATE.split(", ")], [None] * 5
        if kind:
            return pa.Table.from_pylist([dict(zip(names, [kind, key, sum(rows["n"].to_pylist()), *lists]))], schema=STATE_SCHEMA)
        valid = np.asarray(rows["words"].combine_chunks().is_valid())
        mine = int(np.flatnonzero(valid)[0])
        h = rows["hash"][mine].values.to_numpy().view(np.uint64)
        tables, shards_, places = np.zeros(len(h), np.int64), [], []
        for i in np.flatnonzero(~valid).tolist():
            at = np.searchsorted(h, np.frombuffer(rows["w"][i].as_py(), np.uint64))
            tables[at] += wide(rows["t"][i].as_py())
            shards_.append(rows["shard"][i].as_py())
            places.append(narrow(at))
        return pa.Table.from_arrays(
            [pa.array([0], pa.int32()), pa.array([key]), pa.array([0]), one(rows["words"][mine].values), one(rows["c"][mine].values), one(pa.array(tables)), pa.array([shards_], pa.list_(pa.int32())), pa.array([places], pa.list_(pa.binary()))],
            schema=STATE_SCHEMA,
        )

    return both.groupBy("kind", "key").applyInArrow(add, STATE)


STATE_SCHEMA = pa.schema([
    ("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("words", pa.list_(pa.string())), ("c", pa.list_(pa.int64())), ("tables", pa.list_(pa.int64())), ("shards", pa.list_(pa.int32())), ("places", pa.list_(pa.binary())),
])


# Spelling: letters of words as events, each a letter x in a context of the letters c1, c2, c3, c4 before it, the nearest first.


def events_of(spelled: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every letter of the words and the stop after each: x, c1 and c2 as one number, c3 and c4 as another; and the number of events of each word."""
    sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
    letters = np.frombuffer("".join(spelled).encode("utf-32-le", "surrogatepass"), np.uint32)
    pad = ORDER + 1
    full = np.full(len(letters) + pad * len(sizes), START, np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    full[np.arange(len(letters)) + pad * owner + ORDER] = letters
    stops = np.cumsum(sizes + pad) - 1
    full[stops] = STOP
    at = ragged(stops - sizes, sizes + 1)
    return (full[at - 2] * LETTER + full[at - 1]) * LETTER + full[at], full[at - 4] * LETTER + full[at - 3], sizes + 1


def letter_events(state: DataFrame, weights: str) -> DataFrame:
    """(key, near, far, n): the distinct events of each shard of words; n adds up the words' `weights`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                near, far, sizes = events_of(batch.column("words")[i].values.to_pylist())
                first, place = distinct(near, far)
                near, far = near[first], far[first]
                n = np.bincount(place, weights=np.repeat(batch.column("weight")[i].values.to_numpy(), sizes), minlength=len(near)).astype(np.int64)
                for a in range(0, len(near), 100_000):
                    cutout = slice(a, a + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near[cutout]), batch.column("key")[i].as_py())), *(pa.array(x[cutout]) for x in (near, far, n))], names=["key", "near", "far", "n"])

    return state.select("key", "words", F.col(weights).alias("weight")).mapInArrow(run, "key long, near long, far long, n long")


MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each pair (a, b), hardly ever the same for two."""
    x = (a.view(np.uint64) + MIX) * MIX
    x ^= x >> np.uint64(29)
    return x * MIX + b.view(np.uint64)


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct pair (a, b) stands, in an order that depends on the pairs alone, and the place of every pair among them."""
    key = mixed(a, b)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    x, y = order[1:][same], order[:-1][same]
    if (a[x] != a[y]).any() or (b[x] != b[y]).any():
        # two pairs with one number: sort by the pairs themselves
        order = np.lexsort((b, a))
        same = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
    fresh = np.append(True, ~same) if len(a) else np.zeros(0, bool)
    place = np.empty(len(a), np.int32 if len(a) < 1 << 31 else np.int64)
    place[order] = np.cumsum(fresh) - 1
    return order[fresh], place


class Spelling:
    """Restaurants of contexts of 4, 3 and 2 letters, the deepest first; a pair of one level is a customer of that it leads to in the next."""

    def __init__(self, near: np.ndarray, far: np.ndarray):
        self.levels, self.up = [], []
        for letters in (4, 3, 2):
            # what tells contexts of so many letters apart, beside the last two
            more = far if letters == 4 else far % LETTER if letters == 3 else np.zeros(len(far), np.int64)
            first, place = distinct(near, more)
            self.up.append(place)
            self.levels.append(Restaurants(distinct(near[first] // LETTER, more[first])[1], np.zeros(len(first), np.int64)))
            near, far = near[first], far[first]
        self.top = near

    def predictive(self, base: np.ndarray) -> list[np.ndarray]:
        out, p = [], base
        for k in (2, 1, 0):
            p = self.levels[k].predictive(p)
            out.append(p)
            p = p[self.up[k]]
        return out[::-1] + [p]

    def sweep(self, n: np.ndarray, base: np.ndarray, rng: np.random.Generator) -> None:
        p = self.predictive(base)
        sent = n
        for k, level in enumerate(self.levels):
            level.customers(np.bincount(self.up[k], weights=sent, minlength=len(level.c)).astype(np.int64))
            level.sweep(p[k + 1][self.up[k + 1]] if k < 2 else base, rng)
            sent = level.t
        self.sent = sent


def spelling(state: DataFrame, weights: str, groups: int, samples: int, seed: int) -> DataFrame:
    """(key, near, far, p): the probability of each event of each shard of words, given the customers of the spelling."""
    asked = cut(letter_events(state, weights), "lm-letters")
    events = cut(asked.groupBy("near", "far").agg(F.sum("n").alias("n")), "lm-events")
    # contexts of two letters or more by the last two, those of one letter by that
    two, single = F.pmod(F.xxhash64(F.floor(F.col("near") / int(LETTER))), F.lit(1 << 20)), "near % 4398046511104"

    def deep(draw: int) -> callable:
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["near", "far"], ignore_index=True)
            tree = Spelling(rows["near"].to_numpy(), rows["far"].to_numpy())
            base = np.ones(len(tree.top)) / 64 if not draw else rows.groupby("near", sort=True)["p1"].first().reindex(tree.top).to_numpy()
            rng, n, total = np.random.default_rng([seed, draw, int(rows["two"].iloc[0])]), rows["n"].to_numpy(), np.zeros(len(rows))
            for k in range(BURN_IN + draw):
                tree.sweep(n, base, rng)
                if k >= BURN_IN:
                    total += tree.predictive(base)[3]
            if not draw:
                return pd.DataFrame({"near": tree.top, "far": 0, "n": tree.sent, "p": 0.0})
            return pd.DataFrame({"near": rows["near"], "far": rows["far"], "n": 0, "p": total / draw})

        return run

    schema = "near long, far long, n long, p double"
    sent = events.withColumn("two", two % groups).groupBy("two").applyInPandas(deep(0), schema).groupBy(F.expr(single).alias("pair")).agg(F.sum("n").alias("n"))
    sent = cut(sent, "lm-letter-pairs")

    def shallow(letters: dict[int, float] | None) -> callable:
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("pair", ignore_index=True)
            pair = rows["pair"].to_numpy()
            house, x = np.unique(pair // LETTER, return_inverse=True)[1], pair % LETTER
            seats, rng, total = Restaurants(house, rows["n"].to_numpy()), np.random.default_rng([seed, 1 + bool(letters), int(rows["last"].iloc[0])]), np.zeros(len(rows))
            base = np.array([(letters or {}).get(int(v), 1 / CODE_POINTS) for v in x])
            for k in range(BURN_IN + samples):
                seats.sweep(base, rng)
                if k >= BURN_IN:
                    total += seats.predictive(base)
            return pd.DataFrame({"pair": pair, "x": x, "n": seats.t, "p": total / samples})

        return run

    dealt = sent.withColumn("last", F.pmod(F.xxhash64(F.floor(F.col("pair") / int(LETTER))), F.lit(groups)).cast("int"))
    level = "pair long, x long, n long, p double"
    below = dealt.groupBy("last").applyInPandas(shallow(None), level).groupBy("x").agg(F.sum("n").alias("n")).collect()  # a row for each letter
    below = sorted((r.x, int(r.n)) for r in below)
    root = Restaurants(np.zeros(len(below), np.int64), np.array([n for _, n in below], np.int64))
    base, rng = np.full(len(below), 1 / CODE_POINTS), np.random.default_rng([seed, 3])
    for _ in range(BURN_IN + samples):
        root.sweep(base, rng)
    letters = {x: float(p) for (x, _), p in zip(below, root.predictive(base))}
    p1 = dealt.groupBy("last").applyInPandas(shallow(letters or None), level).select("pair", F.col("p").alias("p1"))
    based = events.withColumn("pair", F.expr(single)).join(p1, "pair").withColumn("two", two % groups)
    found = based.select("two", "near", "far", "n", "p1").groupBy("two").applyInPandas(deep(samples), schema).select("near", "far", "p")
    return asked.select("key", "near", "far").join(found, ["near", "far"]).select("key", "near", "far", "p")


def seat_words(state: DataFrame, spelled: DataFrame, known: int, discount: float, samples: int, seed: int) -> DataFrame:
    """(key, spell, t, drawn): for each word of a shard log10 of its spelling, its tables in the last sweep, and those of every sample one after another."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        near, far, sizes = events_of(left["words"][0].values.to_pylist())
        place = distinct(near, far)[1]
        got = distinct(right["near"].to_numpy(), right["far"].to_numpy())[0]
        p = np.log10(right["p"].to_numpy()[got])
        spell = np.add.reduceat(p[place], np.cumsum(sizes) - sizes)
        c = left["tables"][0].values.to_numpy()
        base = 10.0 ** np.maximum(spell, -300)
        seats, rng = Restaurants(np.zeros(len(c), np.int64), c, discount=discount), np.random.default_rng([seed, left["key"][0].as_py()])
        # words of other shards have as many tables each as those of this one
        seats.scale[:] = max(1.0, known / max(1, int((c > 0).sum())))
        drawn = []
        for k in range(BURN_IN + samples):
            seats.sweep(base, rng)
            if k >= BURN_IN:
                drawn.append(seats.t)
        return pa.Table.from_arrays([left["key"], one(pa.array(spell)), one(pa.array(seats.t)), one(pa.array(np.concatenate(drawn)))], names=["key", "spell", "t", "drawn"])

    return state.select("key", "words", "tables").groupBy("key").cogroup(spelled.groupBy("key")).applyInArrow(run, "key long, spell array<double>, t array<bigint>, drawn array<bigint>")


def answers(state: DataFrame, seated: DataFrame, tables: list[int], total: int, discount: float) -> DataFrame:
    """(shard, key, c, p): for every shard of contexts and of words, the counts and probabilities of the words that the former asked for, in the order of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c, customers, spell = (batch.column(n)[i].values.to_numpy() for n in ("c", "tables", "spell"))
                t = batch.column("drawn")[i].values.to_numpy().reshape(len(tables), -1)
                base = 10.0 ** np.maximum(spell, -300)
                p = sum(customers - discount * own + (STRENGTH + discount * all_) * base for own, all_ in zip(t, tables)) / len(tables) / (STRENGTH + total)
                for shard, at in zip(batch.column("shards")[i].as_py(), batch.column("places")[i].as_py()):
                    at = wide(at)
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([batch.column("key")[i].as_py()]), pa.array([narrow(c[at])]), pa.array([p[at].tobytes()])], names=["shard", "key", "c", "p"])

    both = state.select("key", "c", "tables", "shards", "places").join(seated.select("key", "spell", "drawn"), "key")
    return both.mapInArrow(run, "shard int, key long, c binary, p binary")


SUMS = "row0 long, shard int, doc_ids binary, known_ids binary, train binary, texts binary, n binary, known binary, base binary, score binary, unknown binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, base_known double, score_known double"


def text_sums(kept: DataFrame, answered: DataFrame, hot: Broadcast, shards: int, n: int, v: int, discount: float, samples: int, seed: int) -> DataFrame:
    """Seat the word contexts given the words, and add up what each shard knows of the texts of a slice: a row for each shard and slice. `unknown` is the score of unknown words, of the texts that have some only."""

    def run(rows: pa.Table, words_: pa.Table) -> pa.Table:
        shard, kinds = rows["shard"][0].as_py(), rows["kind"].to_pylist()
        mine, rng = kinds.index(3), np.random.default_rng([seed, shard])
        get = lambda k: rows[k][mine].as_buffer()
        to = wide(get("to"))
        here = Contexts(np.cumsum(wide(get("pairs"))), wide(get("c")), len(to), wide(get("frequent")), np.frombuffer(get("hashes"), np.uint64), hot.value, shards)
        seats = here.seats
        seats.discount = discount
        known, p, places = np.zeros(len(to), np.int64), np.zeros(len(to)), dict(dealt(to))
        for k in range(words_.num_rows):
            own = places[words_["key"][k].as_py()]
            known[own], p[own] = wide(words_["c"][k].as_buffer()), np.frombuffer(words_["p"][k].as_buffer())
        base, total = p[here.dish], np.zeros(len(here.dish))
        for k in range(BURN_IN + samples):
            seats.sweep(base, rng)
            if k >= BURN_IN:
                total += seats.predictive(base)
        lp, add_one, seen = np.log10(total / samples), np.log10((known + 1) / (n + v + 1))[here.dish], (known > 0)[here.dish]
        del total, base, p, seats, here
        out = []
        for i in (i for i, kind in enumerate(kinds) if kind == 4):
            place, many, doc = np.cumsum(wide(rows["place"][i].as_buffer())), wide(rows["many"][i].as_buffer()), wide(rows["doc"][i].as_buffer())
            size = np.bincount(doc)
            texts = np.flatnonzero(size)
            sums = lambda x: np.bincount(doc, weights=np.repeat(x[place], many))[texts]  # noqa: B023, E731
            missed = np.flatnonzero(~seen[place])
            body = {"texts": narrow(texts), "n": narrow(size[texts]), "base": sums(add_one).tobytes(), "score": sums(lp).tobytes()}
            # unknown words are rare: their occurrences by themselves
            first = np.cumsum(many) - many
            lost = doc[ragged(first[missed], many[missed])]
            without = np.bincount(lost, minlength=len(size))
            some = np.flatnonzero(without)
            cost = np.bincount(lost, weights=np.repeat(lp[place[missed]], many[missed]), minlength=len(size))
            body |= {"known": narrow(size[texts] - without[texts]), "unknown": cost[some].tobytes()}
            out.append({"row0": rows["row0"][i].as_py(), "shard": shard, **{k: rows[k][i].as_py() for k in ("doc_ids", "known_ids", "train")}, **body})
        return pa.Table.from_pylist(out, schema=SUMS_SCHEMA)

    return kept.groupBy("shard").cogroup(answered.groupBy("shard")).applyInArrow(run, SUMS)


SUMS_SCHEMA = pa.schema([(n, TYPES[t]) for n, t in (x.split() for x in SUMS.split(", "))])


def text_scores(sums: DataFrame, n: int, v: int) -> DataFrame:
    """The scores of all texts: what the shards know of the texts of a slice, added up in the order of the shards."""

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("shard")
        mine = next(i for i in range(rows.num_rows) if len(rows["doc_ids"][i].as_buffer()))
        ids = wide(rows["doc_ids"][mine].as_buffer())
        bits = lambda x: np.unpackbits(np.frombuffer(rows[x][mine].as_buffer(), np.uint8), count=len(ids)).astype(bool)
        whole, real = np.zeros((2, len(ids)), np.int64), np.zeros((3, len(ids)))
        for i in range(rows.num_rows):
            texts = wide(rows["texts"][i].as_buffer())
            own = [wide(rows[name][i].as_buffer()) for name in ("n", "known")]
            whole[0, texts] += own[0]
            whole[1, texts] += own[1]
            for k, (name, which) in enumerate((("base", texts), ("score", texts), ("unknown", texts[own[0] > own[1]]))):
                real[k, which] += np.frombuffer(rows[name][i].as_buffer())
        unknown = (whole[0] - whole[1]) * np.log10(1 / (n + v + 1))
        columns = [pa.array(ids, mask=~bits("known_ids")), pa.array(~bits("train")), *map(pa.array, whole), pa.array(real[0]), pa.array(real[1]), pa.array(real[0] - unknown), pa.array(real[1] - real[2])]
        return pa.table(columns, names=[x.split()[0] for x in SCORED.split(", ")])

    return sums.groupBy("row0").applyInArrow(add, SCORED)


def usual_discount(once: int, twice: int) -> float:
    """The usual estimate from what is seen once and twice."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once and twice else DISCOUNT


def score(docs: DataFrame, train: Column, samples: int = SAMPLES, rounds: int = ROUNDS, seed: int = 11, shards: int | None = None) -> DataFrame:
    """Learn from the rows of docs (doc_id, text) where `train` holds, and score all."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text", train.alias("train"))
    if shards is None:
        # about six bytes a token
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(LEAST_SHARDS, -(-size // (6 * SHARD_TOKENS)))
    word_shards = max(min(shards, LEAST_SHARDS), -(-shards // CONTEXTS_A_WORD))
    vocabulary = cut(words_of(docs.select("text", "train"), word_shards), "lm-words")
    each = vocabulary.select(F.explode(F.arrays_zip("hash", "c")).alias("w")).select("w.hash", "w.c")
    n, v = each.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    n, v = int(n or 0), int(v)
    # fewer than 4 x shards
    frequent = {r["hash"] % (1 << 64): r.c for r in each.filter(F.col("c") > max(1000, n // (4 * shards))).collect()}
    share = docs.sparkSession.sparkContext.broadcast
    kept = kept_pairs(docs, share(Hot({k: (c, 0) for k, c in frequent.items()})), shards, word_shards, seed)
    kept = bucketed(kept, "shard", max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "lm_pairs")
    state = cut(context_tables(kept, vocabulary), "lm-state")
    pair_counts = {r.key: r.n for r in state.filter("kind = 2").collect()}
    hot = share(Hot({r.key % (1 << 64): (frequent[r.key % (1 << 64)], r.n) for r in state.filter("kind = 1").select("key", "n").collect()}))
    state = state.filter("kind = 0")
    tables = state.select(F.explode("tables").alias("t")).agg(F.sum("t"), *[F.count_if(x) for x in (F.col("t") == 1, F.col("t") == 2, F.col("t") > 0)]).first()
    total, known = int(tables[0] or 0), int(tables[3])
    discount = usual_discount(tables[1], tables[2])
    now = state.withColumn("weight", F.transform("tables", lambda t: F.least(t, F.lit(1))))
    for k in range(rounds):
        spelled = spelling(now, "weight", SPELLING_GROUPS * max(LEAST_SHARDS, word_shards), samples, seed + 10 * k)
        seated = cut(seat_words(state, spelled, known, discount, samples, seed + 10 * k + 5), "lm-seated")
        now = state.select("key", "words").join(seated.select("key", F.col("t").alias("weight")), "key")
    per = seated.select(*[F.aggregate(F.slice("drawn", F.size("t") * s + 1, F.size("t")), F.lit(0).cast("long"), lambda a, b: a + b).alias(f"t{s}") for s in range(samples)])
    drawn = [int(x or 0) for x in per.agg(*[F.sum(c) for c in per.columns]).first()]
    answered = answers(state, seated, drawn, total, discount)
    kept = kept.filter("kind >= 3").drop("key", "n", "w", "t")
    sums = text_sums(kept, answered, hot, shards, n, v, usual_discount(pair_counts.get(1, 0), pair_counts.get(2, 0)), samples, seed + 1)
    return text_scores(sums, n, v).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "base_known", "score_known")


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity of the held-out and of the training texts, over all tokens and over the known ones, of the model and of the base score."""
    of = lambda total, count: F.pow(F.lit(10.0), -F.sum(total) / F.sum(count))
    return scored.groupBy("held_out").agg(
        of("score", "n_tokens").alias("perplexity"), of("base_score", "n_tokens").alias("base_perplexity"), of("score_known", "n_known").alias("known_perplexity"), of("base_known", "n_known").alias("known_base_perplexity")
    )
