"""Language identification by nearest centroid.

A text is a vector of hashed n-grams of 2 to 4 bytes of its lower-cased letters, with log term frequency, inverse
document frequency over all training rows, and unit length. Each language has a few centroids, found by spherical
k-means on a bounded sample of its training rows (`sample_per_language`, a fit parameter); the nearest centroid by
cosine names the language. A text is rejected if it is farther from that centroid than the language's training texts of
its length allow: its cosine is below `slack` times the `tail` quantile of theirs. Cosines rise with the number of distinct
n-grams, which is the length here: one word said a thousand times is a short text. Bounds are found for each doubling of
that number and interpolated. Each training row counts whole and as one prefix of it, so short lengths have bounds too.

Document frequencies and the distributions of cosines come from all training rows, as one count for each n-gram slot, or
each language, length and bin of cosines, and task. k-means runs in one task for each language, on that language's bounded
sample. Only centroids (languages x clusters x slots) and those counts reach the driver.

Nulls and edges: a text that is null or has no letter is `und` with score 0 and rejected; rows with a null language
teach nothing; a null doc_id is kept, and such rows teach; with nothing to learn from, all rows are `und`; repeated
rows are each answered; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odolith.llm.text import byte_view, slices
from odolith.session import ship

SLOTS = 1 << 12
#: All ASCII bytes but letters become spaces.
LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
SIZES = (2, 3, 4)
CLUSTERS, SAMPLE_PER_LANGUAGE, TAIL, SLACK = 4, 400, 0.01, 0.9
UNKNOWN = "und"
BATCH, BANDS, BINS = 256, SLOTS.bit_length(), 1000


def counts_of(texts: pa.Array, slots: int = SLOTS) -> np.ndarray:
    """For each text, how many of its n-grams fall in each slot."""
    lowered = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    data, at = byte_view(lowered)
    n = len(at) - 1
    body = np.frombuffer(bytes(data[at[0] : at[-1]]).translate(LETTERS), np.uint8) if n else np.zeros(0, np.uint8)
    sizes = np.diff(at)
    # blanks after each text, so that no n-gram joins two texts
    pad = max(SIZES)
    full = np.full(len(body) + pad * n, 32, np.uint8)
    owner = np.repeat(np.arange(n), sizes)
    full[np.arange(len(body)) + pad * owner] = body
    whose = np.repeat(np.arange(n), sizes + pad)
    out = np.zeros(n * slots, np.float64)
    if len(full) > pad:
        wide = full.astype(np.uint32)
        for size in SIZES:
            m = len(wide) - size + 1
            code = np.full(m, size, np.uint32)
            for k in range(size):
                code = code * np.uint32(257) + wide[k : k + m]
            code *= np.uint32(2654435761)
            key = whose[:m] * slots + (code >> np.uint32(16)) % np.uint32(slots)
            # a run of blanks says nothing
            out += np.bincount(key[(wide[:m] != 32) | (wide[1 : m + 1] != 32)], minlength=n * slots)[: n * slots]
    return out.reshape(n, slots)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def lengths(counts: np.ndarray) -> np.ndarray:
    """Logarithm to base 2 of the number of distinct n-grams; its whole part is the band."""
    return np.log2(np.maximum((counts > 0).sum(axis=1), 1))


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    least: np.ndarray  # for each centroid and band

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the distance is too great."""
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        counts = counts_of(texts)
        near = vectors(counts, self.idf) @ self.centroids.T
        best = near.argmax(axis=1)
        score = np.where(letters, np.clip(near[np.arange(len(near)), best], 0, 1), 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)], score, ~letters | (score < self.bound(best, lengths(counts)))

    def bound(self, best: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The least cosine allowed: that of a band in its middle, between the bands of two middles elsewhere."""
        at = np.clip(length - 0.5, 0, BANDS - 1)
        low = np.minimum(at.astype(int), BANDS - 2)
        return self.least[best, low] * (1 - (at - low)) + self.least[best, low + 1] * (at - low)


def document_frequency(texts: DataFrame) -> tuple[np.ndarray, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(SLOTS + 1, np.int64), 0
        for batch in small(batches):
            df[:SLOTS] += (counts_of(batch.column("text")) > 0).sum(axis=0)
            n += batch.num_rows
        df[SLOTS] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLOTS + 1)), pa.array(df)], names=["slot", "df"])

    total = texts.select("text").mapInArrow(run, "slot long, df long").groupBy("slot").agg(F.sum("df").alias("df"))
    df = np.zeros(SLOTS + 1, np.int64)
    for r in total.collect():
        df[r.slot] = r.df
    return df[:SLOTS], int(df[SLOTS])


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        for i in range(0, batch.num_rows, BATCH):
            yield batch.slice(i, BATCH)


def cluster(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Spherical k-means; each start is the row farthest from those before it, the first that nearest the mean."""
    mean = x.mean(axis=0)
    chosen = [int((x @ mean).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    c = x[chosen]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(labelled: DataFrame, clusters: int = CLUSTERS, sample_per_language: int = SAMPLE_PER_LANGUAGE, tail: float = TAIL, slack: float = SLACK) -> Model:
    """Learn from labelled rows (doc_id, text, lang)."""
    ship(labelled.sparkSession)
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    df, n = document_frequency(labelled)
    idf = np.log((1 + n) / (1 + df)) + 1e-3
    # about sample_per_language rows of each language, by a hash of the row
    size = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not size:
        return Model(idf, [], np.zeros((0, SLOTS)), np.zeros((0, BANDS)))
    share = F.create_map(*[F.lit(v) for lang, m in size.items() for v in (lang, min(1.0, sample_per_language / m))])
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.filter(chance < share[F.col("lang")])

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            v = vectors(counts_of(batch.column("text")), idf).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([x.tobytes() for x in v])], names=["lang", "v"])

    def centre(rows: pd.DataFrame) -> pd.DataFrame:
        # in an order that does not depend on arrival
        x = np.stack([np.frombuffer(v, np.float32) for v in sorted(rows["v"])]).astype(np.float64)
        c = cluster(x, clusters)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "c": [v.tobytes() for v in c]})

    found = sample.select("lang", "text").mapInArrow(embed, "lang string, v binary").groupBy("lang").applyInPandas(centre, "lang string, c binary").collect()
    found.sort(key=lambda r: (r.lang, bytes(r.c)))
    languages, centroids = [r.lang for r in found], np.stack([np.frombuffer(r.c, np.float64) for r in found]) if found else np.zeros((0, SLOTS))
    least = bounds(labelled, idf, languages, centroids, tail, slack)
    return Model(idf, languages, centroids, np.array([least[lang] for lang in languages]).reshape(-1, BANDS))


def prefixes(texts: pa.Array) -> pa.Array:
    """A prefix of each text that is longer; its length, a power of two, depends on the text."""
    cuts = ((t, 2 << zlib.crc32(t.encode()) % 11) for t in texts.to_pylist())
    return pa.array([t[:n] if len(t) > n else None for t, n in cuts], pa.large_string())


def bounds(labelled: DataFrame, idf: np.ndarray, languages: list[str], centroids: np.ndarray, tail: float, slack: float) -> dict[str, np.ndarray]:
    """For each language and band: `slack` times the `tail` quantile of the cosines of all its training rows."""
    names = sorted(set(languages))
    owner, place = np.array([names.index(x) for x in languages]), pa.array(names, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(names) * BANDS * BINS, np.int64)
        for batch in small(batches):
            lang = pc.fill_null(pc.index_in(batch.column("lang").cast(pa.string()), place), -1).to_numpy(zero_copy_only=False)
            whole = batch.column("text").cast(pa.large_string())
            for texts in (whole, prefixes(whole)):
                own = (lang >= 0) & pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
                if own.any():
                    counts, of = counts_of(texts.filter(pa.array(own))), lang[own]
                    near = np.where(owner == of[:, None], vectors(counts, idf) @ centroids.T, 0).max(axis=1)
                    key = (of * BANDS + lengths(counts).astype(int)) * BINS + np.clip(near * BINS, 0, BINS - 1).astype(int)
                    seen += np.bincount(key, minlength=len(seen))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["key", "n"])

    seen = np.zeros((len(names), BANDS, BINS), np.int64)
    for r in labelled.select("text", "lang").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():
        seen.reshape(-1)[r.key] = r.n
    return {lang: slack * tails(h, tail) for lang, h in zip(names, seen)}


def tails(seen: np.ndarray, tail: float) -> np.ndarray:
    """The `tail` quantile of each band's histogram. A band with too few rows for one has their least, or the bound of the band below if that is less."""
    out, n = np.zeros(len(seen)), seen.sum(axis=1)
    some = np.flatnonzero(n)
    for b in some.tolist():
        out[b] = (seen[b].cumsum() >= max(1, tail * n[b])).argmax() / BINS
    for b in range(len(seen)):
        if not n[b]:
            # nothing so short was seen: cosines fall with the root of the length; nothing so long: as the band below
            out[b] = out[some[0]] * 2 ** ((b - some[0]) / 2) if len(some) and b < some[0] else out[b - 1] if b else 0
        elif n[b] * tail < 1 and b > some[0]:
            out[b] = min(out[b], out[b - 1])
    return out


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (doc_id if None) with lang_pred, score and rejected."""
    ship(docs.sparkSession)
    keep = keep or ["doc_id"]
    columns = docs.select(*keep, *([] if "text" in keep else ["text"]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema if f.name in keep), "lang_pred string, score double, rejected boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            lang, score, rejected = model.predict(batch.column("text").cast(pa.large_string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=[*keep, "lang_pred", "score", "rejected"])

    return columns.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text leaves no remainder by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
