"""Alignment of two tokenizers: where tokens of both end together, which tokens that ties, and how often corpus-wide.

A is a byte-level file of the tokenizers library, which encodes a space and the text; B is a sentencepiece model, which
adds that space itself. Coarse ends of tokens come from A's character offsets and from the spans of B's encoding; where
tokens lie inside one character, or are bytes of one, the lengths of their decoded bytes set the ends. Offsets where
tokens of both end cut the text into groups; the pair of tokens that end there is a link.

A text is cut at single spaces before a word, where neither tokenizer joins anything: A's own pre-tokenisation cuts
there and no piece of B holds a space after another character (checked when the model is loaded). Each distinct word is
aligned once for as long as a worker remembers it. Texts with other white space around spaces are aligned whole.

Scale: one pass encodes and writes, for each text, its counts and its distinct links with how often each comes; links
are summed corpus-wide in the map tasks first. Tokens that end together cover the same bytes there, so one is a suffix
of the other: the number of different links is at most that of suffixes of all vocabulary entries, some 900,000 for
these two, whatever the corpus. That table is what is broadcast.

Nulls and edges: a null or empty text, and one whose tokens do not spell it (such as one with U+2581, which B reads as a
space), has no tokens, zero counts and an empty digest; a null doc_id and repeated rows are kept; very long texts are
taken whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odolith.llm.encoding import ODD_SPACE, grown
from odolith.llm.text import ragged, slices
from odolith.session import cut, ship

#: Words that a worker remembers before it starts anew (some 300 bytes each); bounds memory, never changes results.
CACHE_WORDS = 300_000
#: A text that matches is aligned whole.
WHOLE = rf"^[\pZ\x09-\x0d\x1c-\x1f\x{{85}}]|{ODD_SPACE}"
SPACE_MARK = "▁"
#: Words that the libraries are given in one text, and such texts at a time; words that end in white space or hold a mark of B's go alone.
JOINED, UNITS = 128, 64
ALONE = re.compile(rf"[\s\x1c-\x1f]\Z|\A\Z|^[\s\x1c-\x1f]|{SPACE_MARK}")
ALIGNED = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links array<bigint>, times array<int>"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ends:
    """Tokens of several texts one after another: ids, the end of each in bytes of its own text, tokens of each text, and the bytes they spell."""

    def __init__(self, ids: np.ndarray, coarse_from: np.ndarray, coarse_to: np.ndarray, counts: np.ndarray, entries: list[bytes]):
        """coarse_from, coarse_to: byte offsets that the library gives."""
        self.ids, self.counts, self.spelled = ids, counts, [entries[i] for i in ids.tolist()]
        lengths = np.fromiter(map(len, self.spelled), np.int64, len(ids))
        first = np.repeat(np.cumsum(counts) - counts, counts)
        place = np.arange(len(ids))
        # sure: the coarse span is as long as the token and begins where the one before ends
        before = np.where(place > first, np.append(0, coarse_to[:-1]) if len(ids) else coarse_to, 0)
        sure = (coarse_to - coarse_from == lengths) & (coarse_from == before)
        spent = np.cumsum(lengths)
        own = spent - np.append(0, spent)[first] if len(ids) else spent
        # elsewhere decoded bytes are counted on from the start of the text
        self.ends = np.where(sure, coarse_to, own)

    def texts(self) -> list[bytes]:
        at = np.append(0, np.cumsum(self.counts)).tolist()
        return [b"".join(self.spelled[a:b]) for a, b in zip(at, at[1:])]


class Aligner:
    def __init__(self, path_a: str, path_b: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b, self.cache_words = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b), cache_words
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.names = [str(i) for i in range(max(len(names), len(pieces)))]
        pre = json.loads(self.a.to_str()).get("pre_tokenizer") or {}
        plain_a = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.by_word = plain_a and not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        self.forget()

    def forget(self) -> None:
        """Known words and, by their slot, the text of the groups and counts; links of slot i are pairs[at[i] : at[i + 1]]."""
        self.slot_of: dict[str, int] = {}
        self.groups: list[str] = []
        self.at, self.pairs, self.counts = np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.int64), np.zeros((1 << 12, 3), np.int64)

    def ends_a(self, texts: list[str]) -> Ends:
        got = self.a.encode_batch([f" {t}" for t in texts], add_special_tokens=False)
        counts = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter((i for e in got for i in e.ids), np.int64, int(counts.sum()))
        chars = np.fromiter((x for e in got for o in e.offsets for x in o), np.int64, 2 * len(ids)).reshape(-1, 2)
        # from characters to bytes: a byte that does not continue a character begins one
        body = [f" {t}".encode() for t in texts]
        data = np.frombuffer(b"".join(body), np.uint8)
        begins = np.flatnonzero((data & 0xC0) != 0x80)
        sizes, lengths = np.array([len(t) + 1 for t in texts], np.int64), np.array(list(map(len, body)), np.int64)
        base_char, base = np.repeat(np.cumsum(sizes) - sizes, counts), np.repeat(np.cumsum(lengths) - lengths, counts)
        begins = np.append(begins, len(data))
        return Ends(ids, begins[base_char + chars[:, 0]] - base, begins[base_char + chars[:, 1]] - base, counts, self.bytes_a)

    def ends_b(self, texts: list[str]) -> Ends:
        found = [self.b.encode(t, return_type="proto").pieces for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((x for pieces in found for p in pieces for x in (p.id, p.begin, p.end)), np.int64, 3 * int(counts.sum())).reshape(-1, 3)
        # spans are bytes of the text alone, without the space before it
        return Ends(flat[:, 0], np.where(flat[:, 1] == 0, 0, flat[:, 1] + 1), flat[:, 2] + 1, counts, self.bytes_b)

    def add(self, words: list[str]) -> np.ndarray:
        """Slots of words or whole texts, aligned now. Words go through the libraries JOINED at a time, with a space between; those that a neighbour could change, one at a time."""
        alone = [bool(ALONE.search(w)) for w in words]
        joined = [i for i, x in enumerate(alone) if not x]
        units = [joined[k : k + JOINED] for k in range(0, len(joined), JOINED)] + [[i] for i, x in enumerate(alone) if x]
        slots = np.empty(len(words), np.int64)
        for k in range(0, len(units), UNITS):
            part = units[k : k + UNITS]
            slots[np.array([i for u in part for i in u], np.int64)] = self.put([[words[i] for i in u] for u in part])
        return slots

    def put(self, units: list[list[str]]) -> np.ndarray:
        """Slots of the words of some units, in order; a unit is a text of words with spaces between."""
        texts, first = [" ".join(u) for u in units], len(self.groups)
        a, b = self.ends_a(texts), self.ends_b(texts)
        good = np.array([f" {t}".encode() == x == y for t, x, y in zip(texts, a.texts(), b.texts())], bool)
        lengths = np.fromiter((len(w.encode()) + 1 for u in units for w in u), np.int64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        ends, n = np.cumsum(lengths), len(lengths)
        to = np.append(0, ends)[np.append(0, np.cumsum(sizes))]
        sides = []
        for side in (a, b):
            keep = np.repeat(good, side.counts)
            at = (side.ends + np.repeat(to[:-1], side.counts))[keep]
            sides.append((at, side.ids[keep], np.bincount(np.searchsorted(ends, at), minlength=n)))
        (at_a, ids_a, count_a), (at_b, ids_b, count_b) = sides
        both, i, j = np.intersect1d(at_a, at_b, assume_unique=True, return_indices=True)
        pairs, links = ids_a[i] << 16 | ids_b[j], np.bincount(np.searchsorted(ends, both), minlength=n)
        names_a, names_b = list(map(self.names.__getitem__, ids_a.tolist())), list(map(self.names.__getitem__, ids_b.tolist()))
        ends_a, ends_b = [0, *(i + 1).tolist()], [0, *(j + 1).tolist()]
        said = [f"{','.join(names_a[p:q])}|{','.join(names_b[r:s])}" for p, q, r, s in zip(ends_a, ends_a[1:], ends_b, ends_b[1:])]
        cuts = np.append(0, np.cumsum(links)).tolist()
        self.groups += [";".join(said[p:q]) for p, q in zip(cuts, cuts[1:])]
        self.at = grown(self.at, first + 1, first + 1 + n)
        used = int(self.at[first])
        self.at[first + 1 : first + 1 + n] = used + np.cumsum(links)
        self.pairs = grown(self.pairs, used, used + len(pairs))
        self.pairs[used : used + len(pairs)] = pairs
        if first + n > len(self.counts):
            self.counts = np.vstack([self.counts, np.zeros((first + n, 3), np.int64)])
        self.counts[first : first + n] = np.stack([count_a, count_b, np.repeat(good, sizes)], axis=1)
        return np.arange(first, first + n)

    def slots(self, words: list[str]) -> np.ndarray:
        """The slot of each of some distinct words."""
        fresh = [w for w in words if w not in self.slot_of]
        self.slot_of.update(zip(fresh, self.add(fresh).tolist()))
        return np.fromiter((self.slot_of[w] for w in words), np.int64, len(words))

    def align(self, texts: pa.Array) -> dict[str, list | np.ndarray]:
        """For each text n_a, n_b, n_groups, the groups as text, and the links of all texts one after another."""
        if len(self.slot_of) > self.cache_words or len(self.groups) > 2 * self.cache_words:
            self.forget()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_word:
            whole = np.ones(len(texts), bool)
        else:
            whole = pc.match_substring_regex(texts, WHOLE).to_numpy(zero_copy_only=False)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        whole = whole & ~empty
        lists = pc.split_pattern(pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), texts), " ")
        counts = np.diff(np.asarray(lists.offsets)).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        slot = self.slots(coded.dictionary.to_pylist())[np.asarray(coded.indices)] if len(coded) else np.zeros(0, np.int64)
        at = np.cumsum(counts) - counts
        odd = np.flatnonzero(whole)
        for i in odd.tolist():  # one at a time: each may be long
            slot[at[i]] = self.add([texts[i].as_py()])[0]
        slot, counts = slot[np.repeat(~empty, counts)], np.where(empty, 0, counts)
        owner = np.repeat(np.arange(len(texts)), counts)
        sums = np.stack([np.bincount(owner, self.counts[slot, c], len(texts)) for c in range(3)], axis=1).astype(np.int64)
        good = (sums[:, 2] == counts) & (counts > 0)
        n_links = np.where(good, np.bincount(owner, self.at[slot + 1] - self.at[slot], len(texts)).astype(np.int64), 0)
        slot, owner = slot[good[owner]], owner[good[owner]]
        starts = self.at[slot]
        lengths = self.at[slot + 1] - starts
        names, bounds = list(map(self.groups.__getitem__, slot.tolist())), np.append(0, np.cumsum(np.where(good, counts, 0))).tolist()
        said = [";".join(names[p:q]) for p, q in zip(bounds, bounds[1:])]
        return {"n_a": sums[:, 0] * good, "n_b": sums[:, 1] * good, "n_links": n_links, "groups": said, "owner": np.repeat(owner, lengths), "pairs": self.pairs[ragged(starts, lengths)]}


@functools.lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner for each pair of files and worker process."""
    return Aligner(path_a, path_b)


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """row (a number of its own for each row of the table once written), doc_id, counts, groups_sha256, and the text's distinct links (A id << 16 | B id) with how often each comes."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, row = aligner(path_a, path_b), TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            n = batch.num_rows
            got = tool.align(batch.column("text"))
            order = np.lexsort((got["pairs"], got["owner"]))
            owner, pairs = got["owner"][order], got["pairs"][order]
            turn = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (pairs[1:] != pairs[:-1]))) if len(pairs) else np.zeros(0, np.int64)
            times = np.diff(np.append(turn, len(pairs)))
            ends = pa.array(np.append(0, np.cumsum(np.bincount(owner[turn], minlength=n))), pa.int32())
            digest = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in got["groups"]]
            yield pa.RecordBatch.from_arrays([
                pa.array(row + np.arange(n)), batch.column("doc_id"), pa.array(got["n_a"]), pa.array(got["n_b"]), pa.array(got["n_links"]), pa.array(got["n_links"]), pa.array(digest, pa.string()),
                pa.ListArray.from_arrays(ends, pa.array(pairs[turn])), pa.ListArray.from_arrays(ends, pa.array(times, pa.int32())),
            ], names=[c.split()[0] for c in ALIGNED.split(", ")])
            row += n

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, ALIGNED)


def link_counts(rows: DataFrame) -> DataFrame:
    """link, a_id, b_id, count (links corpus-wide) and best (no link of its B id counts more)."""
    each = rows.select(F.explode(F.arrays_zip("links", "times")).alias("l"))
    counts = each.groupBy(F.col("l.links").alias("link")).agg(F.sum("l.times").alias("count"))
    counts = cut(counts.select("link", F.shiftright("link", 16).alias("a_id"), F.col("link").bitwiseAND(65535).alias("b_id"), "count"), "links")
    top = counts.groupBy("b_id").agg(F.max("count").alias("most"))
    return counts.join(top, "b_id").select("link", "a_id", "b_id", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """For each document n_a, n_b, n_groups, n_links, n_best (links that are their B id's most frequent, ties included), count_sum (over its links) and groups_sha256."""
    rows = cut(aligned(docs, path_a, path_b), "aligned")
    counts = link_counts(rows).select("link", "count", F.when(F.col("best"), 1).otherwise(0).alias("is_best"))
    each = rows.select("row", F.explode(F.arrays_zip("links", "times")).alias("l")).select("row", F.col("l.links").alias("link"), F.col("l.times").alias("times"))
    # the vocabularies bound the number of different links
    met = each.join(F.broadcast(counts), "link")
    sums = met.groupBy("row").agg(F.sum(F.col("times") * F.col("is_best")).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = F.lit(0).cast("bigint")
    return rows.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
