"""Whole-text tokenisation in tasks with the tokenizers library, which encodes each distinct piece of a text once.

A text is cut where the tokenizer's own pre-tokenisation cuts it in any case, equal pieces are found by
dictionary encoding, and the library encodes those that this worker has not met before. A text whose white
space does not follow the plain rule, or that spells one of the vocabulary's added tokens, is encoded whole. The ids
equal those of encode(text, add_special_tokens=False) of the library as it loads the file. Pieces are known by their
128-bit digests alone: two pieces with one digest, which no one has seen, would share their ids.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from odolith.llm.text import byte_view, ragged

#: Distinct pieces a worker remembers before it starts anew (about 50 bytes each); bounds memory, never changes results.
CACHE_PIECES = 2_000_000

#: A text that matches has a space that may not be a cut: at an end, or beside other white space.
ODD_SPACE = r"^ | $| [\pZ\x09-\x0d\x1c-\x1f\x{85}]"


class PieceEncoder:
    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.mode, self.whole, self.cache_pieces = cut_rule(spec), whole_rule(spec), cache_pieces
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.forget()

    def forget(self) -> None:
        """Known pieces: two halves of their 128-bit digests, sorted by the first, and the slot of each; at[slot] .. at[slot + 1] are a slot's ids."""
        self.high, self.low, self.slot_of = (np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64))
        self.ids, self.at, self.n_ids, self.n_slots = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0, 0

    def add(self, texts: list[str]) -> np.ndarray:
        """New slots that hold the ids of texts."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for x in got for i in x), np.uint32, int(lengths.sum()))
        return self.put(flat, lengths)

    def put(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        n = len(lengths)
        self.ids = grown(self.ids, self.n_ids, self.n_ids + len(flat))
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.at = grown(self.at, self.n_slots + 1, self.n_slots + 1 + n)
        self.at[self.n_slots + 1 : self.n_slots + 1 + n] = self.n_ids + np.cumsum(lengths)
        self.n_ids, self.n_slots = self.n_ids + len(flat), self.n_slots + n
        return np.arange(self.n_slots - n, self.n_slots)

    def slots(self, values: pa.Array, lead: str) -> np.ndarray:
        """The slot of each of some distinct pieces, with `lead` before it."""
        data, at = byte_view(values)
        data, mark, digest = bytes(data), lead.encode(), xxhash.xxh3_128_digest
        bounds = at.tolist()
        seed = len(mark)
        key = np.frombuffer(b"".join(digest(data[a:b], seed) for a, b in zip(bounds, bounds[1:])), ">u8").astype(np.uint64).reshape(-1, 2)
        i = np.minimum(np.searchsorted(self.high, key[:, 0]), max(len(self.high) - 1, 0))
        hit = (self.high[i] == key[:, 0]) & (self.low[i] == key[:, 1]) if len(self.high) else np.zeros(len(key), bool)
        out = np.empty(len(key), np.int64)
        out[hit] = self.slot_of[i[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            fresh = [lead + x for x in values.take(pa.array(new)).to_pylist()]
            out[new] = self.add(fresh)
            order = np.argsort(key[new, 0], kind="stable")
            where = np.searchsorted(self.high, key[new, 0][order])
            self.high = np.insert(self.high, where, key[new, 0][order])
            self.low = np.insert(self.low, where, key[new, 1][order])
            self.slot_of = np.insert(self.slot_of, where, out[new][order])
        return out

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty) one after another, and the number of each text's ids; end_id ends each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n, extra = len(texts), int(end_id is not None)
        if self.n_slots > self.cache_pieces:
            self.forget()
        flat, counts, whole = self.pieces(texts)
        # slot of each piece; the end id is one more piece of its text
        room = np.cumsum(counts + extra) - (counts + extra)
        slot = np.empty(int((counts + extra).sum()), np.int64)
        rest = np.ones(len(slot), bool)
        if extra:
            ends = np.cumsum(counts + 1) - 1
            slot[ends] = self.put(np.array([end_id], np.uint32), np.array([1]))[0]
            rest[ends] = False
        if self.mode == "space":
            inside = np.cumsum(counts) - counts
            leads = flat.take(pa.array(inside)).dictionary_encode()
            slot[room] = self.slots(leads.dictionary, "")[np.asarray(leads.indices)]
            rest[room] = False
            keep = np.ones(len(flat), bool)
            keep[inside] = False
            flat = flat.filter(pa.array(keep))
        if len(flat):
            coded = flat.dictionary_encode()
            slot[rest] = self.slots(coded.dictionary, " " if self.mode == "space" else "")[np.asarray(coded.indices)]
        if len(whole):
            slot[room[whole]] = self.add(texts.take(pa.array(whole)).to_pylist())
        starts = self.at[slot]
        lengths = self.at[slot + 1] - starts
        ids = self.ids[ragged(starts, lengths)]
        ended = np.concatenate([[0], np.cumsum(lengths)])
        sizes = ended[room + counts + extra] - ended[room]
        return ids, sizes

    def pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Pieces of all texts, their number in each text, and which texts have one piece that stands for the whole."""
        if self.mode == "whole":
            return pa.array([""] * len(texts), pa.large_string()), np.ones(len(texts), np.int64), np.arange(len(texts))
        whole = np.flatnonzero(pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)) if self.whole else np.zeros(0, np.int64)
        if len(whole):
            odd = np.zeros(len(texts), bool)
            odd[whole] = True
            # one piece stands for the text until the ids of the whole take its place
            texts = pc.if_else(pa.array(odd), pa.scalar("a", pa.large_string()), texts)
        if self.mode == "blank":
            lists = pc.ascii_split_whitespace(texts)
            flat, counts = lists.flatten(), np.diff(np.asarray(lists.offsets))
            keep = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(texts)), counts)[keep]
            return flat.filter(pa.array(keep)), np.bincount(owner, minlength=len(texts)), whole
        lists = pc.split_pattern(texts, " ")
        return lists.flatten(), np.diff(np.asarray(lists.offsets)), whole


def cut_rule(spec: dict) -> str:
    """Where a text may be cut without changing its ids: at single spaces before a word ("space"), at white space that is dropped ("blank"), or nowhere ("whole")."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "space"
    inner = (pre.get("pretokenizers") or [{}])[0]
    pattern = (inner.get("pattern") or {}).get("Regex", "")
    if inner.get("type") == "Split" and inner.get("behavior") == "Removed" and inner.get("invert") and pattern.endswith(r"[^\s\p{L}\p{N}]+"):
        return "blank"
    return "whole"


def whole_rule(spec: dict) -> str:
    """Matches a text that must be encoded whole: one that may hold an added token, in whatever case a normalizer makes of it, or odd white space."""
    added = [f"(?i:{re.escape(t['content'])})" for t in spec.get("added_tokens") or []]
    return "|".join([*added, *([ODD_SPACE] if cut_rule(spec) == "space" else [])])


def grown(a: np.ndarray, used: int, need: int) -> np.ndarray:
    if need <= len(a):
        return a
    out = np.zeros(max(need, 2 * len(a)), a.dtype)
    out[:used] = a[:used]
    return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder for each vocabulary file and worker process."""
    return PieceEncoder(path)
