"""Ids of two public tokenizers for whole texts, and the bytes of their tokens.

A is a byte-level BPE file of the tokenizers library, B a sentencepiece model that adds a space before a text. Texts
are cut into chunks before every single space between two visible ASCII characters: A's pattern takes such a space as
the first character of a word, and no piece of B has a space behind another character (``Pair`` refuses models where
one has), so the ids of the chunks in a row are the text's. Chunks that a bounded cache lacks are joined and encoded
at once, for the same reason.

A's ids of texts below U+3000 come from tiktoken with the file's own vocabulary, five times faster: the file's merges
must be in the order of their ids (checked), and the two libraries' character classes agree there (tested).

Edge cases: the strings of special tokens are ordinary text; a text without a place to cut is one chunk of any length; a
full cache starts anew, which costs time only.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

#: Chunks, and ids of one tokenizer, that are kept at most before the cache starts anew.
CACHE_CHUNKS, CACHE_IDS = 400_000, 4_000_000
#: Chunks that B encodes at once: its time for a text grows a little faster than the text.
GROUP = 256
CUT = re.compile(r"(?<=[!-~])(?= [!-~])")
JOINS = re.compile(r"(?s) [!-~](.*[!-~])?")
BEYOND = re.compile("[^\x00-⿿]")
SPACE = "▁"
#: The word pattern of byte-level files without one of their own (fixed by their format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: visible Latin-1 characters stand for themselves, the
    other bytes in order for the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Kept:
    """Arrays of ids, one behind the other, that grow."""

    def __init__(self):
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def add(self, ids: np.ndarray) -> int:
        """Adds ids; returns where they start."""
        start = self.used
        self.used += len(ids)
        if self.used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), self.used), np.int32)])
        self.flat[start : self.used] = ids
        return start


class Pair:
    """Both tokenizers with their byte tables."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        chars, special = byte_of_char(), {i for i, t in self.a.get_added_tokens_decoder().items() if t.special}
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            self.a_bytes[i] = token.encode() if i in special else bytes(chars[c] for c in token)
        self.fast = self._fast(a_path, special)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece has a space inside: its model cannot encode chunks")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-Fa-f]{2}>", p) else p.replace(SPACE, " ").encode() for p in pieces]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_flat, self.b_flat = (np.frombuffer(b"".join(t), np.uint8) for t in (self.a_bytes, self.b_bytes))
        if not self.a_len.all() or not self.b_len.all():
            raise ValueError("tokens without bytes")
        self.sides = (self.a_len, self.a_flat), (self.b_len, self.b_flat)
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.kept = (Kept(), Kept())
        #: of each chunk: where its ids of A and B start, and how many it has; a chunk whose bytes change has none
        self.table = np.zeros((1024, 4), np.int64)

    def _fast(self, path: str, special: set[int]):
        """tiktoken over the same vocabulary, or None where the file allows another order or pattern."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or spec.get("normalizer") or merged != sorted(merged):
            return None
        ranks = {b: i for i, b in enumerate(self.a_bytes) if i not in special}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _a_ids(self, text: str) -> list[int]:
        if self.fast and not BEYOND.search(text):
            return self.fast.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def _keep(self, chunks: list[str], starts: tuple, counts: tuple) -> None:
        n = len(self.at)
        while n + len(chunks) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[n : n + len(chunks)] = np.stack([*starts, *counts], 1)
        self.at.update(zip(chunks, range(n, n + len(chunks)), strict=True))

    def _learn(self, chunks: list[str]) -> None:
        """Ids of chunks that differ and are not kept yet. Each starts with the added or the cut space."""
        alone = [c for c in chunks if SPACE in c or not JOINS.fullmatch(c)]
        if len(alone) < len(chunks):
            odd = set(alone)
            joined = [c for c in chunks if c not in odd]
            groups = ["".join(joined[k : k + GROUP]) for k in range(0, len(joined), GROUP)]
            b = self.b.encode([g[1:] for g in groups], num_threads=1)
            ids = (np.array(self._a_ids("".join(groups)), np.int32), np.fromiter(chain.from_iterable(b), np.int32))
            raw = [c.encode() for c in joined]
            ends = np.cumsum([len(r) for r in raw])
            if all(self._same([own], [b"".join(raw)], *t)[0] for own, t in zip(ids, self.sides, strict=True)):
                cuts = [np.concatenate([[0], np.searchsorted(np.cumsum(t[0][own]), ends) + 1]) for own, t in zip(ids, self.sides, strict=True)]
                self._keep(joined, tuple(k.add(own) + c[:-1] for k, own, c in zip(self.kept, ids, cuts, strict=True)), tuple(np.diff(c) for c in cuts))
            else:
                alone = chunks
        for c in alone:
            ids, raw = self._ids(c), [c.encode()]
            if not all(self._same([own], raw, *t)[0] for own, t in zip(ids, self.sides, strict=True)):
                ids = (ids[0][:0], ids[1][:0])
            self._keep([c], tuple([k.add(own)] for k, own in zip(self.kept, ids, strict=True)), tuple([len(own)] for own in ids))

    def _ids(self, spaced: str) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of a text with its leading space, and B's, which adds that space itself."""
        return np.array(self._a_ids(spaced), np.int32), np.array(self.b.encode(spaced[1:], num_threads=1), np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A (of space + text) and of B (of text) of all texts in a row, and how many of each every text has: none for
        an empty text and where the joined bytes of either side differ from space + text. No text is null."""
        if len(self.at) > CACHE_CHUNKS or max(k.used for k in self.kept) > CACHE_IDS:
            self._clear()
        chunks = [CUT.split(" " + t) if t else [] for t in texts]
        counts = np.fromiter(map(len, chunks), np.int64, len(chunks))
        flat = list(chain.from_iterable(chunks))
        if new := [c for c in dict.fromkeys(flat) if c not in self.at]:
            self._learn(new)
        at = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        owner = np.repeat(np.arange(len(texts)), counts)
        changed = np.zeros(len(texts), bool)
        changed[owner[self.table[at, 2] == 0]] = True
        stays = ~changed[owner]
        at, owner = at[stays], owner[stays]
        out = []
        for k, kept in enumerate(self.kept):
            start, n = self.table[at, k], self.table[at, 2 + k]
            ends = np.cumsum(n)
            pick = np.repeat(start - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
            out.append((kept.flat[pick], np.bincount(owner, weights=n, minlength=len(texts)).astype(np.int64)))
        (a, n_a), (b, n_b) = out
        return a, b, n_a, n_b

    @staticmethod
    def _same(ids: list[np.ndarray], raw: list[bytes], sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Whether the bytes of each text's tokens are the text's, slice by slice."""
        starts = np.cumsum(sizes) - sizes
        same = np.array([int(sizes[x].sum()) == len(r) for x, r in zip(ids, raw, strict=True)], bool)
        at = np.flatnonzero(same)
        want = np.frombuffer(b"".join(raw[k] for k in at), np.uint8)
        tokens = np.concatenate([np.zeros(0, np.int32), *(ids[k] for k in at)])
        texts_end = np.cumsum([len(raw[k]) for k in at])
        place = 0
        for k in range(0, len(tokens), 1 << 16):
            own = tokens[k : k + (1 << 16)]
            n = sizes[own]
            ends = np.cumsum(n)
            got = flat[np.repeat(starts[own] - ends + n, n) + np.arange(ends[-1])]
            wrong = np.flatnonzero(got != want[place : place + len(got)]) + place
            same[at[np.unique(np.searchsorted(texts_end, wrong, side="right"))]] = False
            place += len(got)
        return same
