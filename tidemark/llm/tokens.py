"""Token ids of whole texts with a public tokenizer file, through a bounded word cache.

The file's pre-tokenizer drops white space and never joins across it, so a text's ids are the
concatenation of the ids of its runs between ASCII white space. ``check_splittable`` refuses
tokenizer files for which that is not known; those encode whole texts.

Edge cases: an empty or blank text has no ids (callers pass "" for null); texts of any length are encoded
whole, in pieces cut after white space; equal texts of a call are encoded once; two generations of a
bounded word cache only save time.
"""

from __future__ import annotations

import json
import string
from functools import lru_cache

import numpy as np

CACHE_WORDS = 300_000
RUN_WORDS = 256
#: Bytes of text whose words are looked up at once.
PIECE = 2_000_000
PUNCTUATION = string.punctuation.encode()
#: Bytes by kind: 1 ASCII letters and digits, 2 ASCII punctuation, 3 ASCII white space, 0 others.
KIND = np.zeros(256, np.uint8)
KIND[[*string.ascii_letters.encode(), *string.digits.encode()]] = 1
KIND[[*PUNCTUATION]] = 2
KIND[[9, 10, 11, 12, 13, 32]] = 3
#: Masks of the first n bytes of eight; odd multipliers.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
MIX = np.array([0x9E3779B97F4A7C15, 0x632BE59BD9B4E019, 0xC2B2AE3D27D4EB4F], np.uint64)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def check_splittable(path: str) -> bool:
    """True if white space is removed by the pre-tokenizer and nothing is added around a text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"[^\s" in first["pattern"].get("Regex", "")
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and not any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
    return bool(drops and plain and not spec.get("truncation") and not spec.get("padding"))


#: A pre-tokenizer pattern whose letter runs and punctuation runs are tokens of their own.
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_NORMALIZERS = {"NFC", "Replace", "Lowercase"}


def plain_tokenizer(spec: dict):
    """The same model for words that the normalizers leave alone and that are one pre-token.

    None if the file's normalizers or pattern are others than the known ones. A word's last token
    then ends in the model's end-of-word suffix."""
    from tokenizers import Tokenizer

    normalizers = (spec.get("normalizer") or {}).get("normalizers", [])
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    known = {n["type"] for n in normalizers} == PLAIN_NORMALIZERS and (first.get("pattern") or {}).get("Regex") == PLAIN_PATTERN
    if not known or not spec["model"].get("end_of_word_suffix"):
        return None
    pre = [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
    return Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": pre}}))


class Encoder:
    """texts -> little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = check_splittable(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens", [])
        #: an added token stands between words that are encoded in one call
        self.mark, self.mark_id = (added[-1]["content"], added[-1]["id"]) if added else ("", -1)
        self.plain = plain_tokenizer(spec) if self.split else None
        if self.plain:
            vocab = spec["model"]["vocab"]
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(spec["model"]["end_of_word_suffix"])]] = True
        self.added = [t["content"].encode("utf-8") for t in added]
        #: words' ids: the latest ones, and those before that were not asked for since
        self.cache: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _learn_plain(self, words: list[bytes]) -> None:
        """Encode lower-case letter runs and punctuation runs."""
        for i in range(0, len(words), RUN_WORDS):
            run = words[i : i + RUN_WORDS]
            (got,) = self.plain.encode_batch_fast([b" ".join(run).decode("utf-8")], add_special_tokens=False)
            ids = np.asarray(got.ids, dtype="<u4")
            raw, ends = ids.tobytes(), (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(ends) != len(run):
                raise ValueError("the tokenizer did not keep words apart")
            self.cache.update((w, raw[a:b]) for w, a, b in zip(run, [0, *ends], ends, strict=False))

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        """Encode words that the cache lacks, many in one call."""
        texts = [w.decode("utf-8") for w in words]
        if not self.mark or any(self.mark in t for t in texts):
            self.cache.update(zip(words, (i.tobytes() for i in self._encode(texts)), strict=True))
            return
        runs = [texts[i : i + RUN_WORDS] for i in range(0, len(texts), RUN_WORDS)]
        at = 0
        for run, ids in zip(runs, self._encode([f" {self.mark} ".join(r) for r in runs]), strict=True):
            raw, cuts = ids.tobytes(), [-1, *np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            if len(cuts) != len(run) + 1:
                raise ValueError("the tokenizer did not keep words apart")
            for a, b in zip(cuts, cuts[1:], strict=False):
                self.cache[words[at]] = raw[4 * a + 4 : 4 * b]
                at += 1

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.split:
            return [i.tobytes() for i in self._encode(texts)]
        distinct = dict.fromkeys(texts)
        pieces: list[bytes] = []
        counts = []
        for text in distinct:
            own = whole_word_pieces(self._lower(text.encode("utf-8")))
            counts.append(len(own))
            pieces += own
        ids, at = [], 0
        while at < len(pieces):
            end, size = at, 0
            while end < len(pieces) and (end == at or size + len(pieces[end]) <= PIECE):
                size += len(pieces[end])
                end += 1
            ids += self._pieces(pieces[at:end])
            at = end
        at = 0
        for text, n in zip(distinct, counts, strict=True):
            distinct[text] = ids[at] if n == 1 else b"".join(ids[at : at + n])
            at += n
        return [distinct[t] for t in texts]

    def _lower(self, raw: bytes) -> bytes:
        """raw in lower case if that surely changes no id: no combining marks, no added token comes up."""
        if not self.plain or b"\xcc" in raw or b"\xcd" in raw:
            return raw
        low = raw.lower()
        return raw if any(a in low for a in self.added) else low

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece: every distinct word is looked up once, its ids are copied to all its places."""
        joined = b"\n".join(pieces)
        if b"\0" in joined:  # words are told apart by zero-padded bytes below
            return [b"".join(self._lookup(p.split())) for p in pieces]
        raw = np.frombuffer(joined + b"\n" * 17, np.uint8)
        kind = KIND[raw]
        inside = kind != 3
        opens = np.zeros(len(raw), bool)
        opens[1:] = inside[1:] & ~inside[:-1]
        opens[0] = inside[0]
        if self.plain:  # one ASCII mark after an ASCII letter or digit is a pre-token, so a word of its own
            opens[1:-1] |= (kind[:-2] == 1) & (kind[1:-1] == 2) & (kind[2:] == 3)
        start = np.flatnonzero(opens)
        end = np.flatnonzero(inside[:-1] & (opens | ~inside)[1:]) + 1
        length = end - start
        eight = np.ndarray((len(raw) - 8,), "<u8", raw, strides=(1,))
        low, high = eight[start] & FIRST[np.minimum(length, 8)], eight[np.minimum(start + 8, len(eight) - 1)] & FIRST[np.clip(length - 8, 0, 8)]
        code = low * MIX[0] ^ (high + MIX[1]) * MIX[2]
        long = np.flatnonzero(length > 16)
        code[long] = [hash(joined[i:j]) & 0xFFFFFFFFFFFFFFFF for i, j in zip(start[long].tolist(), end[long].tolist(), strict=True)]
        _, first, group = np.unique(code, return_index=True, return_inverse=True)
        words = [joined[i:j] for i, j in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        same = first[group]
        exact = (low == low[same]).all() and (high == high[same]).all() and (length == length[same]).all()
        if not exact or any(joined[i:j] != words[g] for i, j, g in zip(start[long].tolist(), end[long].tolist(), group[long].tolist(), strict=True)):
            return [b"".join(self._lookup(p.split())) for p in pieces]
        found = self._lookup(words)
        each = np.array([len(v) for v in found], np.int64) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        n = each[group]
        upto = np.concatenate([[0], n.cumsum()])
        ids = flat[np.repeat((each.cumsum() - each)[group] - upto[:-1], n) + np.arange(upto[-1])]
        # words of a piece: those that start in it
        bounds = np.cumsum([0] + [len(p) + 1 for p in pieces])
        cuts = upto[np.searchsorted(start, bounds)].tolist()
        return [ids[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]

    def _lookup(self, words: list[bytes]) -> list[bytes]:
        if len(self.cache) > CACHE_WORDS // 2:
            self.old, self.cache = self.cache, {}
        known = list(map(self.cache.get, words))
        new = {w for w, v in zip(words, known, strict=True) if v is None}
        if new:
            self._extend(new)
            known = [self.cache[w] if v is None else v for w, v in zip(words, known, strict=True)]
        return known

    def _extend(self, new: set[bytes]) -> None:
        cache, old, whole, parts, need = self.cache, self.old, [], [], set()
        cache[b""] = b""
        for w in new:
            if (ids := old.get(w)) is not None:
                cache[w] = ids
            elif w.isalpha() and w.islower():
                need.add(w)
            else:
                # letters with trailing ASCII punctuation are two pre-tokens, whatever their case
                core = w.rstrip(PUNCTUATION)
                low = self._letters(core)
                if low is None:
                    whole.append(w)
                else:
                    parts.append((w, low, w[len(core) :]))
        need.update(p for _, a, b in parts for p in (a, b) if p not in cache)
        (self._learn_plain if self.plain else self._learn)(list(need))
        self._learn(whole)
        for w, a, b in parts:
            cache[w] = cache[a] + cache[b] if b else cache[a]

    def _letters(self, core: bytes) -> bytes | None:
        """core in lower case if it is all letters whose lower case is sure."""
        if core.isalpha() or not core:
            return core.lower()
        if self.plain and not core.isascii() and (text := core.decode("utf-8")).isalpha() and max(text) <= "\xff":
            return text.lower().encode("utf-8")
        return None


def whole_word_pieces(raw: bytes) -> list[bytes]:
    """raw cut after white space into pieces of at most about PIECE bytes; one piece at least."""
    out, at = [], 0
    while len(raw) - at > PIECE:
        gaps = np.flatnonzero(KIND[np.frombuffer(raw, np.uint8, PIECE, at)] == 3)
        if len(gaps):
            end = at + int(gaps[-1]) + 1
        else:
            rest = np.flatnonzero(KIND[np.frombuffer(raw, np.uint8, offset=at)] == 3)
            end = at + int(rest[0]) + 1 if len(rest) else len(raw)
        out.append(raw[at:end])
        at = end
    return [*out, raw[at:]]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)
