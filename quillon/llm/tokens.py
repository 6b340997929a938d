"""Token ids of many texts, with a tokenizer file of the `tokenizers` library.

The two public vocabularies cut a text into pieces first (runs of letters, digits, other
characters) and encode each piece alone. Texts made of plain Latin characters are therefore
cut with NumPy, each *distinct* piece is encoded once by the library, and the ids are put
together by position. All other texts, those that hold an added token of the file (such as an end
of text), and other tokenizer files, go through the library whole. Both ways give the library's
ids; tests compare them.

Defined results: a null text is empty and has no ids, as an empty one; a text of any length is
encoded whole; equal texts have equal ids, whatever stands next to them.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from quillon.llm.common import blocks

#: Distinct pieces that one encoder remembers before it starts anew.
CACHE_PIECES = 1_000_000

#: Bytes of text that are cut at once. Larger blocks have fewer distinct pieces to look up and take
#: more memory: 4 MB ones 150 MB more in each worker.
TEXT_BYTES = 1 << 20

LETTER, DIGIT, SPACE, OTHER, UNSAFE = 0, 1, 2, 3, 4

#: Split pattern of the lower-case vocabulary whose rules cut() knows (a fixed value of that file).
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _classes() -> np.ndarray:
    table = np.full(256, UNSAFE, np.uint8)
    table[0x20:0x7F] = OTHER
    table[list(b" \t\n\r")] = SPACE
    table[list(range(0x30, 0x3A))] = DIGIT
    table[list(range(0x41, 0x5B)) + list(range(0x61, 0x7B))] = LETTER
    # 0xC3 leads the Latin-1 letters; their second byte is checked in safe().
    table[0xC3] = LETTER
    table[0x80:0xC0] = LETTER
    table[ord("'")] = UNSAFE  # contractions need the library's pattern
    return table


CLASSES = _classes()


def safe(raw: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """False at each byte that the NumPy rules don't cover."""
    ok = kinds != UNSAFE
    if (high := raw >= 0x80).any():
        lead = raw == 0xC3
        after = np.zeros_like(lead)
        after[1:] = lead[:-1]
        ok &= ~high | lead | (after & (raw != 0x97) & (raw != 0xB7))
    return ok


class Encoder:
    """ids(texts as one buffer) for one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind = self._kind(spec)
        #: In lower case, as a normalizer may make them appear; a text with one goes to the library.
        self.added = [t["content"].lower().encode() for t in spec.get("added_tokens") or [] if t["content"]]
        if not all(re.fullmatch(rb"[!-~]+", t) for t in self.added):
            self.kind = "whole"
        self._reset()

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            return "spaced"
        steps = pre.get("pretokenizers") or [{}]
        if steps[0].get("pattern") == {"Regex": WORD_SPLIT} and steps[0].get("invert") and norm and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            return "words"
        return "whole"

    def _reset(self) -> None:
        self.key = np.zeros(0, np.uint64)  # sorted
        self.low, self.high = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.count = np.zeros(0, np.int32), np.zeros(0, np.uint8)
        self.flat = np.zeros(0, np.uint32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's ids begin, with the end)."""
        n = len(offsets) - 1
        counts, parts = np.zeros(n, np.int64), []
        for i, j in blocks(offsets, TEXT_BYTES, trim=False):
            ids, c = self._block(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            parts.append(ids)
            counts[i:j] = c
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), np.concatenate([[0], np.cumsum(counts)])

    def _block(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, size = len(offsets) - 1, len(raw)
        if self.kind == "whole":
            odd = np.ones(n, bool)
        else:
            kinds = CLASSES[raw]
            bad = np.concatenate([[0], np.cumsum(~safe(raw, kinds))])
            odd = bad[offsets[1:]] > bad[offsets[:-1]]
            odd[np.searchsorted(offsets, self._added_at(raw), side="right") - 1] = True
        texts = [raw[a:b].tobytes().decode("utf-8") for a, b in zip(offsets[:-1][odd], offsets[1:][odd])]
        slow = self.whole(texts)
        if odd.all():
            return (np.concatenate(slow) if slow else np.zeros(0, np.uint32)), np.array([len(x) for x in slow], np.int64)
        starts, ends = self._cut(raw, kinds, offsets)
        doc = np.searchsorted(offsets, starts, side="right") - 1
        if odd.any():
            use = ~odd[doc]
            starts, ends, doc = starts[use], ends[use], doc[use]
        text = raw
        if self.kind == "words":
            text = raw.copy()
            text[(raw >= 0x41) & (raw <= 0x5A)] += 32
            high = np.zeros(size, bool)
            high[1:] = (raw[:-1] == 0xC3) & (raw[1:] <= 0x9E)
            text[high] += 32
        at, count = self._pieces(text, starts, ends)
        total = int(count.sum())
        begin = np.cumsum(count) - count
        ids = self.flat[np.repeat(at - begin, count) + np.arange(total)]
        per = np.bincount(doc, weights=count, minlength=n).astype(np.int64)
        if not odd.any():
            return ids, per
        out, cuts, k = [], np.concatenate([[0], np.cumsum(per)]), 0
        for d in range(n):
            if odd[d]:
                out.append(slow[k])
                per[d] = len(slow[k])
                k += 1
            else:
                out.append(ids[cuts[d] : cuts[d + 1]])
        return np.concatenate(out), per

    def _added_at(self, raw: np.ndarray) -> np.ndarray:
        """Where an added token of the file may begin."""
        text = raw.tobytes().lower() if self.added else b""
        return np.array([m.start() for t in self.added if t in text for m in re.finditer(re.escape(t), text)], np.int64)

    def _cut(self, raw: np.ndarray, kinds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin and end."""
        size = len(raw)
        edge = np.zeros(size + 1, bool)  # a text begins here
        edge[offsets] = True
        change = np.empty(size, bool)
        change[:1] = True
        np.not_equal(kinds[1:], kinds[:-1], out=change[1:])
        change |= edge[:-1]
        space = kinds == SPACE
        if self.kind == "words":
            start = (change | (kinds == DIGIT)) & ~space
            stop = np.flatnonzero(np.append(start, True) | np.append(change, True))
            starts = np.flatnonzero(start)
            return starts, stop[np.searchsorted(stop, starts, side="right")]
        blank = raw == 0x20
        after_blank = np.zeros(size, bool)
        after_blank[1:] = blank[:-1]
        after_blank &= ~edge[:-1]
        # The last of a run of spaces begins a piece of its own if a word follows it.
        last = np.zeros(size, bool)
        last[:-1] = space[:-1] & ~space[1:] & ~edge[1:-1]
        start = (space & (change | last)) | (~space & change & ~after_blank)
        starts = np.flatnonzero(start)
        return starts, np.append(starts[1:], size)

    def _pieces(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and count of the ids of each piece in self.flat."""
        length = ends - starts
        padded = np.concatenate([text, np.zeros(16, np.uint8)])
        wide = np.ndarray(shape=(len(text) + 9,), dtype="<u8", buffer=padded.data, strides=(1,))
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        mask = full >> ((8 - np.minimum(length, 8)).astype(np.uint64) * np.uint64(8))
        low = wide[starts] & mask
        high = np.zeros(len(starts), np.uint64)
        more = np.flatnonzero(length > 8)
        mask = full >> ((16 - np.minimum(length[more], 16)).astype(np.uint64) * np.uint64(8))
        high[more] = wide[starts[more] + 8] & mask
        key = (low * np.uint64(0x9E3779B97F4A7C15)) ^ ((high + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F))
        key ^= key >> np.uint64(29)
        long = np.flatnonzero(length > 16)
        short = length <= 16
        at, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        order = np.flatnonzero(short) if len(long) else None
        k, lo, hi = (key, low, high) if order is None else (key[order], low[order], high[order])
        distinct, first, inverse = np.unique(k, return_index=True, return_inverse=True)
        dlo, dhi = lo[first], hi[first]
        if (dlo[inverse] != lo).any() or (dhi[inverse] != hi).any():  # two pieces with one key
            distinct = None
        place = None if distinct is None else self._known(distinct, dlo, dhi)
        if place is None:
            a, c = self._each(text, starts if order is None else starts[order], ends if order is None else ends[order])
        else:
            a, c = self.at[place][inverse].astype(np.int64), self.count[place][inverse].astype(np.int64)
        if order is None:
            at, count = a, c
        else:
            at[order], count[order] = a, c
        if len(long):
            at[long], count[long] = self._each(text, starts[long], ends[long])
        return at, count

    def _add(self, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        count = np.array([len(x) for x in ids], np.int64)
        at = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate([self.flat, np.array([y for x in ids for y in x], np.uint32)])
        return at, count

    def _library(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _each(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = text.tobytes()
        seen: dict[bytes, int] = {}
        which = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
        at, count = self._add(self._library([x.decode("utf-8") for x in seen]))
        return at[which], count[which]

    def _known(self, key: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray | None:
        """Places in the table of these sorted keys; new ones are encoded. None: a clash."""
        if len(self.flat) > 8 * CACHE_PIECES or len(self.key) > CACHE_PIECES:
            self._reset()
        place = np.searchsorted(self.key, key)
        old = np.zeros(len(key), bool)
        inside = place < len(self.key)
        old[inside] = self.key[place[inside]] == key[inside]
        if (self.low[place[old]] != low[old]).any() or (self.high[place[old]] != high[old]).any():
            return None
        new = ~old
        if new.any():
            both = np.stack([low[new], high[new]], axis=1).astype("<u8").tobytes()
            pieces = [both[i : i + 16].rstrip(b"\0").decode("utf-8") for i in range(0, len(both), 16)]
            at, count = self._add(self._library(pieces))
            order = np.argsort(np.concatenate([self.key, key[new]]), kind="stable")
            joined = lambda a, b: np.concatenate([a, b])[order]
            self.low, self.high = joined(self.low, low[new]), joined(self.high, high[new])
            self.at, self.count = joined(self.at, at.astype(np.int32)), joined(self.count, count.astype(np.uint8))
            self.key = joined(self.key, key[new])
            place = np.searchsorted(self.key, key)
        return place


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for this file; made once a process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def has_letter(text: str | None) -> bool:
    return bool(text) and re.search(r"[^\W\d_]", text) is not None
