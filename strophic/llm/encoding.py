"""Whole texts to token ids with the ``tokenizers`` library, each distinct word encoded once per worker.

A pre-tokenizer that never joins text across a word boundary gives a text's ids as the ids of its
pieces in a row. Two kinds of pieces are known to be safe and are read off the tokenizer's own
description; any other tokenizer gets whole texts:

* ``ByteLevel`` with its own pattern: a piece begins at a space or line feed whose left neighbour isn't
  white space, and takes a run of white space with it. Texts with other white space are encoded whole.
* a ``Split`` that drops white space, after normalisers that work on one character or compose marks:
  pieces are runs without white space.

A further cut before punctuation that follows an ASCII or Latin-1 letter or an ASCII digit is safe for both: their
patterns never match across it. Pieces are found on the bytes of many texts at once and looked up by a 64-bit hash; a
piece that is found is compared byte by byte with the one in the table, and encoded for itself if it differs.

The worker's table of pieces is emptied when it is full, so memory is bounded.
"""

from __future__ import annotations

import json
import re

import numpy as np

from .words import _LOWER, SPACED, U, byte_hashes, same_bytes

#: Pieces that a Python worker remembers; with its table about 90 MB.
REMEMBERED = 2_000_000
_SLOTS, _PROBES = 22, 32
#: Bytes of pieces that are kept for comparison.
_TEXT = 32 << 20
_byte = np.arange(256)
_LETTER = ((_byte | 32) >= 0x61) & ((_byte | 32) <= 0x7A) & (_byte < 0x80) | (_byte >= 0x30) & (_byte <= 0x39)
_PUNCT = (_byte > 0x20) & (_byte < 0x7F) & ~_LETTER
_BLANK = (_byte == 0x20) | (_byte == 0x0A)
#: Bytes of which a text may have white space other than these two
_UNSURE = (_byte < 0x20) & ~_BLANK | np.isin(_byte, [0xC2, 0xE1, 0xE2, 0xE3])
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　\x00]")
_INFO_SPACE = re.compile("[\x1c-\x1f]")
_open: dict[str, "Encoder"] = {}


def split_kind(spec: dict) -> str:
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "byte"
    steps = pre.get("pretokenizers") or [{}]
    safe = {"NFC", "Lowercase"}
    drops = steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and str(dict(steps[0].get("pattern") or {}).get("Regex")).endswith("[^\\s\\p{L}\\p{N}]+")
    plain = [n for n in (norm or {}).get("normalizers", []) if n["type"] not in safe and not (n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " ")]
    rest = [s for s in steps[1:] if not (s.get("type") == "ByteLevel" and not s.get("use_regex") and not s.get("add_prefix_space"))]
    return "space" if drops and not plain and not rest and (norm or {}).get("type") == "Sequence" else "whole"


class Encoder:
    """Ids as little-endian unsigned 32-bit integers, one bytes object a text."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind = split_kind(spec)
        own = [a for a in spec.get("added_tokens") or () if a["special"] and not (a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"])]
        self.mark, self.mark_id = (own[0]["content"], own[0]["id"]) if own else (None, None)
        self.marked = Tokenizer.from_file(path) if own else None
        self.marks = [a["content"] for a in spec.get("added_tokens") or ()]
        self.known: dict[str, bytes] = {}
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        """An open hash table of pieces: key, first id in ``flat``, number of ids, and where its bytes are in ``text``."""
        self.keys, self.at, self.size = np.zeros(1 << _SLOTS, U), np.zeros(1 << _SLOTS, np.uint32), np.zeros(1 << _SLOTS, np.uint32)
        self.flat, self.used, self.pieces_known = np.empty(1 << 16, "<u4"), 0, 0
        self.text, self.text_used = np.empty(1 << 16, np.uint8), 0  # the bytes of the pieces
        self.text_at, self.text_size = np.zeros(1 << _SLOTS, np.uint32), np.zeros(1 << _SLOTS, np.uint32)

    @classmethod
    def of(cls, path: str) -> "Encoder":
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        if path not in _open:
            _open[path] = cls(path)
        return _open[path]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def each(self, pieces: list[str]) -> list[bytes]:
        """Ids of many short pieces: a special token between two pieces keeps them apart, and one long text is cheaper than many short ones."""
        if self.mark is None or any(m in p for m in self.marks for p in pieces):
            return self.whole(pieces)
        out: list[bytes] = []
        runs = [pieces[a : a + 512] for a in range(0, len(pieces), 512)]
        for run, e in zip(runs, self.marked.encode_batch([self.mark.join(r) for r in runs], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids)).tolist()
            raw, at = ids.tobytes(), 0
            for end in ends:
                out.append(raw[4 * at : 4 * end])
                at = end + 1
        return out

    def pieces(self, text: str) -> list[str] | None:
        """None: the text has to be encoded whole."""
        if self.kind == "space":
            return None if _INFO_SPACE.search(text) else text.split()
        if self.kind != "byte" or _OTHER_SPACE.search(text):
            return None
        out = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
            run, joined = "", []
            for piece in out:
                if piece in (" ", "\n"):
                    run += piece
                else:
                    joined.append(run + piece)
                    run = ""
            out = [*joined, run] if run else joined
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.pieces(t) for t in texts]
        out: list[bytes] = [b""] * len(texts)
        if odd := [k for k, p in enumerate(split) if p is None]:
            for k, ids in zip(odd, self.whole([texts[k] for k in odd])):
                out[k] = ids
        known = self.known
        new = list(set().union(*(p for p in split if p is not None)).difference(known))
        if len(known) + len(new) > self.remembered:
            known.clear()
            new = list(set().union(*(p for p in split if p is not None)))
        known.update(zip(new, self.each(new)))
        for k, p in enumerate(split):
            if p is not None:
                out[k] = b"".join(map(known.__getitem__, p))
        return out

    def _pieces_of_bytes(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte ranges of the pieces of some texts; texts that need the slow way must be empty here."""
        cut = np.zeros(len(data) + 1, bool)
        cut[off] = True
        letter = _LETTER[data]
        if len(data) > 1:  # the second byte of a Latin-1 letter
            letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        begins = cut[:-1].copy()
        begins[1:] |= _PUNCT[data[1:]] & letter[:-1]
        if self.kind == "byte":
            blank = _BLANK[data]
            begins[1:] |= blank[1:] & ~blank[:-1]
            start = np.flatnonzero(begins)
            return start, np.append(start[1:], len(data))
        inside = SPACED[data]
        begins[1:] |= ~inside[:-1]
        ends = ~np.append(inside[1:], False) | cut[1:]
        ends[:-1] |= begins[1:]
        return np.flatnonzero(begins & inside), np.flatnonzero(ends & inside) + 1

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for unknown ones."""
        out, left, base = np.full(len(h), -1, np.int64), np.arange(len(h)), (h >> U(64 - _SLOTS)).astype(np.int64)
        for k in range(_PROBES):
            slot = (base[left] + k) & ((1 << _SLOTS) - 1)
            key = self.keys[slot]
            same = key == h[left]
            out[left[same]] = slot[same]
            left = left[~same & (key != 0)]
            if not len(left):
                break
        return out

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode new pieces: first ids in ``flat`` and numbers of ids."""
        ids = self.each([data[a:b].tobytes().decode() for a, b in zip(start.tolist(), end.tolist())])
        size = np.array([len(x) // 4 for x in ids], np.int64)
        need = int(size.sum())
        if self.used + need > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(need + self.used // 2, "<u4")])
        self.flat[self.used : self.used + need] = np.frombuffer(b"".join(ids), "<u4")
        at = self.used + np.cumsum(size) - size
        self.used += need
        length = end - start
        need = int(length.sum())
        if self.text_used + need > len(self.text):
            self.text = np.concatenate([self.text[: self.text_used], np.empty(need + self.text_used // 2, np.uint8)])
        text_at = self.text_used + np.cumsum(length) - length
        self.text[self.text_used : self.text_used + need] = data[np.repeat(start - (text_at - self.text_used), length) + np.arange(need)]
        self.text_used += need
        left, base = np.arange(len(h)), (h >> U(64 - _SLOTS)).astype(np.int64)
        for k in range(_PROBES):  # a piece that finds no place is encoded again next time
            slot = (base[left] + k) & ((1 << _SLOTS) - 1)
            free = np.flatnonzero(self.keys[slot] == 0)
            own, first = np.unique(slot[free], return_index=True)
            mine = left[free[first]]
            self.keys[own], self.at[own], self.size[own] = h[mine], at[mine], size[mine]
            self.text_at[own], self.text_size[own] = text_at[mine], length[mine]
            self.pieces_known += len(mine)
            left = np.delete(left, free[first])
            if not len(left):
                break
        return at, size

    def _differing(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, slot: np.ndarray, miss: np.ndarray, learnt: np.ndarray) -> dict[int, bytes]:
        """Ids of pieces whose hash was found but whose bytes are others. ``learnt``: for each missing piece, the one encoded for it."""
        length, found = end - start, np.flatnonzero(slot >= 0)
        same = self.text_size[slot[found]] == length[found]
        same[same] = same_bytes(data, start[found[same]], self.text[: self.text_used], self.text_at[slot[found[same]]].astype(np.int64), length[found[same]])
        odd = found[~same]
        if len(miss):
            other = miss[learnt]
            alike = length[miss] == length[other]
            alike[alike] = same_bytes(data, start[miss[alike]], data, start[other[alike]], length[miss[alike]])
            odd = np.concatenate([odd, miss[~alike]])
        return {int(k): self.each([data[start[k] : end[k]].tobytes().decode()])[0] for k in odd}

    def encode_bytes(self, data: np.ndarray, off: np.ndarray) -> list[bytes]:
        """The ids of each of some texts, given as their bytes in a row and their offsets."""
        n = len(off) - 1
        if self.kind == "whole":
            return self.whole([data[a:b].tobytes().decode() for a, b in zip(off[:-1], off[1:])])
        slow: list[int] = []
        if self.kind == "byte":
            unsure = np.concatenate([[0], np.cumsum(_UNSURE[data])])[off]
            slow = np.flatnonzero(np.diff(unsure)).tolist()
        else:
            data = _LOWER[data]
        odd = dict(zip(slow, self.encode([data[off[k] : off[k + 1]].tobytes().decode() for k in slow]))) if slow else {}
        if slow:
            keep = np.repeat(~np.isin(np.arange(n), slow), np.diff(off))
            sizes = np.diff(off)
            sizes[slow] = 0
            data, off = data[keep], np.concatenate([[0], np.cumsum(sizes)])
        if self.pieces_known > self.remembered or self.used > 1 << 31 or self.text_used > _TEXT:
            self._forget()
        start, end = self._pieces_of_bytes(data, off)
        if not len(start):
            return [odd.get(k, b"") for k in range(n)]
        h = byte_hashes(data, start, end) | U(1)
        slot = self._find(h)
        at, size, miss = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64), np.flatnonzero(slot < 0)
        if len(miss):
            own, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            own_at, own_size = self._learn(data, start[miss[first]], end[miss[first]], own)
            at[miss], size[miss] = own_at[back], own_size[back]
        for k, ids in self._differing(data, start, end, slot, miss, first[back] if len(miss) else miss).items():
            at[k], size[k] = self.used, len(ids) // 4
            if self.used + len(ids) // 4 > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.empty(len(ids) // 4 + self.used // 2, "<u4")])
            self.flat[self.used : self.used + len(ids) // 4] = np.frombuffer(ids, "<u4")
            self.used += len(ids) // 4
        ends = np.cumsum(size)
        raw = self.flat[np.repeat(at - ends + size, size) + np.arange(ends[-1])].tobytes()
        bound = (4 * np.concatenate([[0], ends])[np.searchsorted(start, off)]).tolist()
        return [odd[k] if k in odd else raw[bound[k] : bound[k + 1]] for k in range(n)]
