"""Byte-level BPE ids of many texts at once.

Texts are cut into the tokenizer's own pre-tokens with numpy; each distinct pre-token is
encoded once by the `tokenizers` library and its ids are looked up for every occurrence.
Texts for which that split isn't certain (characters whose class depends on the Unicode
version, special token strings) are encoded whole by the library.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from widegrain.llm import kernels
from widegrain.llm.common import ragged_arange

#: White space by Unicode's White_Space property (fixed values).
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE, UNSURE = range(5)
#: Distinct pre-tokens kept by a worker before it starts afresh.
CACHE_WORDS = 1 << 20


def char_classes() -> np.ndarray:
    """Class of every code point; UNSURE if it has changed since Unicode 3.2."""
    old = unicodedata.ucd_3_2_0
    table = np.full(0x110000, UNSURE, np.uint8)
    for cp in range(0x30000):
        c = chr(cp)
        now = unicodedata.category(c)
        if now[0] != old.category(c)[0] or now[0] == "C" and cp > 0x9F:
            continue
        table[cp] = {"L": LETTER, "N": NUMBER}.get(now[0], OTHER)
    table[SPACES] = SPACE
    return table


def byte_chars() -> np.ndarray:
    """The UTF-16 unit of the character that byte-level BPE writes for each byte: printable bytes stand for
    themselves, the others follow from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    table = np.arange(256, dtype="<u2")
    table[rest] = 256 + np.arange(len(rest))
    return table


class BatchBpe:
    """Encodes slices of texts with one tokenizer file of byte-level BPE."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.classes = char_classes()
        self.byte_chars = byte_chars()
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts joined, and each text's offset in them."""
        n = len(offsets) - 1
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        raw = buf.tobytes()
        slow = np.zeros(n, bool)
        for mark in self.special:
            at = raw.find(mark)
            while at >= 0:
                slow[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(mark, at + 1)
        try:
            points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        except UnicodeError:
            parts = [self._whole(raw[a:b].decode("utf-8", "replace")) for a, b in zip(offsets[:-1], offsets[1:])]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        byte_at = np.flatnonzero((buf & 0xC0) != 0x80)
        char_off = np.searchsorted(byte_at, offsets)
        kind = self.classes[points]
        odd = np.flatnonzero(kind == UNSURE)
        if len(odd):
            slow[np.searchsorted(char_off, odd, "right") - 1] = True
        starts = self._starts(points, kind, char_off)
        text_of = np.searchsorted(char_off, starts, "right") - 1
        span_a = byte_at[starts]
        span_b = np.append(span_a[1:], len(buf))
        if slow.any():
            fast = ~slow[text_of]
            starts, text_of, span_a, span_b = starts[fast], text_of[fast], span_a[fast], span_b[fast]
        ids, sizes = self._lookup(buf, span_a, span_b)
        per_text = np.bincount(text_of, sizes, minlength=n).astype(np.int64)
        off = np.concatenate([[0], np.cumsum(per_text)])
        if slow.any():
            parts = [self._whole(raw[offsets[i] : offsets[i + 1]].decode()) if slow[i] else ids[off[i] : off[i + 1]] for i in range(n)]
            ids, off = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, off

    def _starts(self, points: np.ndarray, kind: np.ndarray, char_off: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin: runs of letters, numbers or other signs, each with one
        space before it; white space otherwise; and the contractions 's 't 're 've 'm 'll 'd."""
        n = len(points)
        space = kind == SPACE
        first = np.zeros(n + 1, bool)
        first[char_off] = True
        head, last = first[:n], first[1:]
        prev = np.empty(n, np.uint8)
        prev[0], prev[1:] = SPACE, kind[:-1]
        prev_blank = np.empty(n, bool)
        prev_blank[0], prev_blank[1:] = False, points[:-1] == 0x20
        next_space = np.empty(n, bool)
        next_space[-1], next_space[:-1] = True, space[1:]
        start = np.where(space, (prev != SPACE) | ~(next_space | last), np.where(prev == SPACE, ~prev_blank, prev != kind))
        start |= head
        quote = np.flatnonzero((points == 0x27) & start)
        if len(quote):
            def at(d: int) -> np.ndarray:
                """Letters d places on, 0 beyond the text's end."""
                ok = quote + d < n
                for j in range(1, d + 1):
                    ok &= ~first[np.minimum(quote + j, n)]
                return np.where(ok, points[np.minimum(quote + d, n - 1)], 0)

            one, two = at(1), at(2)
            size = np.zeros(len(quote), np.int64)
            size[np.isin(one, [ord(c) for c in "stmd"])] = 2
            for pair in ("re", "ve", "ll"):
                size[(one == ord(pair[0])) & (two == ord(pair[1]))] = 3
            quote, size = quote[size > 0], size[size > 0]
            start[quote + 1] = False
            after = quote + size
            start[after[after < n]] = True
        return np.flatnonzero(start)

    def _lookup(self, buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, where, inverse = np.unique(kernels.span_hashes(buf, a, b), return_index=True, return_inverse=True)
        slot = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool) if not len(self.keys) else self.keys[np.minimum(slot, len(self.keys) - 1)] != keys
        if new.any():
            if len(self.keys) + new.sum() > CACHE_WORDS:
                self._forget()
                new[:] = True
            pick = where[new]
            mapped = self.byte_chars[buf].tobytes().decode("utf-16-le")
            tokenize = self.tokenizer.model.tokenize
            found = [[t.id for t in tokenize(mapped[x:y])] for x, y in zip(a[pick].tolist(), b[pick].tolist())]
            size = np.array([len(x) for x in found], np.int64)
            at = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, np.array([i for x in found for i in x], np.uint32)])
            order = np.argsort(merged := np.concatenate([self.keys, keys[new]]), kind="stable")
            self.keys = merged[order]
            self.at, self.size = np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]
        slot = np.searchsorted(self.keys, keys)
        size = self.size[slot][inverse]
        ids = self.ids[np.repeat(self.at[slot][inverse], size) + ragged_arange(size)]
        return ids, size
