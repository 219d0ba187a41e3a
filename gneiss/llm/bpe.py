"""Byte-pair encoding: vectorised pre-tokenisation, two exact word encoders, offset-table decoding.

Both encoders work on the distinct words of a slice only.  Words are found with array operations on
code points, named by 64-bit hashes and looked up in a table of ids kept per Python worker, so the
cost per repeated word is a few array elements.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import cached_property, lru_cache
from itertools import pairwise

import ahocorasick
import numpy as np

from gneiss.llm.base import span_hashes, splitmix

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
NEVER = 1 << 30

# The code points with Unicode's White_Space property.
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# English contractions that both published patterns list.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


@lru_cache(1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[WHITE_SPACE] = SPACE
    return table, splitmix(np.arange(1, sys.maxunicode + 2, dtype=np.uint64))


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.path, self.suffix = path, model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        vocab = model["vocab"]
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], dtype=np.int64)  # of a byte within a word
        self.last = np.array([vocab[c + self.suffix] for c in letters], dtype=np.int64)  # of a word's last byte
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed([*enumerate(pairs)])}
        value = {c: b for b, c in enumerate(letters)}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(value[c] for c in token[: len(token) - len(self.suffix)] if c in value) if self.suffix and token.endswith(self.suffix) else bytes(value[c] for c in token if c in value)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


# ---------------------------------------------------------------- pre-tokenisation


def pretokens(points: np.ndarray, doc_start: np.ndarray, doc_end: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of concatenated texts.

    spaced: words take one leading blank and white space is kept (runs of letters, of numbers, of
    other signs); else white space is dropped and each numeral is a word.  A lone apostrophe takes a
    contraction's letters in both.
    """
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _classes()[0][points]
    new = np.empty(n, dtype=bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[doc_start[doc_start < n]] = True
    if not spaced:
        new |= kind == NUMBER
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    what = kind[start]
    closes = np.zeros(n + 1, dtype=bool)
    closes[doc_end] = True
    joined = np.zeros(len(start), dtype=bool)  # has a blank in front
    if spaced:
        gap = np.flatnonzero((what == SPACE) & ~closes[end])  # followed by a word
        final = points[end[gap] - 1]
        blank = gap[final == 0x20]
        joined[blank + 1] = True
    # contractions: an apostrophe alone, no blank attached, letters of the same text after it
    lone = np.flatnonzero((points[start] == 0x27) & (end - start == 1) & ~joined & ~closes[end])
    lone = lone[what[lone + 1] == LETTER] if len(lone) else lone
    if len(lone):
        room = end[lone + 1] - start[lone + 1]
        a = points[start[lone + 1]]
        b = np.where(room > 1, points[np.minimum(start[lone + 1] + 1, n - 1)], 0)
        takes = np.zeros(len(lone), dtype=np.int64)
        for c in CONTRACTIONS:
            fits = (a == ord(c[0])) & ((len(c) == 1) | (b == ord(c[-1])))
            takes = np.where((takes == 0) & fits, len(c), takes)
        lone, takes = lone[takes > 0], takes[takes > 0]
        end[lone] += takes
        start[lone + 1] += takes
    if spaced:
        start[joined] -= 1
        end[blank] -= 1
        alone = gap[final != 0x20]  # the last white space stands alone when more goes before
        alone = alone[end[alone] - start[alone] > 1]
        extra_start, extra_end = end[alone] - 1, end[alone].copy()
        end[alone] -= 1
        start, end = np.concatenate([start, extra_start]), np.concatenate([end, extra_end])
        order = np.argsort(start, kind="stable") if len(alone) else slice(None)
        start, end = start[order], end[order]
        keep = end > start
    else:
        keep = (end > start) & (what != SPACE)
    return start[keep], end[keep]


# ---------------------------------------------------------------- word encoders


class MergeEncoder:
    """Encodes many words at once: a matrix of symbols, the lowest-ranked pair of each row merged per round."""

    WIDTHS = (4, 8, 12, 16, 24, 32, 48, 64)  # of matrices; words of more bytes go to the library
    SYMBOLS = 200_000  # of a matrix

    def __init__(self, v: Vocabulary):
        self.v = v
        pair = np.array([(a * v.size + b, r, t) for (a, b), (r, t) in v.merges.items()], dtype=np.int64).reshape(-1, 3)
        pair = pair[np.argsort(pair[:, 0])]
        self.keys, self.ranks, self.made = (np.ascontiguousarray(pair[:, i]) for i in range(3))

    @cached_property
    def library(self):
        """For words beyond all widths; loaded when the first is met."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.v.path)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = np.where((a < 0) | (b < 0), -1, a * self.v.size + b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, NEVER)

    def encode(self, words: list[str]) -> list[np.ndarray]:
        raw = [w.encode() for w in words]
        out: list = [None] * len(raw)
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        for i in np.flatnonzero(length > self.WIDTHS[-1]):
            out[i] = np.array(self.library.encode(words[i], add_special_tokens=False).ids, dtype=np.int32)
        for low, width in pairwise((-1, *self.WIDTHS)):
            group = np.flatnonzero((length > low) & (length <= width))
            step = max(1, self.SYMBOLS // width)
            for some in (group[a : a + step] for a in range(0, len(group), step)):
                block = np.zeros((len(some), width), np.uint8)
                block[np.arange(width)[None, :] < length[some, None]] = np.frombuffer(b"".join(raw[i] for i in some), np.uint8)
                for i, ids in zip(some, self._rows(block, length[some]), strict=True):
                    out[i] = ids
        return out

    def _rows(self, block: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        n, width = block.shape
        index = np.arange(width)[None, :]
        symbols = np.where(index < length[:, None] - 1, self.v.first[block], np.where(index == length[:, None] - 1, self.v.last[block], -1))
        length = length.copy()
        # entries of the pair table, in the order of ranks
        order = np.append(self.ranks, NEVER)
        found = self.rank(symbols[:, :-1], symbols[:, 1:]) if width > 1 else np.zeros((n, 0), np.int64)
        found = np.where(found == NEVER, len(self.keys), found)
        rows = np.arange(n)
        while width > 1 and len(rows):
            ranks = order[found[rows]]
            at = ranks.argmin(axis=1)
            live = ranks[np.arange(len(rows)), at] < NEVER
            rows, at = rows[live], at[live]
            if not len(rows):
                break
            s, f = symbols[rows], found[rows]
            s[np.arange(len(rows)), at] = self.made[f[np.arange(len(rows)), at]]
            shift = np.minimum(index + (index > at[:, None]), width - 1)
            s = np.take_along_axis(s, shift, axis=1)
            length[rows] -= 1
            s[:, -1] = np.where(length[rows] < width, -1, s[:, -1])
            f = np.take_along_axis(f, shift[:, : width - 1].clip(max=width - 2), axis=1)
            f[np.arange(width - 1)[None, :] >= (length[rows] - 1)[:, None]] = len(self.keys)
            for side in (at - 1, at):
                ok = np.flatnonzero((side >= 0) & (side < length[rows] - 1))
                r = self.rank(s[ok, side[ok]], s[ok, side[ok] + 1])
                f[ok, side[ok]] = np.where(r == NEVER, len(self.keys), r)
            symbols[rows], found[rows] = s, f
        return [row[:k].astype(np.int32) for row, k in zip(symbols, length, strict=True)]


class BacktrackingEncoder:
    """Exact merges in linear time.  An Aho-Corasick automaton gives the longest token that starts at
    each byte; a token may follow another if their bytes together would merge into just these two;
    where none fits, the previous token is given back and its place never tried again."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.automaton = ahocorasick.Automaton()
        special = set(v.special.values())
        self.length = [len(b) for b in v.bytes]
        texts = {b.decode("latin-1"): i for i, b in enumerate(v.bytes) if b and i not in special}
        for t, i in texts.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.shorter = [-1] * v.size
        for t, i in texts.items():
            self.shorter[i] = next((texts[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in texts), -1)
        self.parts = {t: (rank, pair) for pair, (rank, t) in v.merges.items()}
        self.spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.table: dict[int, bool] = {}  # the pair-compatibility table, filled as pairs are met

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that hold this edge of the token while it is built: (token, rank that made it)."""
        got = self.spines.get((token, side))
        if got is None:
            got, t = [], token
            while t in self.parts:
                got.append((t, self.parts[t][0]))
                t = self.parts[t][1][side]
            got = [(t, -1), *reversed(got)]
            self.spines[token, side] = got
        return got

    def follows(self, a: int, b: int) -> bool:
        """Whether b may stand after a: in the order of ranks, no merge crosses their seam before
        the edge tokens on both sides have grown into a and b."""
        key = a * self.v.size + b
        known = self.table.get(key)
        if known is not None:
            return known
        left, right, i, j, fits = self.spine(a, 1), self.spine(b, 0), 0, 0, True
        while True:
            grow_left = left[i + 1][1] if i + 1 < len(left) else NEVER
            grow_right = right[j + 1][1] if j + 1 < len(right) else NEVER
            across = self.v.merges.get((left[i][0], right[j][0]), (NEVER, 0))[0]
            if across < grow_left and across <= grow_right and across < NEVER:
                fits = False
                break
            if grow_left == grow_right == NEVER:
                break
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1
        if len(self.table) > 500_000:
            self.table.clear()
        self.table[key] = fits
        return fits

    def word(self, raw: bytes) -> list[int]:
        text = raw.decode("latin-1")
        n = len(text)
        longest = [-1] * n
        length = self.length
        for at, token in self.automaton.iter(text):
            s = at - length[token] + 1
            if longest[s] < 0 or length[token] > length[longest[s]]:
                longest[s] = token
        out: list[int] = []
        dead = bytearray(n + 1)
        pos, token = 0, longest[0]
        while True:
            end = pos + length[token]
            if not dead[end] and (not out or self.follows(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                pos, token = end, longest[end]
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                dead[pos] = 1
                token = out.pop()
                pos -= length[token]

    def encode(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(self.word(w.encode()), dtype=np.int32) for w in words]


# ---------------------------------------------------------------- texts


class TextEncoder:
    """Encodes slices of texts; keeps the ids of about `keep` words (beyond them, of those that came in
    more than one slice, or none where these are too many)."""

    def __init__(self, v: Vocabulary, words, spaced: bool, normalise=None, keep: int = 300_000):
        self.v, self.words, self.spaced, self.normalise, self.keep = v, words, spaced, normalise, keep
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.filled, self.entries = np.zeros(1 << 20, np.int32), 0, 0
        self.used = np.zeros(0, np.int32)

    def _forget_rare(self) -> None:
        often = np.flatnonzero(self.used[self.slot] > 1)
        if len(often) > self.keep // 2:
            return self._forget()
        slot = self.slot[often]
        count, end = self.count[slot], np.cumsum(self.count[slot])
        total = int(end[-1]) if len(end) else 0
        ids = self.ids[np.repeat(self.begin[slot] - (end - count), count) + np.arange(total)]
        keys = self.keys[often]
        self._forget()
        self.ids = np.concatenate([ids, self.ids])
        self.keys, self.slot, self.begin, self.count = keys, np.arange(len(keys)), end - count, count
        self.used, self.filled, self.entries = np.ones(len(keys), np.int32), total, len(keys)

    def _learn(self, keys: np.ndarray, words: list[str], where: np.ndarray) -> None:
        got = self.words.encode(words)
        count = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.concatenate(got) if got else np.zeros(0, np.int32)
        while self.filled + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.filled : self.filled + len(flat)] = flat
        self.begin = np.concatenate([self.begin, self.filled + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.used = np.concatenate([self.used, np.zeros(len(keys), np.int32)])
        self.slot = np.insert(self.slot, where, self.entries + np.arange(len(keys)))
        self.keys = np.insert(self.keys, where, keys)
        self.filled += len(flat)
        self.entries += len(keys)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts one after another, and the len(texts) + 1 offsets of each text's ids."""
        if self.v.split_special and any(self.v.split_special.search(t) for t in texts):
            return self._with_special(texts)
        if self.normalise:
            texts = [self.normalise(t) for t in texts]
        if self.entries > self.keep:
            self._forget_rare()
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        doc_end = np.cumsum(size)
        doc_start = doc_end - size
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        start, end = pretokens(points, doc_start, doc_end, self.spaced)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        key, first, which = np.unique(span_hashes(_classes()[1][points], start, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, key)
        known = np.zeros(len(key), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == key[inside]
        if not known.all():
            new = first[~known]
            self._learn(key[~known], [whole[a:b] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)], at[~known])
            at = np.searchsorted(self.keys, key)
        slot = self.slot[at]
        self.used[slot] += 1
        slot = slot[which]
        count = self.count[slot]
        total = np.cumsum(count)
        ids = self.ids[np.repeat(self.begin[slot] - (total - count), count) + np.arange(total[-1])]
        words_before = np.searchsorted(start, np.append(doc_start, len(points)))
        return ids, np.concatenate([[0], total])[words_before]

    def _with_special(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, owner, fixed = [], [], []
        for i, t in enumerate(texts):
            for p in self.v.split_special.split(t):
                special = self.v.special.get(p, -1)
                parts.append("" if special >= 0 else p)
                owner.append(i)
                fixed.append(special)
        plain = TextEncoder.__call__
        split, self.v.split_special = self.v.split_special, None
        try:
            ids, offset = plain(self, parts)
        finally:
            self.v.split_special = split
        fixed_ids = np.array(fixed)
        count = np.diff(offset) + (fixed_ids >= 0)
        to = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        is_special = np.zeros(len(out), bool)
        is_special[to[fixed_ids >= 0]] = True
        out[is_special] = fixed_ids[fixed_ids >= 0]
        out[~is_special] = ids
        per_text = np.bincount(np.array(owner), weights=count, minlength=len(texts)).astype(np.int64)
        return out, np.concatenate([[0], np.cumsum(per_text)])


class Decoder:
    """Token bytes in one buffer, found by an offset table."""

    def __init__(self, v: Vocabulary):
        self.offset = np.concatenate([[0], np.cumsum([len(b) for b in v.bytes])]).astype(np.int64)
        self.buffer = np.frombuffer(b"".join(v.bytes), np.uint8)

    def __call__(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        begin, count = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        total = np.concatenate([[0], np.cumsum(count)])
        out = self.buffer[np.repeat(begin - total[:-1], count) + np.arange(total[-1])].tobytes()
        cut = total[bounds].tolist()
        return [out[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:], strict=False)]


def lowered(text: str) -> str:
    """Composed (NFC) and lower case, character by character (no final sigma)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@lru_cache(4)
def text_encoder(path: str, backtracking: bool) -> TextEncoder:
    """One encoder per Python worker and vocabulary."""
    v = vocabulary(path)
    words = BacktrackingEncoder(v) if backtracking else MergeEncoder(v)
    return TextEncoder(v, words, spaced=not v.suffix, normalise=lowered if v.suffix else None, keep=900_000 if backtracking else 300_000)


@lru_cache(4)
def decoder(path: str) -> Decoder:
    return Decoder(vocabulary(path))
