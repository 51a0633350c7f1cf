"""Byte-level BPE ids of whole texts, with word splitting vectorised over code points.

The tokenizer's own pre-tokenization (contractions; runs of letters, digits or other
signs, each with a space before it; white space) is found for a block of texts at once,
each distinct word is encoded once a worker, and the ids are gathered by numpy.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache
from pathlib import Path

import numpy as np

from .common import KEPT, Rolling

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Words whose ids a worker keeps; the cache starts anew when it is full.
CACHE_WORDS = 30_000
#: Longer words aren't kept.
CACHE_CHARS = 64
#: Code points that are split at once.
BLOCK_CHARS = 1 << 16


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    import regex

    table = np.zeros(0x110000, np.uint8)
    every = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4").tobytes().decode("utf-32-le")
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            for a, b in ((m.start(), min(m.end(), 0xD800)), (max(m.start(), 0xD800), m.end())):
                if a < b:
                    shift = 0x800 if a >= 0xD800 else 0
                    table[a + shift : b + shift] = kind
    return table


def word_starts(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where words start, for the code points of several texts; begins: where (non-empty) texts start."""
    kind = char_classes()[points]
    n = len(points)
    first = np.zeros(n + 1, bool)
    first[begins] = True
    first[n] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last of the white space before a sign stands alone, or goes with the sign if it is a space.
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:n]) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 0x20]] = False
    # Contractions: an apostrophe that starts a word, with one of seven endings.
    mark = np.flatnonzero((points[:-2] == 0x27) & start[:-2] & ~first[1 : n - 1]) if n > 2 else np.zeros(0, np.int64)
    one, two = points[mark + 1], np.where(first[mark + 2], 0, points[mark + 2]) if len(mark) else np.zeros(0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for chosen, size in ((mark[short], 2), (mark[long & ~short], 3)):
        start[chosen + 1] = False
        end = chosen + size
        end = end[end < n]
        start[end[(kind[end] == LETTER)]] = True
    if n > 1 and points[n - 2] == 0x27 and start[n - 2] and not first[n - 1] and points[n - 1] in (0x73, 0x74, 0x6D, 0x64):  # s, t, m, d
        start[n - 1] = False
    return np.flatnonzero(start)


class WordIds:
    """Ids of a byte-level BPE vocabulary given as ranks: one array of ids and the number of ids of each text.

    encode(texts) gives an added token of the tokenizer's JSON file, which lies beside the ranks, its own id, as the
    tokenizer does; ids(texts) spells it out like other text.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.spell = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.cache: dict[str, bytes] = {}
        whole = Path(path).with_suffix(".json")
        self.added = {t["content"]: t["id"] for t in json.loads(whole.read_text())["added_tokens"]} if whole.exists() else {}
        self.at_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or "(?!)")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, owners, marks = [], [], []  # marks: (parts before it, text, id)
        for i, text in enumerate(texts):
            at = 0
            for m in self.at_added.finditer(text):
                parts.append(text[at : m.start()])
                owners.append(i)
                marks.append((len(parts), i, self.added[m[0]]))
                at = m.end()
            parts.append(text[at:] if at else text)
            owners.append(i)
        ids, sizes = self.ids(parts)
        if not marks:
            return ids, sizes
        counts = np.zeros(len(texts), np.int64)
        np.add.at(counts, owners, sizes)
        before, which, own = (np.array(c, np.int64) for c in zip(*marks, strict=True))
        np.add.at(counts, which, 1)
        return np.insert(ids, np.cumsum(sizes)[before - 1], own.astype(np.uint32)), counts

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out, counts = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        held, size = [], 0
        for i, text in enumerate(texts):
            for part in _parts(text):
                if size + len(part) > BLOCK_CHARS and held:
                    out.append(self._block(held, counts))
                    held, size = [], 0
                if part:
                    held.append((i, part))
                    size += len(part)
        if held:
            out.append(self._block(held, counts))
        return np.concatenate(out), counts

    def _block(self, held: list[tuple[int, str]], counts: np.ndarray) -> np.ndarray:
        text = "".join(part for _, part in held)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.cumsum([0, *(len(part) for _, part in held)])
        starts = word_starts(points, begins[:-1])
        ends = np.append(starts[1:], len(points))
        size = ends - starts
        # Equal words get one number: by hash first, then every word is compared with the one it is taken for.
        keys = Rolling(points).span(starts, ends)
        _, at, which = np.unique(keys, return_index=True, return_inverse=True)
        if (points[np.repeat(starts[at][which] - starts, size) + np.arange(len(points))] != points).any():
            words = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            number = {w: k for k, w in enumerate(dict.fromkeys(words))}
            which = np.array([number[w] for w in words])
            at = np.unique(which, return_index=True)[1]
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        found = []
        for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True):
            ids = cache.get(word := text[a:b])
            if ids is None:
                ids = np.array(self.spell(word.encode("utf-8", "replace")), np.uint32).tobytes()
                if b - a <= CACHE_CHARS:
                    cache[word] = ids
            found.append(ids)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        base = np.cumsum(size) - size
        n = size[which]
        total = np.cumsum(n)
        gathered = np.frombuffer(b"".join(found), np.uint32)[np.repeat(base[which] - (total - n), n) + np.arange(n.sum())]
        upto = np.concatenate([[0], total])[np.searchsorted(starts, begins)]
        np.add.at(counts, [i for i, _ in held], np.diff(upto))
        return gathered


def _parts(text: str):
    """A very long text in parts; it is cut before a space between two letters, where words part in any case."""
    at = 0
    while len(text) - at > 2 * BLOCK_CHARS and (m := re.compile("(?<=[a-z]) (?=[a-z])").search(text, at + BLOCK_CHARS)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


KEPT["words"] = word_ids.cache_clear
