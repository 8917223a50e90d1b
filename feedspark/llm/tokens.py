"""Ids of whole texts by a public tokenizer, with a memory of pieces.

Both vocabularies cut a text into words and marks before any merge, and no merge crosses a cut, so a text's ids are
those of its pieces one after the other. A piece begins where every such tokenizer parts a text whatever stands around:

* at a blank with a visible character behind it (the blank belongs to the word that follows);
* at a single line feed between visible ASCII characters, and behind it;
* at a full stop or comma behind an ASCII letter or digit.

All pieces of a chunk are found, hashed and looked up at once in numpy; only pieces that the worker doesn't remember
are encoded, each once a chunk, by the `tokenizers` library: JOINED of them in one call, parted by a special token, because the library
cuts a text at special tokens before anything else and takes what lies between as texts of their own. A text that holds `<|`, with
which special tokens begin, is one piece and one call, so that it gets the very ids of a plain library call.

The memory has a fixed number of slots; a piece takes the slot that its hash names and replaces what was there, so a
worker's memory never grows. Pieces of more than LONG bytes or WIDTH ids aren't remembered. Pieces are told apart by 64-bit
hashes: two different pieces in one slot are confused with a chance of 2^-64.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np

from feedspark.llm import common as C

SLOTS = 1 << 20
WIDTH = 8
LONG = 64
#: Pieces that go to the library in one call.
JOINED = 64
#: Single bytes that are visible for sure: ASCII marks, and first bytes of characters none of which is white space.
_SEEN = np.zeros(256, bool)
_SEEN[0x21:0x7F] = True
_SEEN[0xC3:0xE1] = True
_SEEN[0xE4:0xF5] = True
_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _WORD[_a:_b] = True
_STOP = np.zeros(256, bool)
_STOP[[0x2C, 0x2E]] = True


def piece_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where the pieces of a chunk's texts begin, in order; an empty text has none."""
    n = len(data)
    first = offs[:-1][offs[1:] > offs[:-1]]
    if not n:
        return first
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    seen = _SEEN[data]
    mark = seen & (data < 0x80)
    begin = np.zeros(n, bool)
    begin[:-1] = (data[:-1] == 0x20) & seen[1:] & ~edge[1:n]
    begin[1:] |= _STOP[data[1:]] & _WORD[data[:-1]]
    feed = np.flatnonzero(data[1:-1] == 0x0A) + 1
    feed = feed[mark[feed - 1] & seen[feed + 1] & ~edge[feed] & ~edge[feed + 1]]
    begin[feed] = True
    begin[feed + 1] = True
    special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
    for doc in np.unique(np.searchsorted(offs, special, "right") - 1):
        begin[offs[doc] : offs[doc + 1]] = False
    begin[first] = True
    return np.flatnonzero(begin)


class PieceEncoder:
    """Ids of the texts of a chunk."""

    def __init__(self, path: str, slots: int = SLOTS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = ((i, x) for i, x in sorted(self.tokenizer.get_added_tokens_decoder().items()) if x.special and x.content.startswith("<|"))
        self.mark_id, self.mark = next(((i, x.content) for i, x in special if not (x.lstrip or x.rstrip or x.single_word or x.normalized)), (None, None))
        self.shift = np.uint64(64 - (slots.bit_length() - 1))
        self.keys = np.zeros(slots, np.uint64)
        self.sizes = np.zeros(slots, np.uint8)
        self.ids = np.zeros((slots, WIDTH), np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)

    def _library(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the strings, each as a text of its own, one after the other, and the number of each one's ids."""
        groups: list[list[str]] = []
        room = 0
        for s in strings:
            if self.mark is None or "<|" in s:
                groups.append([s])
                room = 0
            elif room:
                groups[-1].append(s)
                room -= 1
            else:
                groups.append([s])
                room = JOINED - 1
        found = self.tokenizer.encode_batch_fast([g[0] if len(g) == 1 else self.mark.join(g) for g in groups], add_special_tokens=False)
        pool, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for g, x in zip(groups, found, strict=True):
            ids = np.array(x.ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark_id) if len(g) > 1 else np.zeros(0, np.int64)
            pool.append(np.delete(ids, cuts))
            sizes.append(np.diff(cuts, prepend=-1, append=len(ids)) - 1)
        return np.concatenate(pool), np.concatenate(sizes)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and offsets of texts -> ids (unsigned 32-bit) and the offset of each text's ids."""
        starts = piece_starts(data, offs)
        ends = np.append(starts[1:], len(data))
        size = ends - starts
        hashes = C.spans_hash(data, starts, ends) | np.uint64(1)
        slot = (hashes >> self.shift).astype(np.int64)
        hit = (self.keys[slot] == hashes) & (size <= LONG)
        count = np.where(hit, self.sizes[slot], 0).astype(np.int64)
        missed = np.flatnonzero(~hit)
        long = missed[size[missed] > LONG]
        short = missed[size[missed] <= LONG]
        _, first, inverse = np.unique(hashes[short], return_index=True, return_inverse=True)
        new = np.concatenate([short[first], long])
        raw = data.tobytes() if len(new) else b""
        pool, sizes = self._library([raw[starts[i] : ends[i]].decode() for i in new.tolist()])
        begins = np.cumsum(sizes) - sizes
        which = np.empty(len(starts), np.int64)  # of a missed piece: its place among the new ones
        which[short], which[long] = inverse, np.arange(len(first), len(new))
        count[missed] = sizes[which[missed]]
        total = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        out = np.empty(total[-1], np.uint32)
        for rows, flat, base in ((np.flatnonzero(hit), self.ids.ravel(), slot * WIDTH), (missed, pool, None)):
            own = count[rows]
            to = np.cumsum(own) - own
            step = np.arange(own.sum()) - np.repeat(to, own)
            source = base[rows] if base is not None else begins[which[rows]]
            out[np.repeat(total[:-1][rows], own) + step] = flat[np.repeat(source, own) + step]
        keep = np.flatnonzero(sizes[: len(first)] <= WIDTH)
        at = slot[new[keep]]
        self.keys[at] = hashes[new[keep]]
        self.sizes[at] = sizes[keep]
        wide = np.zeros((len(keep), WIDTH), self.ids.dtype)
        own = sizes[keep]
        step = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        wide[np.repeat(np.arange(len(keep)), own), step] = pool[np.repeat(begins[keep], own) + step]
        # two new pieces may name one slot; the last of them takes it in all three tables
        self.ids[at] = wide
        return out, total[np.searchsorted(starts, offs)]


@cache
def encoder(path: str) -> PieceEncoder:
    """The worker's encoder; it stays from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PieceEncoder(path)
