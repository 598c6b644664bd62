"""Token ids of a byte-level BPE, at the speed of its distinct pieces.

The pre-tokeniser of such a vocabulary never joins characters across the edge of
a run of white space, save that a word takes one space before it. A text thus
splits into pieces that are encoded each on its own; every distinct piece goes
through the tokenizers library once, and repeated pieces cost a lookup by hash. The ids of such a
vocabulary spell out the text's bytes, so every text's ids are held against its bytes; a text with a piece whose hash
another one shares is encoded whole, as are texts with white space or control characters outside ASCII's usual six.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from certame.llm.kernels import SPACE, quick_hash, text_hash

#: Pieces kept between batches by a Python worker; beyond it the memory starts anew.
KEEP_PIECES = 3_000_000
WHITE = " \t\n\v\f\r"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str) -> "PieceEncoder":
    return PieceEncoder(path)


def pieces(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the pieces of all rows, in order.

    Of a run of white space before a word, the last character stands alone, or,
    if it is a space, goes with the word; what is before it is one piece. A run at a row's end is one piece.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    row_end = np.zeros(n, dtype=bool)
    row_end[at[1:][at[1:] > 0] - 1] = True
    before_word = np.zeros(n, dtype=bool)
    before_word[:-1] = space[:-1] & ~space[1:]
    before_word &= ~row_end
    glued = before_word & (data == 0x20)
    #: A piece starts at each row, at a run's first character, at the run's last one before a word, and after one that isn't a space.
    edge[1:n] |= space[1:] & ~space[:-1]
    edge[:n] |= before_word
    edge[1:n] |= (before_word & ~glued)[:-1]
    start = np.flatnonzero(edge[:n])
    return start, np.append(start[1:], n)


def odd_rows(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows with white space beyond ASCII's six or with the separators 1C-1F."""
    odd = (data >= 0x1C) & (data <= 0x1F)
    two = data[:-1] == 0xC2
    odd[:-1] |= two & ((data[1:] == 0x85) | (data[1:] == 0xA0))
    if len(data) > 2:
        a, b, c = data[:-2], data[1:-1], data[2:]
        odd[:-2] |= ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xE1) & (b == 0xA0) & (c == 0x8E))
        odd[:-2] |= (a == 0xE2) & (((b == 0x80) & (((c >= 0x80) & (c <= 0x8F)) | ((c >= 0xA8) & (c <= 0xAF)))) | ((b == 0x81) & (c == 0x9F)))
    return np.unique(np.searchsorted(at, np.flatnonzero(odd), side="right") - 1)


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary: printable ones for themselves, all others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class PieceEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(vocabulary.values()) + 2, dtype=np.int64)
        for token, i in vocabulary.items():  # one character stands for one byte
            self.width[i] = len(token)
        self.spelt_at = np.append(0, np.cumsum(self.width))
        byte_of = {c: b for b, c in byte_characters().items()}
        self.spelt = np.zeros(int(self.spelt_at[-1]), dtype=np.uint8)
        for token, i in vocabulary.items():
            self.spelt[self.spelt_at[i] : self.spelt_at[i + 1]] = [byte_of.get(c, 0) for c in token]
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.begin = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """keys: sorted and new. Words with their space are encoded many at a time, and told apart by their tokens' bytes."""
        glued = np.fromiter((len(x) > 1 and x[0] == " " and x[1] not in WHITE for x in texts), dtype=bool, count=len(texts))
        which = np.append(np.flatnonzero(glued), np.flatnonzero(~glued))
        cuts = [*range(0, int(glued.sum()), 512)]
        joined = ["".join(texts[i] for i in which[lo : min(lo + 512, int(glued.sum()))]) for lo in cuts]
        joined += [texts[i] for i in which[int(glued.sum()) :]]
        flat = np.concatenate([np.array(x.ids, dtype=np.uint32) for x in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        bytes_to = np.cumsum(self.width[flat])
        piece_to = np.cumsum(np.fromiter((len(texts[i].encode()) for i in which), dtype=np.int64, count=len(which)))
        stop = np.searchsorted(bytes_to, piece_to) + 1
        count, begin = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        count[which] = np.diff(stop, prepend=0)
        begin[which] = stop - np.diff(stop, prepend=0) + len(self.ids)
        where = np.searchsorted(self.keys, keys)
        self.keys, self.begin, self.count = np.insert(self.keys, where, keys), np.insert(self.begin, where, begin), np.insert(self.count, where, count)
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and the offset of each row's first one."""
        start, end = pieces(data, at)
        key = quick_hash(text_hash(data), start, end)
        distinct, first, back = np.unique(key, return_index=True, return_inverse=True)
        missing = ~np.isin(distinct, self.keys, assume_unique=True) if len(self.keys) else np.ones(len(distinct), bool)
        if missing.any():
            raw = data.tobytes()
            if len(self.keys) + int(missing.sum()) > KEEP_PIECES:
                self.forget()
                missing[:] = True
            # a piece is cut at ASCII only, so it is whole characters
            self.learn(distinct[missing], [raw[a:b].decode() for a, b in zip(start[first[missing]].tolist(), end[first[missing]].tolist(), strict=True)])
        slot = np.searchsorted(self.keys, distinct)[back]
        count = self.count[slot]
        stop = np.cumsum(count)
        ids = self.ids[np.repeat(self.begin[slot] - (stop - count), count) + np.arange(int(stop[-1]) if len(stop) else 0)]
        rows = np.append(0, stop)[np.searchsorted(start, at)]
        odd = odd_rows(data, at) if len(data) else np.zeros(0, np.int64)
        odd = np.union1d(odd, self._misspelt(data, at, ids, rows))
        if len(odd):
            ids, rows = self._whole(data, at, ids, rows, odd)
        return ids, rows

    def _misspelt(self, data: np.ndarray, at: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Rows whose ids do not spell out their bytes."""
        width = self.width[ids]
        stop = np.append(0, np.cumsum(width))
        spelt = self.spelt[np.repeat(self.spelt_at[ids] - stop[:-1], width) + np.arange(int(stop[-1]))]
        if np.array_equal(spelt, data):
            return np.zeros(0, np.int64)
        return np.array([r for r in range(len(at) - 1) if not np.array_equal(spelt[stop[rows[r]] : stop[rows[r + 1]]], data[at[r] : at[r + 1]])], dtype=np.int64)

    def _whole(self, data, at, ids, rows, odd):
        parts = [ids[a:b] for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
        for r in odd.tolist():
            parts[r] = np.array(self.tokenizer.encode(data[at[r] : at[r + 1]].tobytes().decode(), add_special_tokens=False).ids, dtype=np.uint32)
        return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
