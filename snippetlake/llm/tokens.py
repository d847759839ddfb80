"""Token ids of whole texts by the ``tokenizers`` library, each distinct piece of text encoded once.

Both public vocabularies split a text before they merge, and never merge across white space. So a text
is cut at white space, distinct pieces are encoded by the library and kept in a bounded memo, and the
ids are put together again. Texts whose white space is not of the plain kind handled here go to the
library whole; either way the ids are those of the whole text.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces remembered by one Python worker; the memo starts anew beyond that.
MEMO_PIECES = 500_000
#: Pieces that the library encodes as one text, with a token between them that none of them holds; the few that
#: hold it, and those of a text whose marks do not come back one by one, are encoded alone.
JOINED = 256
#: Any white space but single spaces and line ends between other characters, and the cut mark itself.
ODD = "\\x00|[ \\n][ \\n]|[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: The same for a vocabulary that drops white space: only the cut mark is in the way.
MARK = "\\x00"


class Encoder:
    """One vocabulary file. ``keeps_space``: white space belongs to tokens (byte-level kind)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker per core already
        self.library = Tokenizer.from_file(path)
        self.keeps_space = self.library.normalizer is None
        self.mark = "\n" if self.keeps_space else " | "
        self.mark_id = self.library.encode(self.mark, add_special_tokens=False).ids[0]
        self._restart()

    def _restart(self) -> None:
        self.codes: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(1 << 16, np.uint16), np.zeros(1 << 16, np.int64)
        self.starts, self.used = np.zeros(1 << 16, np.int64), 0

    def _learn(self, pieces: list[str]) -> None:
        mark = self.mark.strip(" ")
        plain = [x for x in pieces if x and mark not in x and not x.isspace()]
        rows = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        flat, count, fits = [], [], []
        for row, e in zip(rows, self.library.encode_batch_fast([self.mark.join([*x, ""]) for x in rows], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint16)
            ends = np.flatnonzero(ids == self.mark_id)
            if len(ends) == len(row) and ends[-1] == len(ids) - 1:
                fits += row
                count.append(np.diff(ends, prepend=-1) - 1)
                flat.append(np.delete(ids, ends))
        known = set(fits) if len(fits) < len(pieces) else ()
        alone = [x for x in pieces if x not in known] if len(fits) < len(pieces) else []
        for e in self.library.encode_batch_fast(alone, add_special_tokens=False):
            ids = np.array(e.ids, np.uint16)
            count.append(np.array([len(ids)], np.int64))
            flat.append(ids)
        pieces, flat, sizes = fits + alone, np.concatenate(flat), np.concatenate(count)
        n, m = len(self.codes), len(flat)
        while self.used + m > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(pieces) > len(self.sizes):
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.used : self.used + m] = flat
        self.sizes[n : n + len(pieces)] = sizes
        self.starts[n : n + len(pieces)] = self.used + np.cumsum(sizes) - sizes
        self.used += m
        self.codes.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def _pieces(self, texts: pa.Array) -> pa.ListArray:
        if not self.keeps_space:
            return pc.ascii_split_whitespace(texts)
        return pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\x00 "), "\n", "\x00\n\x00"), "\x00")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (uint16) of all texts and the bounds of each text; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, ODD if self.keeps_space else MARK).to_numpy(zero_copy_only=False)
        lists = self._pieces(pc.if_else(pa.array(odd), "", texts))
        pieces, bounds = lists.flatten().dictionary_encode(), lists.offsets.to_numpy()
        bounds = bounds - bounds[0]
        distinct = pieces.dictionary.to_pylist()
        if len(self.codes) + len(distinct) > MEMO_PIECES:
            self._restart()
        codes = self.codes
        fresh = [x for x in distinct if x not in codes]
        if fresh:
            self._learn(fresh)
        table = np.fromiter(map(codes.__getitem__, distinct), np.int64, len(distinct))
        which = table[pieces.indices.to_numpy()]
        sizes = self.sizes[which]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.starts[which] - ends[:-1], sizes)
        at += np.arange(len(at))
        flat, cuts = self.ids[at], ends[bounds]
        if odd.any():
            whole = self.library.encode_batch_fast(texts.filter(pa.array(odd)).to_pylist(), add_special_tokens=False)
            parts = np.split(flat, cuts[1:-1])
            for i, e in zip(np.flatnonzero(odd), whole, strict=True):
                parts[i] = np.array(e.ids, np.uint16)
            flat = np.concatenate(parts)
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return flat, cuts


@functools.cache
def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    return Encoder(path)


def forget() -> None:
    """Free what a worker remembers of tokens, for other work that comes to the same worker."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        pa.default_memory_pool().release_unused()


def with_end(flat: np.ndarray, cuts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end`` after each text."""
    return np.insert(flat, cuts[1:], end), cuts + np.arange(len(cuts))
