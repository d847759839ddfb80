"""Substring dedup by recompression.

Rounds rename runs of equal symbols, then pairs of a *left* and a *right* symbol, to new symbols. A name
is a fingerprint of what it stands for and the side a symbol is on is a bit of its name, so names
and sides are global: every task gives equal sequences the same symbols, except for those that
touch a border. For a window of words the symbols that cannot depend on what surrounds the window are
known by a rule that looks only at the window; its anchor is the longest of them, of equally long
ones that of least hash, or the window itself where none is left. Equal windows therefore have equal anchors.

1. Anchors of all texts are counted across the table (combined before the shuffle).
2. Windows are taken up only where their anchor occurs more than once. Their 128-bit fingerprints
   are grouped, and those that occur more than once are repeats.
3. Words covered by a repeat go.

Equal texts are met once: a text that several rows have is a repeat as a whole. Windows are judged on
the input. Defined cases: null text has no words; texts shorter than a window lose
nothing; repeated rows are repeats of each other; an empty table gives no rows; keys may be null or
repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snippetlake.llm import words
from snippetlake.llm.tokenout import slices
from snippetlake.session import cut

WINDOW = 35
#: Rounds on symbols: runs first, since a pair has two sides. After five pair rounds a symbol stands for
#: about four words, and a window keeps about five that do not depend on what surrounds it.
ROUNDS = ("runs", "pairs", "pairs", "runs", "pairs", "pairs", "pairs")


def anchors(hashes: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each whole window of the flat texts: first word, name of the anchor, and place of the anchor
    (windows with the same anchor occurrence have the same place)."""
    n = len(hashes)
    sizes = np.diff(bounds)
    count = np.maximum(sizes - window + 1, 0)
    first = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    if not len(first):
        return first, np.zeros(0, np.uint64), first
    names, start = hashes.copy(), np.arange(n)
    left, right = first.copy(), first + window
    begins = np.zeros(n + 1, bool)
    begins[bounds[:-1]] = True
    with np.errstate(over="ignore"):
        for k, kind in enumerate(ROUNDS):
            inside = ~begins[start]  # has a symbol before it in its text
            if kind == "runs":
                head = np.ones(len(names), bool)
                head[1:] = (names[1:] != names[:-1]) | ~inside[1:]
                at = np.flatnonzero(head)
                length = np.diff(np.append(at, len(names)))
                run = np.cumsum(head) - 1
                stops = np.append(start, n)
                to_right, to_left = stops[np.append(at, len(names))[run + 1]], start[at[run]]
                new = np.where(length > 1, words.mix(names[at] * np.uint64(3) + length.astype(np.uint64), 20 + k), names[at])
            else:
                is_left = (words.mix(names, 40 + k) & np.uint64(1)).astype(bool)
                stops = np.append(start, n)
                to_right = np.where(is_left, start, stops[1:])
                to_left = np.where(is_left, start, stops[1:])
                joined = np.zeros(len(names), bool)
                joined[:-1] = is_left[:-1] & ~is_left[1:] & inside[1:]
                gone = np.append(False, joined[:-1])
                at = np.flatnonzero(~gone)
                new = names[at].copy()
                pair = joined[at]
                both = at[pair]
                new[pair] = words.mix(names[both] * np.uint64(0x9E3779B97F4A7C15) + names[both + 1] * np.uint64(0xC2B2AE3D27D4EB4F), 60 + k)
            symbol = np.zeros(n + 1, np.int64)  # of a border between symbols: the one that begins there
            symbol[start] = np.arange(len(names))
            symbol[n] = len(names)
            ahead = np.append(to_right, n)
            left = ahead[symbol[left]]
            behind = np.append(0, to_left)  # of a border: what the symbol before it becomes
            right = behind[symbol[right]]
            names, start = new, start[at]
    symbol = np.zeros(n + 1, np.int64)
    symbol[start] = np.arange(len(names))
    symbol[n] = len(names)
    value = words.mix(names, 80)
    # the longest symbol first, as it is the least common: equal names stand for equally many words
    rank = value >> np.uint64(8) | np.uint64(255) - np.minimum(np.diff(np.append(start, n)), 255).astype(np.uint64) << np.uint64(56)
    has = left < right
    a, b = symbol[left[has]], symbol[right[has]]
    wide = b - a
    levels = [np.arange(len(names))]
    while (2 << (len(levels) - 1)) <= int(wide.max(initial=1)):
        reach, last = 1 << (len(levels) - 1), levels[-1]
        x, y = last[:-reach], last[reach:]
        levels.append(np.where(rank[x] <= rank[y], x, y))
    power = np.frexp(wide.astype(float))[1] - 1
    place = np.empty(len(first), np.int64)
    name = np.empty(len(first), np.uint64)
    least = np.empty(len(a), np.int64)
    for p in range(len(levels)):
        of = power == p
        x, y = levels[p][a[of]], levels[p][b[of] - (1 << p)]
        least[of] = np.where(rank[x] <= rank[y], x, y)
    place[has], name[has] = least, value[least]
    bare = np.flatnonzero(~has)
    place[bare] = len(names) + bare
    if len(bare):
        name[bare] = words.sequences(hashes, window, 5)[first[bare]]
    return first, name, place


def _name_rows(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            flat, bounds = words.split(batch.column(2))
            first, name, place = anchors(words.hashed(flat), bounds, window)
            text = np.searchsorted(bounds, first, side="right") - 1
            new = np.ones(len(first), bool)
            new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
            name, text = name[new], text[new]
            order = np.lexsort((name, text))
            name, text = name[order], text[order]
            head = np.ones(len(name), bool)
            head[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
            at = np.flatnonzero(head)
            twice = np.diff(np.append(at, len(name))) > 1
            cuts = np.searchsorted(text[at], np.arange(batch.num_rows + 1))
            offsets = pa.array(cuts, pa.int32())
            yield pa.record_batch(
                {
                    "k1": batch.column(0),
                    "k2": batch.column(1),
                    "n_words": pa.array(np.diff(bounds)),
                    "names": pa.ListArray.from_arrays(offsets, pa.array(name[at].view(np.int64))),
                    "twice": pa.ListArray.from_arrays(offsets, pa.array(twice)),
                }
            )

    return work


def _window_rows(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            flat, bounds = words.split(batch.column(2))
            hashes = words.hashed(flat)
            first, name, _ = anchors(hashes, bounds, window)
            text = np.searchsorted(bounds, first, side="right") - 1
            shared = batch.column(3)
            marks = np.zeros(len(first), bool)
            cuts = np.searchsorted(text, np.arange(batch.num_rows + 1))
            flags, at = shared.flatten().to_numpy().view(np.uint64), shared.offsets.to_numpy() - shared.offsets[0].as_py()
            for i in range(batch.num_rows):
                a, b = cuts[i], cuts[i + 1]
                marks[a:b] = np.isin(name[a:b], flags[at[i] : at[i + 1]])
            first, text = first[marks], text[marks]
            low, high = words.sequences(hashes, window, 1), words.sequences(words.hashed(flat, 1), window, 2)
            rows = pa.array(text)
            yield pa.record_batch(
                {
                    "low": pa.array(low[first].view(np.int64)),
                    "high": pa.array(high[first].view(np.int64)),
                    "k1": batch.column(0).take(rows),
                    "k2": batch.column(1).take(rows),
                    "at": pa.array((first - bounds[text]).astype(np.int32)),
                }
            )

    return work


def _kept(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            flat, bounds = words.split(batch.column(1))
            gone = np.zeros(len(flat) + 1, np.int64)
            whole, starts = batch.column(2).to_pylist(), batch.column(3)
            for i in range(batch.num_rows):
                a, b = bounds[i], bounds[i + 1]
                if whole[i] and b - a >= window:
                    gone[a] += 1
                    gone[b] -= 1
                elif starts[i].is_valid:
                    at = a + np.array(starts[i].values.to_numpy(), np.int64)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
            keep = np.cumsum(gone)[:-1] == 0
            after = np.concatenate([[0], np.cumsum(keep)])[bounds]
            left = flat.filter(pa.array(keep))
            lists = pa.ListArray.from_arrays(pa.array(after, pa.int32()), left.cast(pa.string()))
            texts = pc.binary_join(lists, " ")
            total, stay = np.diff(bounds), np.diff(after)
            yield pa.record_batch(
                {"id": batch.column(0), "n_words": pa.array(total), "n_removed": pa.array(total - stay), "kept": texts}
            )

    return work


def remove_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept): each text without the words covered by a window of ``window``
    words that also starts anywhere else; what is kept is joined by single spaces."""
    read = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.hash("text")})
    named = cut(read.select("k1", "k2", "text").mapInArrow(_name_rows(window), "k1 bigint, k2 int, n_words bigint, names array<bigint>, twice array<boolean>"))
    copies = cut(named.where(F.col("n_words") >= window).groupBy("k1", "k2").agg((F.count("*") > 1).alias("whole")))
    rows = named.select("k1", "k2", F.explode(F.arrays_zip("names", "twice")).alias("x")).select("k1", "k2", F.col("x.names").alias("name"), F.col("x.twice").alias("twice"))
    met = rows.groupBy("name").agg(
        F.min("k1").alias("a1"), F.max("k1").alias("b1"), F.min("k2").alias("a2"), F.max("k2").alias("b2"), F.bool_or("twice").alias("twice")
    )
    shared = cut(met.where("twice or a1 < b1 or a2 < b2").select("name"))
    marks = rows.select("k1", "k2", "name").join(shared, "name", "left_semi").groupBy("k1", "k2").agg(F.collect_set("name").alias("shared"))
    texts = read.select("k1", "k2", "text").dropDuplicates(["k1", "k2"])
    windows = cut(
        texts.join(marks, ["k1", "k2"]).select("k1", "k2", "text", "shared").mapInArrow(_window_rows(window), "low bigint, high bigint, k1 bigint, k2 int, at int")
    )
    again = cut(windows.groupBy("low", "high").agg(F.count("*").alias("n")).where("n > 1").select("low", "high"))
    starts = windows.join(again, ["low", "high"], "left_semi").groupBy("k1", "k2").agg(F.collect_list("at").alias("starts"))
    known = cut(copies.where("whole").join(starts, ["k1", "k2"], "full").select("k1", "k2", "whole", "starts"))
    return read.join(known, ["k1", "k2"], "left").select("id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "starts").mapInArrow(
        _kept(window), f"id {dict(docs.dtypes)[key]}, n_words bigint, n_removed bigint, kept string"
    )
