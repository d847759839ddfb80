"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max bounds.

Items are cut into segments of at most ``SEGMENT`` words. A segment's BM25 weights are divided by its score
for itself, so a passage scores the share of the segment that it holds, and one threshold fits all.
Passages are overlapping stretches of ``2 * SEGMENT`` words of every text, so any segment lies within one.

Search skips what cannot reach the threshold: frequent terms whose weights together stay below a part of it
are looked at last, passages are bounded by the rare terms they hold and, block of segments by block,
by each term's greatest weight in the block; only (passage, block) pairs whose bound reaches the threshold
are scored. All passages of an Arrow batch go through each step together. What is retrieved
is verified: enough five-word sequences of the question, and enough words of the answer, must be
there, the answer being the last sentence of an item of several. A long item is also found by a part: by any
retrieved segment of it of which enough sequences, and enough words of the answer in it, are there.

Segments, words and the segments of each term are counted over all items, so scores do not depend on how the
items are dealt to indexes.

Defined cases: null and empty texts or items match nothing; repeated items and rows are matched each;
items in more text than ``SHARD_BYTES`` are searched in shards of that size, which changes no result;
an empty benchmark finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snippetlake.llm import words
from snippetlake.llm.tokenout import slices
from snippetlake.llm.toxicity import EDGES
from snippetlake.session import cut

SEGMENT = 64
#: Segments a block of the index holds.
BLOCK = 16
K1, B = 1.2, 0.75
#: Share of a segment that a passage must hold to be retrieved; part of it that frequent terms may make up.
THRESHOLD, FREQUENT = 0.5, 0.5
#: Shares of the question's five-word sequences and of the answer's words that verify a match.
QUESTION, ANSWER, GRAM = 0.6, 0.6, 5
#: Bound of the item text of one index, which every task gets.
SHARD_BYTES = 8 << 20
#: Bound of the greatest weights that are gathered at once to bound passages.
BOUND_BYTES = 4 << 20
#: Postings that are followed at once.
BOUND_POSTINGS = 1 << 18


class Statistics(NamedTuple):
    """Of the segments of all items; ``df`` of the terms of one shard at least."""

    segments: int
    mean: float
    df: dict[int, int]


class Index(NamedTuple):
    vocabulary: dict[int, int]
    weights: np.ndarray  # of postings, by term
    segments: np.ndarray  # of postings
    starts: np.ndarray  # of terms in the postings
    frequent: np.ndarray  # terms looked at last
    tail: np.ndarray  # per block: the most that frequent terms add
    block_max: np.ndarray  # term x block
    item: np.ndarray  # of segments
    item_ids: list[int]
    question: list[np.ndarray]
    answer: list[np.ndarray]
    part: list[np.ndarray]  # sequences of segments, where an item has several
    part_answer: list[np.ndarray]


def _normal(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words, lower-cased and without signs at their ends, and the bounds of the texts."""
    flat, bounds = words.split(texts)
    coded = flat.dictionary_encode()
    names = words.hashed(pc.utf8_lower(pc.utf8_trim(coded.dictionary.cast(pa.large_string()), characters=EDGES)))
    return names[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64), bounds


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence of several is the answer; a single one is all question."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p.strip()]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


def _segments(texts: list[str | None]) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """The segments of the texts as numbers of words, and for each its text and its first word there."""
    names, bounds = _normal(pa.array([t if t and t.strip() else None for t in texts], pa.string()))
    segments, owner = [], []
    for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        n, at = -(-(b - a) // SEGMENT), 0
        for part in np.array_split(names[a:b], n) if n else []:
            segments.append(part)
            owner.append((i, at))
            at += len(part)
    return segments, owner


def build(items: list[tuple[int, str]], statistics: Statistics | None = None) -> Index | None:
    """The index of a bounded list of items; without ``statistics`` they are all items."""
    items = [(i, t) for i, t in items if t and t.strip()]
    segments, owner = _segments([t for _, t in items])
    if not segments:
        return None
    mean = statistics.mean if statistics else sum(len(s) for s in segments) / len(segments)
    vocabulary = {int(t): k for k, t in enumerate(np.unique(np.concatenate(segments)))}
    pairs = []
    for s, part in enumerate(segments):
        terms, tf = np.unique(part, return_counts=True)
        pairs.append((np.array([vocabulary[int(t)] for t in terms]), np.full(len(terms), s), tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(part) / mean))))
    term, segment, gain = (np.concatenate(x) for x in zip(*pairs, strict=True))
    df = np.bincount(term, minlength=len(vocabulary))
    n = statistics.segments if statistics else len(segments)
    everywhere = np.array([statistics.df[t] for t in vocabulary]) if statistics else df
    weight = gain * np.log(1 + (n - everywhere + 0.5) / (everywhere + 0.5))[term]
    weight = weight / np.bincount(segment, weight, len(segments))[segment]
    order = np.argsort(term, kind="stable")
    term, segment, weight = term[order], segment[order], weight[order]
    blocks = -(-len(segments) // BLOCK)
    block_max = np.zeros((len(vocabulary), blocks), np.float32)
    np.maximum.at(block_max, (term, segment // BLOCK), weight.astype(np.float32))
    frequent, held = np.zeros(len(vocabulary), bool), np.zeros(len(segments))
    starts = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    for t in np.argsort(-df, kind="stable"):
        own = slice(starts[t], starts[t + 1])
        more = held[segment[own]] + weight[own]
        if more.max() > THRESHOLD * FREQUENT:
            break
        held[segment[own]] = more
        frequent[t] = True
    tail = np.zeros(blocks, np.float32)
    np.maximum.at(tail, np.arange(len(segments)) // BLOCK, held.astype(np.float32))
    halves = [question_and_answer(t) for _, t in items]
    (q, qb), (a, ab) = _normal(pa.array([x for x, _ in halves])), _normal(pa.array([y for _, y in halves]))
    grams = [np.unique(words.sequences(q[x:y], min(GRAM, int(y - x)))) if y > x else np.zeros(0, np.uint64) for x, y in zip(qb, qb[1:], strict=False)]
    answers = [np.unique(a[x:y]) for x, y in zip(ab, ab[1:], strict=False)]
    item = np.array([i for i, _ in owner])
    several = np.bincount(item)[item] > 1
    parts = [np.unique(words.sequences(x, min(GRAM, len(x)))) if m else None for x, m in zip(segments, several, strict=True)]
    part_answers = [np.unique(x[max(0, int(qb[i + 1] - qb[i]) - at) :]) if m else None for x, (i, at), m in zip(segments, owner, several, strict=True)]
    weight = weight.astype(np.float32)
    return Index(vocabulary, weight, segment, starts, frequent, tail, block_max, item, [i for i, _ in items], grams, answers, parts, part_answers)


def _pairs(chunk: np.ndarray, term: np.ndarray, last: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (passage, term): a passage is a chunk and the one after it in the same text."""
    own = words.distinct(chunk * n_terms + term)
    chunk, term = own // n_terms, own % n_terms
    before = ~last[chunk - 1] & (chunk > 0)
    both = words.distinct(np.concatenate([own, (chunk[before] - 1) * n_terms + term[before]]))
    return both // n_terms, both % n_terms


def _reached(index: Index, term: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage, block) whose bound reaches the threshold, of passages whose rare terms start at ``start``; the greatest
    weights of about ``BOUND_BYTES`` are gathered at once, since all of a slice would be many times its text."""
    pairs = max(1, BOUND_BYTES // (index.block_max.itemsize * len(index.tail)))
    ends = np.append(start, len(term))
    cuts = np.unique(np.append(np.searchsorted(start, np.arange(0, len(term), pairs)), len(start)))
    found = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        bound = np.add.reduceat(index.block_max[term[ends[a] : ends[b]]], start[a:b] - ends[a], axis=0) + index.tail
        p, block = np.nonzero(bound >= THRESHOLD - 1e-4)
        found.append((p + a, block))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _scored(index: Index, row: np.ndarray, term: np.ndarray, blocks: np.ndarray) -> Iterator[tuple[int, float]]:
    """(passage * segments + segment, score) of what is retrieved, from the terms of each passage in order. The postings
    of about ``BOUND_POSTINGS`` are followed at once, and those of a passage always together."""
    count = index.starts[term + 1] - index.starts[term]
    opens = np.flatnonzero(np.diff(row, prepend=-1))
    before, ends = (np.cumsum(count) - count)[opens], np.append(opens, len(row))
    cuts = np.unique(np.append(np.searchsorted(before, np.arange(0, count.sum(), BOUND_POSTINGS)), len(opens)))
    for a, b in zip(cuts, cuts[1:], strict=False):
        own = slice(ends[a], ends[b])
        n = count[own]
        posting = np.repeat(index.starts[term[own]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        of = np.repeat(row[own], n)
        segment = index.segments[posting]
        ok = blocks[of, segment // BLOCK]
        pair, where = np.unique(of[ok] * len(index.item) + segment[ok], return_inverse=True)
        score = np.bincount(where, index.weights[posting[ok]])
        found = np.flatnonzero(score >= THRESHOLD - 1e-6)
        yield from zip(pair[found].tolist(), score[found].tolist(), strict=True)


def _search(names: np.ndarray, bounds: np.ndarray, index: Index) -> list[tuple[int, int, float, float, float]]:
    """(text, item, score, question share, answer share) of the verified matches in the flat texts."""
    known = np.array(sorted(index.vocabulary), np.uint64)
    number = np.array([index.vocabulary[int(t)] for t in known])
    at = np.minimum(np.searchsorted(known, names), len(known) - 1)
    hit = known[at] == names
    sizes = np.diff(bounds)
    chunks = -(-sizes // SEGMENT)
    first = np.concatenate([[0], np.cumsum(chunks)])
    chunk = np.repeat(first[:-1], sizes) + (np.arange(len(names)) - np.repeat(bounds[:-1], sizes)) // SEGMENT
    last = np.zeros(first[-1] + 1, bool)
    last[first[1:][chunks > 0] - 1] = True
    place, term = chunk[hit], number[at[hit]]
    rare = ~index.frequent[term]
    passage, rare_term = _pairs(place[rare], term[rare], last, len(known))
    if not len(passage):
        return []
    # passages by their rare terms, then block by block
    distinct, start = np.unique(passage, return_index=True)
    p, block = _reached(index, rare_term, start)
    if not len(p):
        return []
    wanted = np.zeros(first[-1] + 1, bool)
    wanted[distinct[p]] = True
    near = wanted[place] | (wanted[place - 1] & (place > 0))
    passage, terms = _pairs(place[near], term[near], last, len(known))
    keep = wanted[passage]
    passage, terms = passage[keep], terms[keep]
    blocks = np.zeros((len(distinct), len(index.tail)), bool)
    blocks[p, block] = True
    row = np.searchsorted(distinct, passage)
    n_segments = len(index.item)
    best: dict[tuple[int, int], list[tuple[float, int]]] = {}
    for pair, score in _scored(index, row, terms, blocks):
        text = int(np.searchsorted(first, distinct[pair // n_segments], side="right")) - 1
        number = pair % n_segments
        best.setdefault((text, int(index.item[number])), []).append((score, number))
    out, seen = [], {}
    for (text, item), parts in sorted(best.items()):
        if text not in seen:
            own = names[bounds[text] : bounds[text + 1]]
            seen = {text: (own, words.distinct(words.sequences(own, GRAM)))}
        own, grams = seen[text]
        parts = sorted(parts, reverse=True)
        tries = [(index.question[item], index.answer[item])]
        tries += [(index.part[n], index.part_answer[n]) for n in dict.fromkeys(n for _, n in parts) if index.part[n] is not None]
        for question, answer in tries:
            in_question = _share(question, grams, own)
            in_answer = float(np.isin(answer, own).mean()) if len(answer) else 1.0
            if in_question >= QUESTION and in_answer >= ANSWER:
                out.append((text, item, parts[0][0], in_question, in_answer))
                break
    return out


def _share(question: np.ndarray, grams: np.ndarray, own: np.ndarray) -> float:
    """Share of the question's sequences in a text; a question of fewer words is one shorter sequence."""
    if not len(question):
        return 1.0
    if np.isin(question, grams).any():
        return float(np.isin(question, grams).mean())
    shorter = np.concatenate([words.sequences(own, n) for n in range(1, GRAM)])
    return float(len(question) == 1 and np.isin(question, shorter).all())


def _matches(index: Index):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = _search(*_normal(batch.column(1)), index)
            ids = batch.column(0).take(pa.array([x[0] for x in found], pa.int64()))
            columns = {n: pa.array([x[k] for x in found], pa.float64()) for k, n in ((2, "score"), (3, "question_overlap"), (4, "answer_overlap"))}
            yield pa.record_batch({"id": ids, "item_id": pa.array([index.item_ids[x[1]] for x in found], pa.int64()), **columns})

    return work


def _without(index: Index, text: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            keep = np.ones(batch.num_rows, bool)
            keep[[x[0] for x in _search(*_normal(batch.column(batch.schema.get_field_index(text))), index)]] = False
            yield batch.filter(pa.array(keep))

    return work


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, term, words): each distinct term of each segment; the words of a segment with its first term."""
    for batch in slices(batches, "text"):
        shards, (segments, owner) = batch.column(0).to_pylist(), _segments(batch.column(1).to_pylist())
        terms = [np.unique(x) for x in segments]
        sizes = np.array([len(x) for x in terms], np.int64)
        count = np.zeros(sizes.sum(), np.int64)
        count[np.cumsum(sizes) - sizes] = [len(x) for x in segments]
        flat = np.concatenate([np.zeros(0, np.uint64), *terms]).view(np.int64)
        shard = np.repeat(np.array([shards[i] for i, _ in owner], np.int32), sizes)
        yield pa.record_batch({"shard": pa.array(shard), "term": pa.array(flat), "words": pa.array(count)})


def indexes(benchmark: DataFrame, key: str = "item_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> Iterator[Index]:
    """One index, or one per shard of about ``shard_bytes`` of item text. One shard at a time comes to the
    driver, with the counts that its own terms have over all items."""
    read = benchmark.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    total = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-total // shard_bytes)
    dealt = read.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(shards)).cast("int")) if shards else read
    if shards > 1:
        terms = cut(dealt.select("shard", "text").mapInArrow(_terms, "shard int, term bigint, words bigint"))
        count = terms.agg(F.count_if(F.col("words") > 0).alias("segments"), F.sum("words").alias("words")).first()
        df = terms.groupBy("term").agg(F.count("*").alias("df"))
        counted = cut(terms.select("shard", "term").distinct().join(df, "term"))
    for s in range(shards):
        rows = dealt.where(F.col("shard") == s).orderBy("id", "text").select("id", "text").collect()
        statistics = None
        if shards > 1 and count.segments:
            own = counted.where(F.col("shard") == s).select("term", "df").toPandas()
            statistics = Statistics(count.segments, count.words / count.segments, dict(zip(own["term"].to_numpy().view(np.uint64).tolist(), own["df"].tolist(), strict=True)))
        index = build([(r.id, r.text) for r in rows], statistics)
        if index is not None:
            yield index


MATCH = "id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, item_id, score, question_overlap, answer_overlap) for every text that holds a test item; the
    overlaps are those of the whole item or, if it is there in part only, of the best segment that is there."""
    read = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], MATCH)
    for k, index in enumerate(indexes(benchmark, shard_bytes=shard_bytes)):
        found = read.mapInArrow(_matches(index), MATCH)
        out = found if k == 0 else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no test item, all columns as they are."""
    for index in indexes(benchmark):
        docs = docs.mapInArrow(_without(index, text), docs.schema)
    return docs
