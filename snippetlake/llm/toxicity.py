"""Toxicity: a small convolutional text classifier, trained in numpy.

A word is the sum of two hashed embeddings, its own and that of its first five letters. Filters of
several widths run over the words, the maximum of each filter over the whole text goes into a logistic
output. Training uses every labelled text that may be used. Beyond ``GROUP`` of them they are dealt by hash of the id into
groups of about so many, each trained in a task from one start, the log odds of all texts, and the models' mean is
taken, slice by slice; the output is then shifted to the share of toxic texts among all labelled ones.
Language enters no score: it only picks the threshold of the extra column ``flagged``, set
for each language on labelled texts kept out of the gradient steps.

Defined cases: null and empty texts score what the model gives no words; labels that are null are not
used, of several labels of a text the highest is; without usable labels of both kinds all scores are the
share of toxic labels (0 without any); repeated rows are scored again; words of any length are hashed whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snippetlake.llm import words
from snippetlake.llm.tokenout import slices
from snippetlake.session import cut

#: Texts a task or the driver trains on, and slices in which models are averaged.
GROUP, SLICES = 7_500, 64
#: Labels that are sent to all tasks, so that texts need not move to them.
BROADCAST_LABELS = 8_000_000
#: Steps of score that thresholds are told apart by.
SCORE_STEPS = 10_000
BUCKETS, DIMS, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 8
EPOCHS, BATCH, RATE = 8, 32, 0.15
PREFIX = 5
#: One training text in so many sets thresholds instead of weights.
ASIDE = 5
#: Signs cut from the ends of words (fixed values).
EDGES = ".,;:!?#%$&*|\"'()[]{}<>-_=+/\\`~^@"


class Model(NamedTuple):
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    output: np.ndarray
    shift: float
    thresholds: dict[str, float]


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word codes of all texts, their bounds, and per code the buckets of the word and its prefix."""
    flat, bounds = words.split(texts)
    coded = flat.dictionary_encode()
    names = pc.utf8_lower(pc.utf8_trim(coded.dictionary.cast(pa.large_string()), characters=EDGES))
    own = words.hashed(names) % np.uint64(BUCKETS)
    start = words.hashed(pc.utf8_slice_codeunits(names, 0, PREFIX), 1) % np.uint64(BUCKETS)
    return coded.indices.to_numpy(), bounds, own.astype(np.int32), start.astype(np.int32)


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        codes, bounds, own, start = _coded(batch.column(1))
        offsets = pa.array(bounds, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.uint16).view(np.int16)[codes])) for x in (own, start)]
        yield pa.record_batch({"id": batch.column(0), "lang": batch.column(2), "toxic": batch.column(3), "own": lists[0], "start": lists[1]})


def _pooled(table: np.ndarray, codes: np.ndarray, bounds: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Maximum of each filter over each text (0 where it has no words), and the words where it begins."""
    texts, n = len(bounds) - 1, len(codes)
    pooled, place = np.zeros((texts, len(WIDTHS) * FILTERS), np.float32), np.zeros((texts, len(WIDTHS) * FILTERS), np.int64)
    some = np.flatnonzero(np.diff(bounds))
    if not len(some):
        return pooled, place
    last = np.zeros(n, bool)
    last[bounds[1:][some] - 1] = True
    for w, width in enumerate(WIDTHS):
        response = np.tile(model.bias[w * FILTERS : (w + 1) * FILTERS], (n, 1)).astype(np.float32)
        for j in range(width):
            part = table @ model.filters[w][j]
            if j == 0:
                response += part[codes]
            elif n > j:
                beyond = np.zeros(n - j, bool)  # the text ends within the next j words
                for i in range(j):
                    beyond |= last[i : n - j + i]
                shifted = part[codes[j:]]
                shifted[beyond] = 0
                response[:-j] += shifted
        at = bounds[:-1][some]
        cols = slice(w * FILTERS, (w + 1) * FILTERS)
        pooled[some, cols] = np.maximum.reduceat(response, at, axis=0)
        if texts <= BATCH:
            for t in some:
                place[t, cols] = bounds[t] + response[bounds[t] : bounds[t + 1]].argmax(0)
    return np.maximum(pooled, 0), place


def _logits(pooled: np.ndarray, model: Model) -> np.ndarray:
    return pooled @ model.output[:-1] + model.output[-1]


def _presence(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """Texts of either label that hold each bucket."""
    counts = np.zeros((2, BUCKETS))
    for (own, start), y in zip(texts, labels, strict=True):
        counts[y, np.unique(np.concatenate([own, start]))] += 1
    return counts


def _start(presence: np.ndarray, share: np.ndarray, rng: np.random.Generator) -> Model:
    """The first embedding dimension starts at the log odds of a bucket among texts with either label, of which
    there are ``share``; the rest small and random."""
    odds = np.log((1 + presence[1]) / (share[1] + 2)) - np.log((1 + presence[0]) / (share[0] + 2))
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32)
    embedding[:, 0] = np.clip(odds, -2, 4) * 0.3
    filters = [rng.normal(0, 0.3, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, :] = np.abs(f[:, 0, :]) + 0.3
    n_filters = len(WIDTHS) * FILTERS
    return Model(embedding, filters, np.full(n_filters, -0.3, np.float32), np.append(np.full(n_filters, 0.1), -1).astype(np.float32), 0.0, {})


def _train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 11, presence: np.ndarray | None = None, share: np.ndarray | None = None) -> Model:
    """Adagrad on the logistic loss, from where ``presence`` and ``share``, by default those of the texts, put it."""
    rng = np.random.default_rng(seed)
    if presence is None:
        presence, share = _presence(texts, labels), np.array([len(labels) - labels.sum(), labels.sum()])
    model = _start(presence, share, rng)
    embedding, filters = model.embedding, model.filters
    past = [np.full(x.shape, 1e-2, np.float32) for x in (embedding, *filters, model.bias, model.output)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            own, start = (np.concatenate([texts[i][k] for i in part]) for k in (0, 1))
            bounds = np.concatenate([[0], np.cumsum([len(texts[i][0]) for i in part])])
            if not len(own):
                continue
            rows = embedding[own] + embedding[start]
            pooled, place = _pooled(rows, np.arange(len(own)), bounds, model)
            error = (1 / (1 + np.exp(-_logits(pooled, model))) - labels[part]).astype(np.float32) / len(part)
            d_out = np.append(pooled.T @ error, error.sum())
            d_pool = error[:, None] * model.output[:-1] * (pooled > 0)
            grads = [None, *[np.zeros_like(f) for f in filters], d_pool.sum(0)]
            hit, value = [], []
            ends = np.repeat(bounds[1:], FILTERS).reshape(len(part), FILTERS)
            for w, width in enumerate(WIDTHS):
                cols = slice(w * FILTERS, (w + 1) * FILTERS)
                for j in range(width):
                    at = place[:, cols] + j
                    ok = (at < ends) & (d_pool[:, cols] != 0)
                    t, f = np.nonzero(ok)
                    p, g = at[ok], d_pool[:, cols][ok]
                    np.add.at(grads[1 + w][j].T, f, g[:, None] * rows[p])
                    hit.append(p)
                    value.append(g[:, None] * filters[w][j][:, f].T)
            hit, value = np.concatenate(hit), np.concatenate(value)
            touched, where = np.unique(np.concatenate([own[hit], start[hit]]), return_inverse=True)
            total = np.zeros((len(touched), DIMS), np.float32)
            np.add.at(total, where, np.concatenate([value, value]))
            past[0][touched] += total**2
            embedding[touched] -= RATE * total / np.sqrt(past[0][touched])
            for x, g, h in zip([*filters, model.bias, model.output], [*grads[1:], d_out], past[1:], strict=True):
                h += g**2
                x -= RATE * g / np.sqrt(h)
    return model


def _score_texts(texts: list[tuple[np.ndarray, np.ndarray]], model: Model) -> np.ndarray:
    out = []
    for own, start in texts:
        rows = model.embedding[own] + model.embedding[start]
        out.append(_logits(_pooled(rows, np.arange(len(own)), np.array([0, len(own)]), model)[0], model)[0])
    return np.array(out)


def _best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """Least score of those flagged at the highest F1."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(len(order)) + 1 + labels.sum())
    return float(scores[order[f1.argmax()]])


def _texts(table: pa.Table | pa.RecordBatch) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    texts = [tuple(x.values.to_numpy().view(np.uint16).astype(np.int32) for x in pair) for pair in zip(table.column("own"), table.column("start"), strict=True)]
    return texts, table.column("toxic").to_numpy()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, BUCKETS))
    for batch in batches:
        total += _presence(*_texts(batch))
    toxic, bucket = np.nonzero(total)
    yield pa.record_batch({"toxic": pa.array(toxic, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "n": pa.array(total[toxic, bucket].astype(np.int64))})


def _mean_model(rows: DataFrame, groups: int) -> Model:
    """The mean of one model for each group of ``rows (id, toxic, own, start)``. Tasks hold one group, or
    one slice of all models; the driver holds one model."""
    spark = rows.sparkSession
    counts = rows.select("toxic", "own", "start").mapInArrow(_counted, "toxic int, bucket int, n bigint").groupBy("toxic", "bucket").agg(F.sum("n").alias("n")).toArrow()
    presence, share = np.zeros((2, BUCKETS)), np.zeros(2)
    presence[counts["toxic"].to_numpy(), counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect():
        share[r.toxic] = r.n
    shared = spark.sparkContext.broadcast((presence, share))

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        model = _train(*_texts(table), presence=shared.value[0], share=shared.value[1])
        flat = np.concatenate([x.ravel() for x in (model.embedding, *model.filters, model.bias, model.output)])
        parts = [p.astype("<f4").tobytes() for p in np.array_split(flat, SLICES)]
        return pa.table({"slice": pa.array(range(SLICES), pa.int32()), "n": pa.array([table.num_rows] * SLICES, pa.int64()), "value": pa.array(parts, pa.binary())})

    def mean(table: pa.Table) -> pa.Table:
        values = np.array([np.frombuffer(v, "<f4") for v in table["value"].to_pylist()], np.float64)
        order = np.lexsort([*values.T[:2], table["n"].to_numpy()])  # sums do not depend on the order of arrival
        value = np.average(values[order], axis=0, weights=table["n"].to_numpy()[order]).astype("<f4")
        return pa.table({"slice": table["slice"].slice(0, 1), "value": pa.array([value.tobytes()], pa.binary())})

    dealt = rows.select("id", "toxic", "own", "start", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("part"))
    models = dealt.groupBy("part").applyInArrow(train, "slice int, n bigint, value binary")
    got = models.groupBy("slice").applyInArrow(mean, "slice int, value binary").toArrow().sort_by("slice")
    flat = np.concatenate([np.frombuffer(v, "<f4") for v in got["value"].to_pylist()])
    like = _start(presence, share, np.random.default_rng(11))
    shapes = [like.embedding, *like.filters, like.bias, like.output]
    out = [p.reshape(x.shape).copy() for p, x in zip(np.split(flat, np.cumsum([x.size for x in shapes])[:-1]), shapes, strict=True)]
    return like._replace(embedding=out[0], filters=out[1:-2], bias=out[-2], output=out[-1])


def _thresholds(rows: DataFrame, model: Model) -> dict[str, float]:
    """For each language with ten toxic texts among ``rows`` the least score of those flagged at the highest F1,
    to a step of score; the counts of the steps are all that comes to the driver."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = 1 / (1 + np.exp(-(_score_texts(_texts(batch)[0], model).astype(np.float64) + model.shift)))
            yield pa.record_batch({"lang": batch.column(0), "toxic": batch.column(1), "score": pa.array(score, pa.float64())})

    each = rows.where("lang is not null").select("lang", "toxic", "own", "start").mapInArrow(scored, "lang string, toxic int, score double")
    steps = each.groupBy("lang", F.floor(F.col("score") * SCORE_STEPS).alias("step")).agg(F.min("score").alias("score"), F.sum("toxic").alias("hits"), F.count("*").alias("n")).toPandas()
    found = {"": 0.5}
    for language, own in steps.sort_values(["lang", "step"], ascending=[True, False]).groupby("lang"):
        if own["hits"].sum() >= 10:
            f1 = 2 * own["hits"].cumsum() / (own["n"].cumsum() + own["hits"].sum())
            found[language] = float(own["score"].iloc[int(f1.to_numpy().argmax())])
    return found


def fit(docs: DataFrame, labels: DataFrame, usable, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | float:
    """A model from all labelled rows for which ``usable`` holds, or a constant score where one of the labels
    does not occur. Rows come to the driver only if they are no more than ``GROUP``."""
    known = labels.where(usable & F.col("toxic").isNotNull()).groupBy(F.col(key).alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    share = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not share.get(0) or not share.get(1):
        return 1.0 if share.get(1) else 0.0
    read = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    # two numbers a label; beyond that many, texts and labels are dealt by id
    if sum(share.values()) <= BROADCAST_LABELS:
        known = F.broadcast(known)
    rows = read.join(known, F.col("id") == F.col("label_id")).select("id", "text", "lang", "toxic")
    coded = cut(rows.mapInArrow(_ids, "id bigint, lang string, toxic int, own array<smallint>, start array<smallint>"))
    wanted = share[1] / (share[0] + share[1])
    by_label = {r.toxic: r.n for r in coded.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(by_label) < 2:
        return wanted
    aside = F.expr(f"crc32(cast(id as string)) div 7 % {ASIDE} = 0")
    n = sum(by_label.values())
    if n > GROUP:
        kept = {r.toxic: r.n for r in coded.where(~aside).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        fold, kept = (coded.where(~aside), kept) if len(kept) == 2 else (coded, by_label)
        sampled = kept[1] / (kept[0] + kept[1])
        model = _mean_model(fold, -(-sum(kept.values()) // GROUP))
        model = model._replace(shift=float(np.log(wanted / (1 - wanted)) - np.log(sampled / (1 - sampled))))
        return model._replace(thresholds=_thresholds(coded.where(aside), model))
    table = coded.toArrow().sort_by("id")
    texts, y = _texts(table)
    aside = np.array([zlib.crc32(str(i).encode()) // 7 % ASIDE == 0 for i in table.column("id").to_pylist()])
    fold = np.flatnonzero(~aside) if len(set(y[~aside].tolist())) == 2 else np.arange(len(y))
    model = _train([texts[i] for i in fold], y[fold])
    sampled = y[fold].mean()
    shift = float(np.log(wanted / (1 - wanted)) - np.log(sampled / (1 - sampled)))
    scores = 1 / (1 + np.exp(-(_score_texts([texts[i] for i in np.flatnonzero(aside)], model) + shift)))
    langs, thresholds = np.array(table.column("lang").to_pylist(), object)[aside], {"": 0.5}
    for language in sorted({x for x in langs if x is not None}):
        own = langs == language
        if y[aside][own].sum() >= 10:
            thresholds[language] = _best_threshold(scores[own], y[aside][own])
    return model._replace(shift=shift, thresholds=thresholds)


def _scores(model: Model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            codes, bounds, own, start = _coded(batch.column(1))
            pooled, _ = _pooled(model.embedding[own] + model.embedding[start], codes, bounds, model)
            score = 1 / (1 + np.exp(-(_logits(pooled, model).astype(np.float64) + model.shift)))
            yield pa.record_batch({"id": batch.column(0), "lang": batch.column(2), "score": pa.array(score)})

    return work


def score(docs: DataFrame, model: Model | float, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(id, score, flagged) of every row: the score from the text alone, ``flagged`` by the threshold of
    the row's language."""
    read = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    if isinstance(model, float):
        return read.select("id", F.lit(model).alias("score"), F.lit(model >= 0.5).alias("flagged"))
    scored = read.mapInArrow(_scores(model), "id bigint, lang string, score double")
    edges = F.create_map(*[x for k, v in sorted(model.thresholds.items()) for x in (F.lit(k), F.lit(v))])
    return scored.select("id", "score", (F.col("score") >= F.coalesce(F.try_element_at(edges, "lang"), F.lit(model.thresholds[""]))).alias("flagged"))
