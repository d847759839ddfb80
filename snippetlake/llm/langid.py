"""Language identification by Bayesian evidence fusion.

Four kinds of evidence about a text's language are multiplied: the likelihood of its letter trigrams,
the language its markup declares, the suffix of its address, and what its host mostly writes.

* Trigram models are counted over all texts by the language they declare, over hashed trigrams of bytes, by
  one grouped aggregation. Every language declared by texts of enough letters has a model; seed words
  stand in for languages nobody declares.
* How far a declaration or suffix can be trusted is the table of (evidence, language the text alone
  speaks for), counted by a grouped aggregation.
* A host's prior is its own counts smoothed by those of its domain, those by the whole table's.

A text is rejected if it has no letters, or if it has enough of them and a flat model of bytes explains it
better than any language.

Defined cases: null and empty texts have no letters; null markup, address or host is no evidence; a text of
few letters is carried by the other evidence; repeated rows are judged alike; keys may repeat or be null; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snippetlake.llm.tokenout import slices
from snippetlake.session import cut

#: Languages told apart even if nobody declares them, each with seed words (fixed values); they come first
#: in the order of the model's columns, other declared languages follow.
SEEDS = {
    "de": "der die und das nicht mit von ein den ist im auch für sich auf",
    "en": "the of and to in is that it was for with as on be at by",
    "es": "el la de que y los en un las por con para una su no",
    "fr": "le la les des et en un que pour dans qui est par pas sur",
}
#: What a rejected text is given.
UNDETERMINED = "und"
BUCKETS = 1 << 13
#: Trigrams of one text depend on each other: more than this many count as this many.
WEIGHT = 100.0
#: Prior of text in no language, and pseudo-counts: of evidence tables, of a host and of its domain.
NO_LANGUAGE, DOUBT, HOST_DOUBT, DOMAIN_DOUBT = 1e-4, 1.0, 20.0, 20.0


#: Bytes of text looked at together; a trigram takes some thirty bytes of memory.
PORTION = 1 << 20
#: Texts of fewer letters cannot show that they are in no language.
ENOUGH = 60


class Columns(NamedTuple):
    """Names of the input columns; None for evidence the table does not have."""

    key: str = "doc_id"
    text: str = "text"
    markup: str | None = "lang"
    address: str | None = None
    host: str | None = "source"


def _evidence(docs: DataFrame, names: Columns) -> list[Column]:
    from snippetlake.llm.urlfilter import host_of

    empty = F.lit(None).cast("string")
    address = host_of(F.col(names.address).cast("string")) if names.address else empty
    host = F.col(names.host).cast("string") if names.host else F.when(address != "", address)
    markup = F.lower(F.substring(F.col(names.markup).cast("string"), 1, 2)) if names.markup else empty
    suffix = F.when(address.contains("."), F.element_at(F.split(address, r"\."), -1))
    return [F.when(markup != "", markup).alias("markup"), F.when(suffix != "", suffix).alias("suffix"), host.alias("host")]


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of lower-cased texts, signs and digits left out; the text of each; and
    how many letters each text has."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    bounds = np.frombuffer(low.buffers()[1], np.int64, len(low) + 1, low.offset * 8)
    data = np.frombuffer(low.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    letter = _LETTER[data]
    # letters and word ends stay: of a stretch of other signs only the last one, as a blank
    keep = letter.copy()
    keep[:-1] |= letter[1:]
    keep[bounds[1:][np.diff(bounds) > 0] - 1] = True  # whatever the next text begins with
    at = np.flatnonzero(keep)
    codes = np.where(letter[at], data[at], 32).astype(np.int64)
    text = np.repeat(np.arange(len(low)), np.diff(bounds))[at]
    letters = np.bincount(text[letter[at]], minlength=len(low))
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    grams = ((codes[:-2] << 16 | codes[1:-1] << 8 | codes[2:]) * 0x9E3779B1 & 0xFFFFFFFF) >> 19
    one = text[:-2] == text[2:]
    return grams[one], text[:-2][one], letters


_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in slices(batches, "text", PORTION):
        grams, text, _ = _trigrams(batch.column(0))
        declared = batch.column(1).dictionary_encode()
        which = declared.indices.fill_null(-1).to_numpy(zero_copy_only=False)[text]
        for i, language in enumerate(declared.dictionary.to_pylist()):
            if language not in total:
                total[language] = np.zeros(BUCKETS, np.int64)
            total[language] += np.bincount(grams[which == i], minlength=BUCKETS)
    for language, counts in total.items():
        bucket = np.flatnonzero(counts)
        yield pa.record_batch({"language": pa.array([language] * len(bucket), pa.string()), "bucket": pa.array(bucket.astype(np.int32)), "n": pa.array(counts[bucket])})


def train(docs: DataFrame, names: Columns = Columns()) -> tuple[list[str], np.ndarray]:
    """The languages, and log probabilities of trigram buckets, a row per language, from all texts by
    declared language. At most ``BUCKETS`` counts per language come to the driver."""
    read = docs.select(F.col(names.text).cast("string").alias("text"), _evidence(docs, names)[0])
    rows = read.mapInArrow(_count, "language string, bucket int, n bigint").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    enough = (F.sum("n").over(Window.partitionBy("language")) >= ENOUGH) | F.col("language").isin(*SEEDS)
    found = rows.select("language", "bucket", "n", enough.alias("enough")).where("enough").collect()
    languages = [*SEEDS, *sorted({r.language for r in found} - set(SEEDS))]
    place = {language: i for i, language in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS))
    for r in found:
        counts[place[r.language], r.bucket] = r.n
    for i, seed in enumerate(SEEDS.values()):
        grams, _, _ = _trigrams(pa.array([f" {seed} "]))
        np.add.at(counts[i], grams, 1)
    counts += 0.1
    return languages, np.log(counts / counts.sum(1, keepdims=True))


def _likelihoods(model: np.ndarray):
    table = np.ascontiguousarray(np.vstack([model, np.full(BUCKETS, -np.log(BUCKETS))]).T.astype(np.float32))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PORTION):
            grams, text, letters = _trigrams(batch.column(1))
            n = batch.num_rows
            total = np.stack([np.bincount(text, table[grams, j].astype(np.float64), n) for j in range(table.shape[1])], axis=1).astype(np.float64)
            count = np.bincount(text, minlength=n)
            total *= np.minimum(1, WEIGHT / np.maximum(count, 1))[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * total.shape[1], pa.int32()), pa.array(total.ravel()))
            yield pa.record_batch(
                {"id": batch.column(0), **{k: batch.column(i) for i, k in ((2, "markup"), (3, "suffix"), (4, "host"))}, "letters": pa.array(letters.astype(np.int64)), "likelihood": lists}
            )

    return work


def _by_language(value: Column, k: int) -> list[Column]:
    """One column per language: how often the text alone spoke for it."""
    return [F.coalesce(F.sum((value == i).cast("double")), F.lit(0.0)).alias(f"n{i}") for i in range(k)]


def _listed(k: int) -> Column:
    return F.array(*[F.col(f"n{i}") for i in range(k)])


def judge(docs: DataFrame, names: Columns = Columns()) -> DataFrame:
    """(id, language, posterior, kept) of every row of ``docs``."""
    languages, model = train(docs, names)
    k = len(languages)
    read = docs.select(F.col(names.key).cast("bigint").alias("id"), F.col(names.text).cast("string").alias("text"), *_evidence(docs, names))
    schema = "id bigint, markup string, suffix string, host string, letters bigint, likelihood array<double>"
    spoken = F.expr(f"array_position(slice(likelihood, 1, {k}), array_max(slice(likelihood, 1, {k}))) - 1")
    scored = cut(read.mapInArrow(_likelihoods(model), schema).withColumn("spoken", F.when(F.col("letters") > 0, spoken)).withColumn("domain", F.regexp_extract("host", r"([^.]*\.[^.]*)$", 1)))
    sure = scored.where("spoken is not null")
    whole = [float(x) for x in sure.agg(*_by_language(F.col("spoken"), k)).first()]
    shares = [(x + DOUBT) / (sum(whole) + k * DOUBT) for x in whole]

    def trust(column: str) -> DataFrame:
        """log P(evidence | language), one row per value."""
        kinds = sure.where(F.col(column).isNotNull()).groupBy(column).agg(*_by_language(F.col("spoken"), k))
        logs = [F.log((F.col(f"n{i}") + DOUBT) / (whole[i] + 20 * DOUBT)) for i in range(k)]
        return cut(kinds.select(column, F.array(*logs).alias(f"by_{column}")))

    def smoothed(above: Column, doubt: float) -> Column:
        total = F.aggregate(_listed(k), F.lit(0.0), lambda a, x: a + x)
        return F.transform(F.arrays_zip(_listed(k).alias("own"), above.alias("above")), lambda x: (x.own + doubt * x.above) / (total + doubt))

    domains = sure.where("domain <> ''").groupBy("domain").agg(*_by_language(F.col("spoken"), k))
    domains = cut(domains.select("domain", smoothed(F.array(*map(F.lit, shares)), DOMAIN_DOUBT).alias("above")))
    hosts = sure.where("host is not null").groupBy("host", "domain").agg(*_by_language(F.col("spoken"), k)).join(domains, "domain", "left")
    hosts = cut(hosts.select("host", smoothed(F.coalesce("above", F.array(*map(F.lit, shares))), HOST_DOUBT).alias("prior")))
    fused = scored
    for column, table in (("markup", trust("markup")), ("suffix", trust("suffix")), ("host", hosts)):
        fused = fused.join(table, column, "left")
    nothing = F.array(*[F.lit(0.0)] * k)
    logs = [
        F.col("likelihood")[i] + F.coalesce("by_markup", nothing)[i] + F.coalesce("by_suffix", nothing)[i] + F.log(F.coalesce(F.col("prior")[i], F.lit(shares[i])) * (1 - NO_LANGUAGE))
        for i in range(k)
    ]
    # what is declared says nothing about text in no language: its evidence has the share it has overall
    flat = F.col("likelihood")[k] + F.log(F.lit(NO_LANGUAGE)) + F.coalesce(F.array_min("by_markup"), F.lit(0.0)) + F.coalesce(F.array_min("by_suffix"), F.lit(0.0))
    flat = F.when(F.col("letters") >= ENOUGH, flat).otherwise(F.lit(-1e9))
    with_logs = fused.select("id", "letters", F.array(*logs, flat).alias("logs")).withColumn("top", F.array_max("logs"))
    total = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    best = (F.array_position("logs", F.col("top")) - 1).cast("int")
    named = F.element_at(F.array(*[F.lit(x) for x in (*languages, UNDETERMINED)]), best + 1)
    language = F.when(F.col("letters") > 0, named).otherwise(UNDETERMINED)
    return with_logs.select("id", language.alias("language"), (1 / total).alias("posterior"), (language != UNDETERMINED).alias("kept"))
