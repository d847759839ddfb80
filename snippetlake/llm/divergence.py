"""How far the sources of a language diverge in the terms they use, with strings joined late.

Workers count terms per batch and send on fixed-width rows only: language and group as 64-bit names, a
64-bit digest of the term, and two counts. Digests of too few documents are gone before a string is
shuffled, as a digest cannot have fewer documents than a term under it. For the others one pass fetches the
least and the greatest string of each; where they differ, terms have collided, and that digest alone is counted
again by string and split. Strings are joined to the reported terms only.

Divergence of a pair sums a function of two shares over all kept terms, also those that one or both sides
lack. Rows of terms list (group, share) of the sources that have them; workers sum over batches of
terms against all sources of a bounded shard, so pairs leave a batch once, not once a term.

All shares and values are integers; products that could leave 64 bits are divided in two steps.

Defined cases: null text, language or source is the empty string; every row is a document of its own,
repeated ids and rows included; a (language, source) without terms is listed in pairs, with shares of absent terms
only; a language without kept terms has pairs of value 0 and no term rows; a language of one source has no pairs;
an empty table gives no rows; ties go to the lesser item in UTF-8 order; further columns are not read.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snippetlake.llm import words
from snippetlake.llm.tokenout import slices, small_batches
from snippetlake.llm.tokens import forget
from snippetlake.session import cut

#: Fixed values of the measure: a share is 1 + floor(SCALE * (count + 2) / (total + 2 * kept terms)).
SCALE, LEAST_DOCS, TOP = 1_000_000_000, 10, 10
#: SCALE in two factors, so that a remainder times either stays within 64 bits.
SCALE_A, SCALE_B = 32_000, 31_250
#: Term bytes: letters, A-Z lower-cased, and every byte of a character beyond ASCII; others separate.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
#: Rows and bytes up to which a side is broadcast, sources in a shard of pairs, matrix cells at once, strings a task recalls.
BROADCAST_ROWS, BROADCAST_BYTES, SHARD, CELLS, RECALL = 1 << 20, 32 << 20, 1 << 18, 1 << 21, 200_000


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased terms of all texts in one array, and the bounds of each text."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    if data is None:
        return pa.array([], pa.large_string()), np.zeros(len(texts) + 1, np.int64)
    folded = pa.py_buffer(_FOLD[np.frombuffer(data, np.uint8)])
    return words.split(pa.LargeStringArray.from_buffers(len(texts), offsets, folded, offset=texts.offset))


def _digests(terms: pa.Array, mask: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) & mask for t in terms.cast(pa.large_binary()).to_pylist()), np.uint64, len(terms)).view(np.int64)


def _counted(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms; then one row per (group, term) of the batch: first row of the group, code of the
    term, occurrences, documents."""
    flat, bounds = terms_of(batch.column(2))
    coded = flat.dictionary_encode()
    codes, size = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
    groups, first, group_of = np.unique(batch.column(1).to_numpy(), return_index=True, return_inverse=True)
    doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
    in_doc, times = np.unique(doc * size + codes, return_counts=True)
    cell, at = np.unique(group_of[in_doc // size] * size + in_doc % size, return_inverse=True)
    n = np.zeros(len(cell), np.int64)
    np.add.at(n, at, times)
    return coded.dictionary, first[cell // size], cell % size, n, np.bincount(at, minlength=len(cell))


def _counts(mask: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, "text"):
            terms, row, code, n, docs = _counted(batch)
            lang, group = (batch.column(i).to_numpy()[row] for i in (0, 1))
            yield pa.record_batch({"lid": lang, "gid": group, "digest": _digests(terms, mask)[code], "n": n, "docs": docs})

    return work


def _strings(mask: int):
    """(digest, term), most of them once a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        told: set[str] = set()
        for batch in slices(batches, "text"):
            distinct = [t for t in terms_of(batch.column(0))[0].unique().to_pylist() if t not in told]
            if len(told) + len(distinct) > RECALL:
                told.clear()
            told.update(distinct)
            terms = pa.array(distinct, pa.large_string())
            yield pa.record_batch({"digest": _digests(terms, mask), "term": terms.cast(pa.string())})

    return work


def _spelled(mask: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            terms, row, code, n, docs = _counted(batch)
            lang, group = (batch.column(i).to_numpy()[row] for i in (0, 1))
            spelled = terms.take(pa.array(code)).cast(pa.string())
            yield pa.record_batch({"lid": lang, "gid": group, "digest": _digests(terms, mask)[code], "term": spelled, "n": n, "docs": docs})

    return work


def _value(p, q):
    """f of two shares, for columns of numbers and of Spark alike where ``//`` is floor division."""
    return (p - q) * (p - q) // (p + q)


def _sums(shard: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Partial sums (g, h, value, union) over terms that g or h has; ``shard`` has, by language, its
    sources in ascending order and their shares of absent terms."""

    def chunk(gid, p, term, size, columns, zero) -> Iterator[pa.RecordBatch]:
        matrix, present = np.tile(zero, (size, 1)), np.zeros((size, len(columns)), bool)
        at = np.minimum(np.searchsorted(columns, gid), len(columns) - 1)
        hit = columns[at] == gid
        matrix[term[hit], at[hit]], present[term[hit], at[hit]] = p[hit], True
        order = np.argsort(gid, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], gid[order][1:] != gid[order][:-1]]))
        for a, b in zip(starts, [*starts[1:], len(gid)], strict=True):
            rows = order[a:b]
            f, lacks = _value(p[rows][:, None], matrix[term[rows]]), ~present[term[rows]]
            own = np.full(len(columns), gid[rows[0]])
            yield pa.record_batch({"g": own, "h": columns, "value": f.sum(0), "terms": np.full(len(columns), len(rows), np.int64)})
            # seen from the other side, which lacks the term; f is symmetric
            yield pa.record_batch({"g": columns, "h": own, "value": np.where(lacks, f, 0).sum(0), "terms": lacks.sum(0).astype(np.int64)})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, lists = batch.column(0).to_numpy(), batch.column(1)
            bounds = lists.offsets.to_numpy()
            flat = lists.flatten()
            gid, p = flat.field("gid").to_numpy(), flat.field("p").to_numpy()
            bounds = bounds - bounds[0]
            for lang in np.unique(langs):
                if lang not in shard:
                    continue
                columns, zero = shard[lang]
                rows = np.flatnonzero(langs == lang)
                step = max(1, CELLS // len(columns))
                for a in range(0, len(rows), step):
                    some = rows[a : a + step]
                    entries = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in some])
                    term = np.repeat(np.arange(len(some)), bounds[some + 1] - bounds[some])
                    yield from chunk(gid[entries], p[entries], term, len(some), columns, zero)

    return work


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), without leaving 64 bits; null if nothing is kept."""
    below = total + kept * 2
    div = lambda a, b: F.call_function("div", a, b)
    whole, rest = div(count + 2, below), F.pmod(count + 2, below)
    high, low = div(rest * SCALE_A, below), F.pmod(rest * SCALE_A, below)
    return F.when(kept > 0, whole * SCALE + high * SCALE_B + div(low * SCALE_B, below) + 1)


def _groups(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Every (lang, source) with names of 64 bits, and the columns that name them."""
    names = cut(docs.select("lang", "source").distinct())
    for seed in itertools.count():
        lid, gid = F.xxhash64(F.lit(seed), "lang"), F.xxhash64(F.lit(seed), "lang", "source")
        n = names.agg(*[F.count_distinct(c) for c in ("lang", lid)], F.count("*"), F.count_distinct(gid)).first()
        if n[0] == n[1] and n[2] == n[3]:
            return names.withColumns({"lid": lid, "gid": gid}), lid, gid


def _small(df: DataFrame, *strings: str) -> DataFrame:
    """``df``, a written table, to be broadcast if its measured rows and bytes allow."""
    size = sum((F.octet_length(c) for c in strings), F.lit(0))
    rows, held = df.agg(F.count("*"), F.sum(size.cast("long"))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (held or 0) <= BROADCAST_BYTES else df.hint("merge")


def kept_terms(read: DataFrame, lid: Column, gid: Column, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(lid, digest, part, n, groups) of every kept term, and (digest, part, term) of every one that is
    kept in some language. ``bits`` of the digest are used; fewer make more collisions, not other results."""
    mask = (1 << bits) - 1
    named = read.select(lid.alias("lid"), gid.alias("gid"), "text")
    key = "lid bigint, gid bigint, digest bigint"
    counts = named.mapInArrow(_counts(mask), f"{key}, n bigint, docs bigint")
    counts = cut(counts.groupBy("lid", "gid", "digest").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    often = counts.groupBy("lid", "digest").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS)
    often = cut(often.select("digest").distinct())
    spelled = read.select("text").mapInArrow(_strings(mask), "digest bigint, term string").join(_small(often), "digest", "left_semi")
    names = cut(spelled.groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high")))
    collided = cut(names.where("low < high").select("digest"))
    counts = counts.withColumn("part", F.lit(0))
    names = names.select("digest", F.lit(0).alias("part"), F.col("low").alias("term"))
    if not collided.isEmpty():
        side = _small(collided)
        apart = named.mapInArrow(_spelled(mask), f"{key}, term string, n bigint, docs bigint").join(side, "digest", "left_semi")
        apart = cut(apart.groupBy("lid", "gid", "digest", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
        parts = apart.select("digest", "term").distinct().withColumn("part", F.row_number().over(Window.partitionBy("digest").orderBy("term")))
        parts = cut(parts)
        split = apart.join(parts, ["digest", "term"]).select("lid", "gid", "digest", "n", "docs", "part")
        counts = counts.join(side, "digest", "left_anti").select("lid", "gid", "digest", "n", "docs", "part").unionByName(split)
        names = names.join(side, "digest", "left_anti").unionByName(parts.select("digest", "part", "term"))
    terms = counts.groupBy("lid", "digest", "part").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("gid", "n")).alias("groups"))
    return cut(terms.where(F.col("docs") >= LEAST_DOCS).drop("docs")), names


def _sized(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """``groups`` with the totals that shares need: of the group, of its language, and of kept terms."""
    langs = terms.groupBy("lid").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    own = terms.select(F.inline("groups")).groupBy("gid").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = groups.join(langs, "lid", "left").join(own, "gid", "left").select("lid", "gid", "lang", "source", zero("kept"), zero("lang_total"), zero("total"))
    return cut(out.withColumn("absent", share(F.lit(0), F.col("total"), F.col("kept"))))


def _pairs(entries: DataFrame, sized: DataFrame) -> DataFrame:
    """(g, h, value) of every two sources of a language, from entries (lid, digest, part, gid, p)."""
    lists = entries.groupBy("lid", "digest", "part").agg(F.collect_list(F.struct("gid", "p")).alias("groups")).select("lid", "groups")
    shares = sized.select("lid", "gid", "absent")
    shards = -(-sized.count() // SHARD)
    if shards > 1:
        lists = cut(lists)
    sums = []
    for k in range(shards):
        # at most about SHARD rows of three numbers each
        some = shares.where(F.pmod("gid", F.lit(shards)) == k)
        held = some.where("absent is not null").orderBy("lid", "gid").toPandas()
        by_lang = {int(i): (x["gid"].to_numpy(np.int64), x["absent"].to_numpy(np.int64)) for i, x in held.groupby("lid")}
        sums.append(lists.mapInArrow(_sums(by_lang), "g bigint, h bigint, value bigint, terms bigint"))
        every = shares.select("lid", F.col("gid").alias("g")).join(F.broadcast(some.select("lid", F.col("gid").alias("h"))), "lid")
        sums.append(every.select("g", "h", F.lit(0).cast("long").alias("value"), F.lit(0).cast("long").alias("terms")))
    if not sums:
        return entries.sparkSession.createDataFrame([], "g bigint, h bigint, value bigint")
    added = functools.reduce(DataFrame.unionByName, sums).where("g <> h").groupBy("g", "h").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    side = lambda c: _small(sized.select(F.col("gid").alias(c), F.col("absent").alias(f"{c}_absent"), *(["kept"] if c == "g" else [])))
    both = added.join(side("g"), "g").join(side("h"), "h")
    rest = (F.col("kept") - F.col("terms")) * _divided(F.col("g_absent"), F.col("h_absent"))
    return both.select("g", "h", (F.col("value") + F.coalesce(rest, F.lit(0))).alias("value"))


def _divided(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` against every other source of the language,
    part ``term`` the terms that a source uses more than its language does, up to rank ``TOP``."""
    small_batches(docs.sparkSession)
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    groups, lid, gid = _groups(read)
    terms, names = kept_terms(read, lid, gid, bits)
    sized = _sized(groups, terms)
    sizes = _small(sized.select("gid", "total", "lang_total", "kept"))
    entries = terms.select("lid", "digest", "part", F.col("n").alias("lang_n"), F.inline("groups")).join(sizes, "gid")
    own, other = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    entries = cut(entries.select("lid", "gid", "digest", "part", own.alias("p"), other.alias("q")))
    label = _small(sized.select("gid", "lang", "source"), "lang", "source")
    ranked = lambda key: Window.partitionBy(key).orderBy(F.desc("value"), "item")

    pairs = _pairs(entries.select("lid", "digest", "part", "gid", "p"), sized)
    items = _small(sized.select(F.col("gid").alias("h"), F.col("source").alias("item")), "item")
    pairs = pairs.join(items, "h").select(F.col("g").alias("gid"), "item", "value", F.lit("pair").alias("kind"))
    pairs = pairs.withColumn("rank", F.row_number().over(ranked("gid")))

    # rows that tie with the last rank stay until their strings can decide
    above = entries.where("p > q").select("gid", "digest", "part", _divided(F.col("p"), F.col("q")).alias("value"))
    best = above.withColumn("place", F.rank().over(Window.partitionBy("gid").orderBy(F.desc("value")))).where(F.col("place") <= TOP)
    spelled = cut(best.drop("place")).join(names.withColumnRenamed("term", "item"), ["digest", "part"])
    top = spelled.select("gid", "item", "value", F.lit("term").alias("kind"), F.row_number().over(ranked("gid")).alias("rank")).where(F.col("rank") <= TOP)
    return pairs.unionByName(top).join(label, "gid").select("lang", "source", F.col("kind").alias("part"), "item", "value", "rank")
