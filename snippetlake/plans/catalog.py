"""The registered queries: every operator over whole tables of a scale-factor folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from ..functions.vectors import l2_normalize
from ..operators import cellsearch, changes, clusters, components, context, encode, extract, maintenance, mergetree, nearjoin, numbering, pivottree, report, search, treepieces, ward
from ..session import cut, shared_dir, spread
from ..sources import files as S
from ..sources import manifest as M
from ..sources.listed import ListedFiles
from ..sources.store import ModelMismatch, VectorStore
from ..streaming import change_stream, ingest_stream
from . import derived as D
from .cluster import cluster as store_clusters
from .clusterstate import ClusterState
from .ingest import remove_files as drop_files
from .ingest import upsert
from .query import search as stored_hits

EMBEDDING_DISTANCE = 1.2
ROUTE_CHUNK = 64
SEARCH_CELLS = 64
TEXT_DISTANCE = 0.2
TREE_PIECE = 96
LISTED_STRETCH = 4096
TREE_CUTS = (1.0, 1.1, EMBEDDING_DISTANCE)
IDENTICAL_DISTANCE = 1e-6


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Sources, paths, fingerprints


def manifest_scan(spark, sf):
    return M.usable_entries(D.manifest(spark, sf))


def manifest_rejects(spark, sf):
    return M.manifest_rejects(D.manifest(spark, sf), D.sources(spark, sf), D.trees(spark, sf))


def manifest_summary(spark, sf):
    entries = M.usable_entries(D.manifest(spark, sf))
    return entries.agg(F.count("*").alias("entries"), F.countDistinct("path").alias("files"), F.count("tree_path").alias("with_tree"))


def manifest_config(spark, sf):
    """Every document as a manifest of its own, some with a model name or a batch size."""
    i = F.col("doc_id")
    doc = D.table(spark, sf, "documents").select(F.when(i % 3 == 0, F.col("lang")).alias("model_name"), F.when(i % 4 == 0, (i % 64).cast("int")).alias("batch_size"))
    return M.manifest_config(doc, "token-hash-256").groupBy("model_name", "batch_size").agg(F.count("*").alias("manifests"))


def source_decode(spark, sf):
    return S.decode_sources(D.raw_files(spark, sf)).select("path", "content", "md5", F.unix_micros("mtime").alias("mtime_micros"))


def source_rejects(spark, sf):
    return S.undecodable(D.raw_files(spark, sf))


def listed_files(spark, sf):
    """Every manifest entry through the reader of listed files, over files written from the documents."""
    folder = _scratch(spark, "listed")
    entries = D.landed_files(spark, sf, folder)
    spark.dataSource.register(ListedFiles)
    read = spark.read.format("listed_files").option("root", f"{folder}/files").option("stretch", LISTED_STRETCH).load(entries)
    below = [F.concat(F.lit("/proj"), F.substring(c, len(f"{folder}/files") + 1, 1000)).alias(c) for c in ("path", "tree_path")]
    return read.select(*below, "content", "md5", F.col("tree").isNotNull().alias("has_tree"), "reason")


def path_normalize(spark, sf):
    url = F.regexp_extract("url", r"^https?://([^/]*)/(.*)$", 1), F.regexp_extract("url", r"^https?://([^/]*)/(.*)$", 2)
    raw = F.concat(F.lit("/srv//./"), url[0], F.lit("/tmp/.././"), url[1])
    relative = F.concat(F.lit("sub/../"), url[0], F.lit("/x"))
    return D.table(spark, sf, "pages").select(
        "page_id", P.normalize_path(raw).alias("path"), P.normalize_path(relative, "/root/dir").alias("below_root")
    )


def file_fingerprint(spark, sf):
    return D.sources(spark, sf).select("path", P.file_key(F.col("path")).alias("file_key"), "md5", F.unix_micros("mtime").alias("mtime_micros"))


def ext_and_language(spark, sf):
    docs = D.sources(spark, sf).select("path")
    urls = D.table(spark, sf, "pages").select(F.col("url").alias("path"))
    every = docs.unionByName(urls)
    return every.select("path", P.file_ext(F.col("path")).alias("ext"), P.lang_tag(F.col("path")).alias("lang_tag"))


def ext_list(spark, sf):
    wanted = F.concat(F.lit(" ."), F.upper("lang"), F.lit(", "), "source", F.lit(",..Py ,"), "lang")
    return D.table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(P.parse_ext_list(wanted)), "|").alias("exts"))


# Change planning


def _plan(spark, sf, force=False):
    narrow = ["path", "md5", "mtime"]
    return changes.change_plan(D.snapshot(spark, sf, 2).select(*narrow), D.snapshot(spark, sf, 1).select(*narrow), force)


def change_plan(spark, sf):
    return _plan(spark, sf).select("path", "md5", "status")


def change_plan_counts(spark, sf):
    return changes.plan_counts(_plan(spark, sf))


def change_plan_force(spark, sf):
    return changes.plan_counts(changes.to_process(_plan(spark, sf, force=True)))


def deleted_files(spark, sf):
    return changes.deleted_files(D.snapshot(spark, sf, 1).select("path"), D.snapshot(spark, sf, 2))


# Extraction and text


def _files_with_trees(spark, sf):
    entries = M.usable_entries(D.manifest(spark, sf))
    return extract.join_trees(entries, D.sources(spark, sf).select("path", "content"), D.trees(spark, sf), missing=False)


def extract_functions(spark, sf):
    return extract.explode_functions(extract.functions_per_file(_files_with_trees(spark, sf)))


def extract_in_pieces(spark, sf):
    """Every tree in pieces of a few nodes, each looked at by a task of its own."""
    entries = M.usable_entries(D.manifest(spark, sf))
    return treepieces.extract_functions_in_pieces(entries, D.sources(spark, sf), D.trees(spark, sf), chars=TREE_PIECE)


def extract_nested(spark, sf):
    return extract.explode_functions(extract.functions_per_file(_files_with_trees(spark, sf), ("method_definition",)))


def extract_malformed(spark, sf):
    return extract.functions_per_file(_files_with_trees(spark, sf)).select("path", F.size("functions").alias("functions"))


def dedent_text(spark, sf):
    return D.sources(spark, sf).select("path", X.dedent(F.col("content")).alias("text"))


def function_text_50(spark, sf):
    fns = extract_functions(spark, sf).select("path", "ord", "line")
    return context.with_function_text(fns, D.sources(spark, sf))


def function_text_ranges(spark, sf):
    """The same by byte ranges, from offsets of line starts that are written once."""
    fns = extract_functions(spark, sf).select("path", "ord", "line")
    return context.with_function_text(fns, cut(S.with_line_starts(D.sources(spark, sf).select("path", "content"))))


# Vectors and ids


def vector_normalize(spark, sf):
    scaled = F.transform("embedding", lambda x: (x * 3).cast("float"))
    unit = D.table(spark, sf, "embeddings").select("vec_id", l2_normalize(scaled).alias("e"))
    return unit.select("vec_id", F.posexplode_outer("e").alias("pos", "value")).select("vec_id", "pos", F.round(F.col("value").cast("double"), 6).alias("value"))


def hash_encode(spark, sf):
    rows = encode.encode_texts(spread(D.text_table(spark, sf).select("vector_id", "text")), encode.hash_encoder())
    sparse = rows.select("vector_id", F.posexplode_outer("embedding").alias("bucket", "value")).filter("value <> 0")
    return sparse.select("vector_id", "bucket", F.round(F.col("value").cast("double"), 6).alias("value"))


def _letter_model():
    """A model for the adapter: lengths and blanks of a text."""

    def predict(texts):
        return np.array([[len(t), t.count(" "), 1.0] for t in texts], dtype="float32")

    return predict


def model_encode(spark, sf):
    """Texts through the adapter for models, with the dimension found by a dummy text."""
    encoder = encode.model_encoder("lengths", 3, _letter_model, batch_size=64)
    rows = encode.encode_texts(spread(D.text_table(spark, sf).select("vector_id", "text")), encoder)
    values = [F.round(F.col("embedding")[k].cast("double"), 5).alias(f"v{k}") for k in range(3)]
    return rows.select("vector_id", F.lit(encode.declared_dim(spark, encoder)).alias("dim"), *values)


def assign_vector_ids(spark, sf):
    counted = cut(extract.functions_per_file(_files_with_trees(spark, sf))).withColumn("n", F.size("functions"))
    rows = extract.explode_functions(numbering.with_offsets(counted, "path", "n"))
    return rows.select("path", "ord", (F.col("offset") + F.col("ord")).alias("vector_id"))


def assign_vector_ids_levels(spark, sf):
    """The same through three levels of four ranges each, as tables beyond one level of ranges take."""
    counted = cut(extract.functions_per_file(_files_with_trees(spark, sf))).withColumn("n", F.size("functions"))
    narrow = cut(numbering.with_offsets(counted.select("path", "n"), "path", "n", fan_out=4, leaf_rows=16))
    rows = extract.explode_functions(counted.join(narrow.select("path", "offset"), "path"))
    return rows.select("path", "ord", (F.col("offset") + F.col("ord")).alias("vector_id"))


def files_arrays(spark, sf):
    trees = D.trees(spark, sf).select(F.regexp_replace("path", r"\.tree$", "").alias("path"), "tree")
    files = D.sources(spark, sf).join(trees, "path").select("path", "md5", "mtime", "content", "tree")
    per_file = cut(extract.functions_per_file(files))
    lines = per_file.select("path", "md5", "mtime", F.col("functions.line").alias("function_lines")).withColumn("n", F.size("function_lines"))
    records = maintenance.file_records(numbering.with_offsets(lines, "path", "n"))
    text = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("vector_ids", "function_lines")]
    return records.select("path", "file_key", "md5", *text)


# The stored table


def snapshot_files(spark, sf, version):
    s = D.snapshot(spark, sf, version)
    tree = D.tree_text(F.size(F.split("content", "\n", -1)), F.col("doc_id"))
    return s.select("path", "content", "md5", "mtime", tree.alias("tree"))


def _two_versions(spark, sf, **second):
    store = VectorStore(spark, _scratch(spark, "store"))
    encoder = encode.hash_encoder()
    upsert(store, snapshot_files(spark, sf, 1), encoder)
    upsert(store, snapshot_files(spark, sf, 2), encoder, **second)
    return store


def upsert_current_view(spark, sf):
    return _two_versions(spark, sf).vectors().select("vector_id", "path", "ord", "line")


def delete_missing(spark, sf):
    return _two_versions(spark, sf, prune_deleted=True).vectors().select("vector_id", "path", "ord", "line")


def remove_files(spark, sf):
    """Files of good quality leave the table, but only below one project's folder"""
    store = VectorStore(spark, _scratch(spark, "store"))
    encoder = encode.hash_encoder()
    upsert(store, snapshot_files(spark, sf, 1), encoder)
    drop_files(store, D.allowed_files(spark, sf), "/proj/src1")
    return store.functions()


def compacted_view(spark, sf):
    store = _two_versions(spark, sf, prune_deleted=True)
    store.compact()
    return store.functions()


def model_switch(spark, sf):
    store = VectorStore(spark, _scratch(spark, "store"))
    upsert(store, snapshot_files(spark, sf, 1), encode.hash_encoder())
    upsert(store, snapshot_files(spark, sf, 2), encode.hash_encoder(64))
    head = store.head()
    return store.vectors().agg(F.count("*").alias("vectors"), F.min("vector_id").alias("first_id"), F.max("vector_id").alias("last_id")).select(
        F.lit(head.model_name).alias("model_name"), F.lit(head.dim).alias("dim"), F.lit(head.next_vector_id).alias("next_vector_id"), "vectors", "first_id", "last_id"
    )


def stream_ingest(spark, sf):
    """Both versions arrive as files of a stream; each start takes what is there."""
    store, landing, progress = (VectorStore(spark, _scratch(spark, "store")), _scratch(spark, "landing"), _scratch(spark, "progress"))
    for version in (1, 2):
        batch = snapshot_files(spark, sf, version)
        batch.write.mode("append").parquet(landing)
        arriving = spark.readStream.schema(batch.schema).parquet(landing)
        ingest_stream(arriving, store, encode.hash_encoder(), progress, name=f"stream-{uuid.uuid4().hex}").awaitTermination()
    return store.vectors().select("path", "ord", "line")


def stream_changes(spark, sf):
    """Versions of all files out of order, in three starts of one query: of every fourth document the second version
    comes before the first, and in the end all second versions come again."""
    landing, out, progress = (_scratch(spark, name) for name in ("landing", "changes", "progress"))
    first, second = (D.snapshot(spark, sf, v).select("path", "md5", "mtime", (F.col("doc_id") % 4 == 0).alias("turned")) for v in (1, 2))
    turned = F.col("turned")
    for files in (second.where(turned).unionByName(first.where(~turned)), first.where(turned).unionByName(second.where(~turned)), second):
        files.drop("turned").write.mode("append").parquet(landing)
        arriving = spark.readStream.schema(files.drop("turned").schema).parquet(landing)
        sink = change_stream(arriving).writeStream.format("parquet").option("path", out).option("checkpointLocation", progress)
        sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def encode_once(spark, sf):
    """Two versions with vectors kept by content: every text that was encoded, by which batch, its vector
    in brief, and how many functions in force use it."""
    store = VectorStore(spark, _scratch(spark, "store"))
    encoder = replace(encode.hash_encoder(), reuse=True)
    for version in (1, 2):
        upsert(store, snapshot_files(spark, sf, version), encoder)
    total = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")), 6)
    # texts of the same tokens have the same vector, so functions are counted by vector; sorts compare its hash first,
    # since a vector as a key is made anew from its values for every comparison
    hashed = F.xxhash64("embedding").alias("hash")
    used = store.vectors().groupBy(hashed, "embedding").agg(F.count("*").alias("functions"))
    texts = store.encodings().vectors(encoder.name).select("*", hashed)
    return texts.join(used, ["hash", "embedding"], "left").select(
        F.lower(F.hex("digest")).alias("digest"),
        F.col("batch_id").alias("batch"),
        F.size(F.filter("embedding", lambda x: x != 0)).alias("buckets"),
        total(F.col("embedding")).alias("total"),
        F.coalesce("functions", F.lit(0)).alias("functions"),
    )


def orphan_vectors(spark, sf):
    return maintenance.orphans(D.vectors(spark, sf), D.live_functions(spark, sf)).select("vector_id", "path")


def orphan_prune(spark, sf):
    return maintenance.prune_orphans(D.vectors(spark, sf), D.live_functions(spark, sf)).select("vector_id", "path", "line")


def index_counts(spark, sf):
    v, live = D.vectors(spark, sf).select("vector_id"), D.live_functions(spark, sf)
    marked = v.join(live.withColumn("live", F.lit(1)), "vector_id", "left")
    return marked.agg(F.count("*").alias("vectors"), F.sum(F.when(F.col("live").isNull(), 1).otherwise(0)).alias("orphans"))


def list_functions(spark, sf):
    """Listing from array records of unequal length: lines of a document against the ids
    of its labelled neighbours."""
    d = D.table(spark, sf, "documents").select("doc_id", D.document_path().alias("path"), F.size(F.split("text", "\n", -1)).alias("n"))
    records = d.select(
        "path",
        F.sequence(F.lit(0), F.col("n") - 1).alias("function_lines"),
        F.sequence(F.col("doc_id") * 1000, F.col("doc_id") * 1000 + F.col("doc_id") % 5).alias("vector_ids"),
    )
    return maintenance.list_functions(records)


def vectors_by_id(spark, sf):
    ids = D.table(spark, sf, "benchmark").select(F.col("item_id").alias("vector_id"))
    got = maintenance.vectors_by_id(D.vectors(spark, sf), ids)
    return got.select("vector_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


def vector_ids_of_files(spark, sf):
    return maintenance.vector_ids_of_files(D.vectors(spark, sf).select("path", "vector_id"), D.allowed_files(spark, sf))


# Search


def _hits(spark, sf, queries=None, **filters):
    vectors = search.restrict(D.vectors(spark, sf), **filters)
    return search.top_k(vectors, D.vector_queries(spark, sf) if queries is None else queries)


def _hit_columns(hits):
    return _rounded(hits.select("query_id", "rank", "score", "vector_id", "path", "line"), "score")


def first_vector(spark, sf):
    return D.table(spark, sf, "embeddings").filter("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def search_topk(spark, sf):
    return _hit_columns(_hits(spark, sf, first_vector(spark, sf)))


def search_topk_ext(spark, sf):
    return _hit_columns(_hits(spark, sf, first_vector(spark, sf), extensions=P.parse_extensions(" .PY, js")))


def search_topk_files(spark, sf):
    return _hit_columns(_hits(spark, sf, first_vector(spark, sf), files=D.allowed_files(spark, sf)))


def search_topk_both(spark, sf):
    return _hit_columns(_hits(spark, sf, first_vector(spark, sf), files=D.allowed_files(spark, sf), extensions=["py"]))


def search_live(spark, sf):
    return _hit_columns(_hits(spark, sf, functions=D.live_functions(spark, sf)))


def search_batch(spark, sf):
    return _hit_columns(_hits(spark, sf))


def search_all_pairs_of_blocks(spark, sf):
    """Every vector is a query, by the route for query sets of any size."""
    v = D.vectors(spark, sf)
    queries = v.select(F.col("vector_id").alias("query_id"), "embedding")
    return _hit_columns(search.top_k(v, queries, max_broadcast=0))


def search_cells(spark, sf):
    """The five documents nearest to every document, by cells that were placed once."""
    vectors = cut(_encoded_documents(spark, sf))
    index = cellsearch.build_cells(vectors, SEARCH_CELLS)
    return _hit_columns(cellsearch.top_k_cells(index, vectors.select(F.col("vector_id").alias("query_id"), "embedding")))


def text_search(spark, sf):
    encoder = encode.hash_encoder()
    vectors = encode.encode_texts(spread(D.text_table(spark, sf)), encoder)
    return _hit_columns(search.top_k(vectors, search.text_queries(D.benchmark_queries(spark, sf), encoder)))


def stored_search(spark, sf):
    """Ingest, then search the stored functions of two languages for all passages."""
    store, encoder = VectorStore(spark, _scratch(spark, "store")), encode.hash_encoder()
    upsert(store, snapshot_files(spark, sf, 1), encoder)
    return _hit_columns(stored_hits(store, D.benchmark_queries(spark, sf), encoder, extensions=["py", "js"]))


def search_blank(spark, sf):
    """Queries that are asked: blank texts are not."""
    asked = search.text_queries(D.some_blank_queries(spark, sf), encode.hash_encoder())
    return asked.select("query_id", F.size(F.filter("embedding", lambda x: x != 0)).alias("buckets"))


def search_mismatch(spark, sf):
    """A search with another encoder than the table's is refused."""
    store = VectorStore(spark, _scratch(spark, "store"))
    upsert(store, snapshot_files(spark, sf, 1), encode.hash_encoder())
    try:
        return stored_hits(store, D.benchmark_queries(spark, sf), encode.hash_encoder(64))
    except ModelMismatch as refused:
        return store.vectors().agg(F.count("*").alias("vectors")).select(F.lit(str(refused)).alias("refused"), "vectors")


def hit_snippets(spark, sf):
    hits = context.with_snippets(_hits(spark, sf), D.sources(spark, sf))
    return hits.select("query_id", "rank", "path", "start_line", "end_line", "snippet")


def hit_snippet_ranges(spark, sf):
    """The same by byte ranges, from offsets of line starts that are written once."""
    sources = cut(S.with_line_starts(D.sources(spark, sf).select("path", "content")))
    hits = context.with_snippets(_hits(spark, sf), sources)
    return hits.select("query_id", "rank", "path", "start_line", "end_line", "snippet")


def search_markdown(spark, sf):
    hits = context.with_snippets(_hits(spark, sf), D.sources(spark, sf))
    return report.search_markdown(hits, D.vector_queries(spark, sf))


# Near-duplicates


def _embedding_points(spark, sf):
    e = D.table(spark, sf, "embeddings")
    return cut(e.select(F.col("vec_id").alias("id"), F.lit(1).cast("long").alias("weight"), F.col("embedding").alias("vec")))


def eps_join(spark, sf):
    return _rounded(nearjoin.near_join(_embedding_points(spark, sf), EMBEDDING_DISTANCE), "distance")


def eps_join_tree(spark, sf):
    """The same pairs by three levels of pivots, four below each crowded cell."""
    pairs = pivottree.near_join_tree(_embedding_points(spark, sf), EMBEDDING_DISTANCE, chunk=ROUTE_CHUNK, fan_out=4, levels=3, always=True)
    return _rounded(pairs, "distance")


def connected_components(spark, sf):
    forest = nearjoin.near_join(_embedding_points(spark, sf), EMBEDDING_DISTANCE, "forest")
    return components.connected_components(forest)


def nearest_neighbour(spark, sf):
    best = nearjoin.near_join(_embedding_points(spark, sf), EMBEDDING_DISTANCE, "nearest")
    one = best.groupBy("id").agg(F.min(F.struct("height", "partner", "h2")).alias("b"))
    return one.select("id", F.col("b.partner").alias("partner"), F.round(F.sqrt("b.h2"), 6).alias("distance"))


def _encoded_documents(spark, sf):
    return encode.encode_texts(spread(D.text_table(spark, sf)), encode.hash_encoder())


def dup_vectors(spark, sf):
    points = clusters.distinct_points(clusters.unit_vectors(_encoded_documents(spark, sf)))
    return points.select(F.col("id").alias("vector_id"), F.col("weight").alias("copies"))


def ward_labels(spark, sf):
    owner = ward.ward_clusters(_embedding_points(spark, sf), EMBEDDING_DISTANCE)
    return owner.select(F.col("id").alias("vector_id"), "cluster_id")


def ward_labels_rounds(spark, sf):
    """Every component by distributed rounds."""
    owner = ward.ward_clusters(_embedding_points(spark, sf), EMBEDDING_DISTANCE, cap=0, chunk=ROUTE_CHUNK)
    return owner.select(F.col("id").alias("vector_id"), "cluster_id")


def ward_labels_levels(spark, sf):
    """By way of the lower cuts that large tables take."""
    levels = [EMBEDDING_DISTANCE / 4, EMBEDDING_DISTANCE / 2]
    owner = ward.ward_clusters(_embedding_points(spark, sf), EMBEDDING_DISTANCE, levels=levels)
    return owner.select(F.col("id").alias("vector_id"), "cluster_id")


def _embedding_tree(spark, sf):
    points = _embedding_points(spark, sf)
    return points, mergetree.MergeTree(cut(ward.ward_merges(points, EMBEDDING_DISTANCE)[1]), EMBEDDING_DISTANCE)


def merge_tree(spark, sf):
    """Every merge of the embeddings, in order, from a tree that was stored."""
    place = _scratch(spark, "tree")
    _embedding_tree(spark, sf)[1].save(place)
    return _rounded(mergetree.load_tree(spark, place).steps(), "height")


def cut_tree(spark, sf):
    """One tree, cut at three heights."""
    points, tree = _embedding_tree(spark, sf)
    cuts = [tree.labels(points.select("id"), t).select(F.lit(t).alias("max_distance"), F.col("id").alias("vector_id"), "cluster_id") for t in TREE_CUTS]
    return reduce(DataFrame.unionByName, cuts)


def tree_clusters(spark, sf):
    """Clusters of the documents at two heights, sizes and first merges looked up in one tree."""
    vectors = cut(_encoded_documents(spark, sf).select("vector_id", "embedding"))
    tree = clusters.merge_tree(vectors, TEXT_DISTANCE)
    ids = clusters.unit_vectors(vectors).select(F.col("vector_id").alias("id"))
    found = [tree.clusters(ids, t).withColumn("max_distance", F.lit(t)) for t in (TEXT_DISTANCE, TEXT_DISTANCE / 2)]
    return _rounded(reduce(DataFrame.unionByName, found), "first_merge_distance")


def ward_clusters(spark, sf):
    found, _ = clusters.find_clusters(_encoded_documents(spark, sf), TEXT_DISTANCE)
    return _rounded(found, "first_merge_distance", "avg_distance")


def _two_vector_tables(spark, sf):
    """The encoded documents, and the same after every seventh was edited (under a new id) and every thirteenth removed."""
    i = F.col("doc_id")
    d = D.table(spark, sf, "documents").select("doc_id", "text")
    edited = d.filter(i % 7 == 0).select((i + 1_000_000).alias("vector_id"), F.concat("text", F.lit("\nend")).alias("text"))
    second = d.filter((i % 7 != 0) & (i % 13 != 0)).select(i.alias("vector_id"), "text").unionByName(edited)
    return [encode.encode_texts(spread(t), encode.hash_encoder()) for t in (d.select(i.alias("vector_id"), "text"), second)]


def clusters_after_upsert(spark, sf):
    """Clusters kept up to date over two states of the table."""
    state = ClusterState(spark, _scratch(spark, "clusters"), TEXT_DISTANCE)
    for vectors in _two_vector_tables(spark, sf):
        state.update(cut(vectors))
    return _rounded(state.clusters(), "first_merge_distance", "avg_distance")


def _report_sources(spark, sf):
    return D.table(spark, sf, "documents").select(D.document_path().alias("path"), F.col("text").alias("content"))


def cluster_filters(spark, sf):
    found, members = clusters.find_clusters(_encoded_documents(spark, sf), TEXT_DISTANCE)
    kept, rows = clusters.filter_clusters(found, members, _report_sources(spark, sf), min_lines=2)
    return _rounded(rows.join(kept.select("cluster_id", "size", "avg_distance"), "cluster_id").select("cluster_no", "cluster_id", "size", "avg_distance", "vector_id", "path", "line", "line_count"), "avg_distance")


def identical_clusters(spark, sf):
    found, members = clusters.find_clusters(_encoded_documents(spark, sf), IDENTICAL_DISTANCE)
    _, rows = clusters.filter_clusters(found, members, _report_sources(spark, sf), min_lines=3, min_cluster_size=3, ignore_identical=False)
    return rows.select("cluster_no", "cluster_id", "vector_id", "path", "line", "line_count")


def cluster_report(spark, sf):
    found, members = clusters.find_clusters(_encoded_documents(spark, sf), IDENTICAL_DISTANCE)
    return report.cluster_report(*clusters.filter_clusters(found, members, _report_sources(spark, sf), ignore_identical=False))


def cluster_report_near(spark, sf):
    """Near groups at the default distance, without identical ones, with their distances."""
    found, members = clusters.find_clusters(_encoded_documents(spark, sf), TEXT_DISTANCE)
    return report.cluster_report(*clusters.filter_clusters(found, members, _report_sources(spark, sf)))


def cluster_build(spark, sf):
    """A report from a table that is not there yet: it is built first."""
    store, encoder = VectorStore(spark, _scratch(spark, "store")), encode.hash_encoder()
    build = lambda: upsert(store, snapshot_files(spark, sf, 1), encoder)
    sources = D.snapshot(spark, sf, 1).select("path", "content")
    return store_clusters(store, encoder, sources, IDENTICAL_DISTANCE, build, ignore_identical=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        manifest_scan,
        manifest_rejects,
        manifest_summary,
        manifest_config,
        source_decode,
        listed_files,
        source_rejects,
        path_normalize,
        file_fingerprint,
        ext_and_language,
        ext_list,
        change_plan,
        change_plan_counts,
        change_plan_force,
        deleted_files,
        extract_functions,
        extract_in_pieces,
        extract_nested,
        extract_malformed,
        dedent_text,
        function_text_50,
        function_text_ranges,
        vector_normalize,
        hash_encode,
        model_encode,
        assign_vector_ids,
        assign_vector_ids_levels,
        files_arrays,
        upsert_current_view,
        delete_missing,
        remove_files,
        compacted_view,
        model_switch,
        stream_ingest,
        stream_changes,
        encode_once,
        orphan_vectors,
        orphan_prune,
        index_counts,
        list_functions,
        vectors_by_id,
        vector_ids_of_files,
        search_topk,
        search_topk_ext,
        search_topk_files,
        search_topk_both,
        search_live,
        search_batch,
        search_all_pairs_of_blocks,
        search_cells,
        text_search,
        stored_search,
        search_blank,
        search_mismatch,
        hit_snippets,
        hit_snippet_ranges,
        search_markdown,
        eps_join,
        eps_join_tree,
        connected_components,
        nearest_neighbour,
        dup_vectors,
        ward_labels,
        ward_labels_rounds,
        ward_labels_levels,
        merge_tree,
        cut_tree,
        tree_clusters,
        clusters_after_upsert,
        ward_clusters,
        cluster_filters,
        identical_clusters,
        cluster_report,
        cluster_report_near,
        cluster_build,
    )
}
