"""Column functions against the Python standard library."""

import hashlib
import os
import random
import textwrap

from pyspark.sql import functions as F

from snippetlake.functions import paths as P
from snippetlake.functions import text as X
from snippetlake.functions.vectors import euclidean, inner_product, l2_normalize


def column(spark, values, kind="string"):
    return spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")


def apply(spark, values, fn, kind="string"):
    rows = column(spark, values, kind).select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def random_paths(n, seed=1):
    rng = random.Random(seed)
    parts = ["a", "b.py", "..", ".", "", "c d", ".git", "x.tar.gz", "...", "ü"]
    return ["/" * rng.choice([1, 1, 1, 2, 3]) + "/".join(rng.choice(parts) for _ in range(rng.randint(0, 7))) for _ in range(n)]


def test_normalize_path(spark):
    values = random_paths(400) + ["/", "//", "///", "/..", "//..//a"]
    assert apply(spark, values, P.normalize_path) == [os.path.normpath(v) for v in values]
    relative = ["a", "./a/../b", "../x", "a//b/", "/abs/./x"]
    assert apply(spark, relative, lambda c: P.normalize_path(c, "/root/dir")) == [
        os.path.normpath(os.path.join("/root/dir", v)) for v in relative
    ]


def test_file_key_and_extension(spark):
    values = [os.path.normpath(p) for p in random_paths(200, 2)] + ["/a/.bashrc", "/a/x.", "/a/..b", "/a/.c.D", "/x.PY", "/a.b/c"]
    assert apply(spark, values, P.file_key) == [hashlib.sha256(v.encode()).hexdigest()[:16] for v in values]
    assert apply(spark, values, P.file_ext) == [os.path.splitext(v)[1].lstrip(".").lower() for v in values]


def test_extension_lists(spark):
    for text in ("py,js", " .PY , js,.py", "..Go", "rs"):
        expected = sorted({e.strip().lstrip(".").lower() for e in text.split(",")})
        assert sorted(apply(spark, [text], P.parse_ext_list)[0]) == expected
        assert P.parse_extensions(text) == expected


def test_language_tags(spark):
    values = ["a.py", "a.h", "a.c", "a.hpp", "a.cpp", "a.ktm", "a.vapi", "a.PY", "a.txt", "a.rs", "a.ts", "py"]
    assert apply(spark, values, P.lang_tag) == ["python", "c", "c", "cpp", "cpp", "kotlin", "vala", "", "", "rust", "typescript", ""]


def test_uri_to_path(spark):
    values = ["file:/a/b", "file:///a/b", "hdfs://host:8020/a/b", "/a/b", "s3a://bucket/a"]
    assert apply(spark, values, P.uri_to_path) == ["/a/b", "/a/b", "/a/b", "/a/b", "/a"]


def random_blocks(n, seed=3):
    rng = random.Random(seed)
    starts = ["", " ", "  ", "    ", "\t", "\t ", " \t", "      "]
    words = ["x", "def f():", "", " ", "é y", "\t"]
    return ["\n".join(rng.choice(starts) + rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(n)]


def test_dedent(spark):
    values = random_blocks(500) + ["", "\n", "  a\n\n    b\n", "\ta\n\t\tb"]
    assert apply(spark, values, X.dedent) == [textwrap.dedent(v) for v in values]


def test_newlines_and_stripping(spark):
    values = ["a\r\nb\rc\n", "\r\r\n", "x"]
    assert apply(spark, values, X.normalize_newlines) == [v.replace("\r\n", "\n").replace("\r", "\n") for v in values]
    ends = ["a \n", "a\u00a0", "a\u2003\t", "a\x1c", "a\x85", "a\x0b", " a ", "", " \n "]
    assert apply(spark, ends, X.rstrip) == [v.rstrip() for v in ends]
    assert apply(spark, ends, X.strip) == [v.strip() for v in ends]


def reader_lines(text):
    return text.splitlines(keepends=True) if "\n" in text else ([text] if text else [])


def test_snippets_and_function_text(spark):
    texts = ["", "a", "a\n", "\n\n", "l0\nl1\nl2\nl3  \nl4\nl5\nl6\n", "\n".join(f"l{i}" for i in range(80))]
    cases = [(t, line) for t in texts for line in (0, 1, 3, 6, 30, 79)]
    df = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(cases)], "i int, t string, n int")
    lines = X.readable_lines(F.col("t"))
    got = df.select(
        "i",
        X.context_start(F.col("n")).alias("s"),
        X.context_end(lines, F.col("n")).alias("e"),
        X.context_snippet(lines, F.col("n")).alias("snippet"),
        X.function_text(lines, F.col("n"), F.lit("/p")).alias("body"),
        X.line_count(X.function_text(lines, F.col("n"), F.lit("/p"))).alias("count"),
    ).orderBy("i")
    for (text, n), row in zip(cases, got.collect()):
        ls = reader_lines(text)
        start, end = max(0, n - 2), min(len(ls), n + 3)
        body = "".join(ls[n : min(len(ls), n + 50)]).rstrip()
        assert (row.s, row.e, row.snippet) == (start, end, "".join(ls[start:end]).rstrip())
        assert (row.body, row["count"]) == (body, len(body.split("\n")))


def test_number_formats(spark):
    scores = [0.0, 1.0, 0.3125, 0.4375, -0.0625, 0.9999, 0.12345, 0.41149999, 0.0625, 2 / 3]
    assert apply(spark, scores, X.format_score, "double") == [f"{s:.3f}" for s in scores]
    distances = [0.0, 0.1, 0.123456, 1.5, 1.0, 0.2, 0.00001234, 0.00001, 0.1999, 0.05, 0.0999999, 12.345]
    assert apply(spark, distances, X.format_distance, "double") == [f"{d:.3}" for d in distances]


def test_indent(spark):
    values = ["a", "a\n\nb", "  x\n \n\ty", ""]
    assert apply(spark, values, X.indent) == [textwrap.indent(v, "    ") for v in values]


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    rows = df.select(
        inner_product(F.col("a"), F.col("b")).alias("dot"),
        euclidean(F.col("a"), F.col("b")).alias("d"),
        l2_normalize(F.col("a")).alias("unit"),
    ).collect()
    assert rows[0].dot == 11.0 and abs(rows[0].d - 8**0.5) < 1e-12
    assert [round(x, 6) for x in rows[0].unit] == [0.6, 0.8]
    assert rows[1].unit == [0.0, 0.0]


def test_blank_extension_list_is_no_filter():
    assert P.parse_extensions("") == P.parse_extensions("  ") == []
