"""Texts cut by offsets of line starts against texts split into lines."""

import random

from pyspark.sql import functions as F

from snippetlake.operators.context import with_function_text, with_snippets
from snippetlake.sources.files import with_line_starts


def test_ranges_equal_lines(spark):
    rng = random.Random(2)
    made = ["", "\n", "\n\n", "one", "é\nß漢\n\n", "a\n \n", None, " x \n" * 200]
    made += ["".join(rng.choice(["a", "é", "漢", "𝄞", "\n", " ", "\t", " "]) for _ in range(rng.randrange(300))) for _ in range(60)]
    sources = spark.createDataFrame([(f"/{i}", t) for i, t in enumerate(made)], "path string, content string").repartition(3)
    lines = [(i, f"/{i}", line) for i in range(len(made) + 1) for line in (0, 1, 2, 3, 7, 60, 199, 200, 500)]
    hits = spark.createDataFrame(lines, "hit long, path string, line int")
    indexed = with_line_starts(sources)
    columns = ["hit", "line", "start_line", "end_line", "snippet"]
    known = sources.where("content is not null")
    plain = with_snippets(hits, known).select(*columns).collect()
    assert sorted(with_snippets(hits, with_line_starts(known)).select(*columns).collect()) == sorted(plain) and len(plain) > 500
    for content in (sources, sources.limit(0)):
        expected = sorted(with_function_text(hits, content).collect())
        assert sorted(with_function_text(hits, with_line_starts(content)).collect()) == expected
    starts = {r.path: r.line_starts for r in indexed.where(F.col("path").isin("/0", "/1", "/2", "/3", "/4", "/6")).collect()}
    assert starts == {"/0": [0], "/1": [0, 1], "/2": [0, 1, 2], "/3": [0, 3], "/4": [0, 3, 9, 10], "/6": None}


def test_other_columns_are_kept(spark):
    rows = spark.createDataFrame([("/a", "x\ny", 3, "z")], "path string, content string, `a b` int, starts string")
    assert [tuple(r) for r in with_line_starts(rows).collect()] == [("/a", "x\ny", 3, "z", [0, 2, 3])]
