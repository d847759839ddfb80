"""Manifest and file scans on real files."""

import hashlib
import json

from pyspark.sql import functions as F

from snippetlake.operators.extract import extract_functions
from snippetlake.sources import files as S
from snippetlake.sources import manifest as M


def write_project(root):
    (root / "src").mkdir()
    (root / "trees").mkdir()
    (root / "src" / "a b.py").write_bytes(b"def f():\r\n    return 1\r\n")
    (root / "src" / "bad.py").write_bytes(b"x = '\xff'\n")
    (root / "src" / "c.py").write_bytes("é = 1\n".encode())
    (root / "trees" / "a.tree").write_text("(module (function_definition [0, 0] - [1, 12]))")
    doc = {
        "files": [
            {"path": "src/./a b.py", "tree_sitter_file": "trees/a.tree"},
            {"path": str(root / "src" / "bad.py"), "tree_sitter_file": "trees/a.tree"},
            {"path": "src/c.py", "tree_sitter_file": "trees/none.tree"},
            {"path": "src/c.py"},
            {"path": "src/none.py", "tree_sitter_file": "trees/a.tree"},
            {"path": "", "tree_sitter_file": "trees/a.tree"},
            {"tree_sitter_file": "trees/a.tree"},
        ],
        "repo_root": "/ignored",
        "batch_size": 8,
    }
    (root / "manifest.json").write_text(json.dumps(doc, indent=2))
    return root


def test_scan_and_extract(spark, tmp_path):
    root = write_project(tmp_path)
    doc = M.read_manifest_json(spark, str(root / "manifest.json"))
    assert tuple(M.manifest_config(doc, "default-model").first()) == ("default-model", 8)
    entries = M.manifest_entries(doc)
    usable = M.usable_entries(entries, str(root))
    assert {r.path for r in usable.collect()} == {f"{root}/src/{n}" for n in ("a b.py", "bad.py", "c.py", "none.py")}

    files = S.read_binary_files(spark, str(root / "src"))
    sources = S.decode_sources(files)
    rows = {r.path: r for r in sources.collect()}
    assert set(rows) == {f"{root}/src/a b.py", f"{root}/src/c.py"}
    first = rows[f"{root}/src/a b.py"]
    assert first.content == "def f():\n    return 1\n"
    assert first.md5 == hashlib.md5(b"def f():\r\n    return 1\r\n").hexdigest()
    assert [r.path for r in S.undecodable(files).collect()] == [f"{root}/src/bad.py"]

    trees = S.decode_trees(S.read_binary_files(spark, str(root / "trees")))
    found = extract_functions(usable, sources, trees).collect()
    assert [(r.path, r.ord, r.line, r.text) for r in found] == [(f"{root}/src/a b.py", 0, 0, "def f():\n    return 1")]
    reasons = M.manifest_rejects(entries, sources, trees, str(root)).groupBy("reason").agg(F.count("*").alias("n")).collect()
    assert {r.reason: r.n for r in reasons} == {"no path": 2, "source not found": 2, "no tree path": 1, "tree not found": 1}
