"""Reader of the files a manifest names."""

import hashlib
import json

import pytest

from snippetlake.sources import listed
from snippetlake.sources.listed import ListedFiles, ListedReader

TREE = "(module [0, 0] - [1, 0])"


@pytest.fixture
def project(tmp_path):
    files = {"a.py": b"x\r\ny\rz\n", "a.tree": TREE.encode(), "bad.py": b"\xff\xfe", "bad.tree": b"\xff", "b.py": b"", "unlisted.py": b"never"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    entries = [
        {"path": "sub/../a.py", "tree_sitter_file": "a.tree", "more": 1},
        {"path": "bad.py", "tree_sitter_file": "a.tree"},
        {"path": "gone.py", "tree_sitter_file": "a.tree"},
        {"path": "b.py"},
        {"path": "b.py", "tree_sitter_file": "gone.tree"},
        {"path": "a.py", "tree_sitter_file": "bad.tree"},
        {"path": "", "tree_sitter_file": "a.tree"},
        {"path": None},
        [1],
    ]
    (tmp_path / "manifest").mkdir()
    lines = [json.dumps(e) for e in entries]
    (tmp_path / "manifest" / "part-0").write_text("\n".join(lines[:5]) + "\n\n")
    (tmp_path / "manifest" / "part-1").write_text("\n".join([*lines[5:], "{broken"]))
    (tmp_path / "manifest" / "_SUCCESS").write_text("")
    return tmp_path


@pytest.mark.parametrize("stretch", [1, 37, 1 << 20])
def test_every_entry_is_one_row(spark, project, stretch):
    spark.dataSource.register(ListedFiles)
    read = spark.read.format("listed_files").option("root", str(project)).option("stretch", stretch).load(str(project / "manifest"))
    rows = read.collect()
    found = sorted((r.path or "", r.reason or "") for r in rows)
    at = lambda name: f"{project}/{name}"
    assert found == sorted(
        [
            (at("a.py"), ""),
            (at("bad.py"), "not valid UTF-8"),
            (at("gone.py"), "source not found"),
            (at("b.py"), "no tree path"),
            (at("b.py"), "tree not found"),
            (at("a.py"), "tree is not valid UTF-8"),
            ("", "no path"),
            ("", "no path"),
            ("", "not a JSON object"),
            ("", "not a JSON object"),
        ]
    )
    good = next(r for r in rows if r.reason is None)
    assert (good.content, good.tree, good.md5) == ("x\ny\nz\n", TREE, hashlib.md5(b"x\r\ny\rz\n").hexdigest())
    assert abs(good.mtime.timestamp() - (project / "a.py").stat().st_mtime) < 1e-3


def test_files_not_listed_are_not_opened(project, monkeypatch):
    opened, real = [], listed._read_bytes
    monkeypatch.setattr(listed, "_read_bytes", lambda path: opened.append(path) or real(path))
    reader = ListedReader({"path": str(project / "manifest"), "root": str(project)})
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 10
    assert opened and not any("unlisted" in path for path in opened)


def test_lines_longer_than_a_block_meet_one_stretch_each(tmp_path):
    lines = [b"%d" % i * (i * 9000 % 70_001 + 1) for i in range(40)]
    (tmp_path / "m").write_bytes(b"\n".join(lines))
    for stretch in (1000, 65_536, 200_000):
        reader = ListedReader({"path": str(tmp_path / "m"), "stretch": str(stretch)})
        assert [line for p in reader.partitions() for line in reader.lines(p)] == lines


def test_empty_and_missing_manifests(spark, tmp_path):
    (tmp_path / "empty").write_text("")
    assert ListedReader({"path": str(tmp_path / "empty")}).partitions() == []
    with pytest.raises(FileNotFoundError):
        ListedReader({"path": str(tmp_path / "none")}).partitions()
    spark.dataSource.register(ListedFiles)
    assert spark.read.format("listed_files").load(str(tmp_path / "empty")).count() == 0


def test_short_stretches_grow_with_the_manifest(tmp_path):
    """No more tasks than ``MOST_STRETCHES`` or one for each ``STRETCH_BYTES``, and every line in one of them."""
    lines = [json.dumps({"path": f"{i}.py"}) for i in range(20_000)]
    (tmp_path / "manifest").write_text("\n".join(lines))
    reader = ListedReader({"path": str(tmp_path / "manifest"), "stretch": "64"})
    parts = reader.partitions()
    assert len(parts) <= listed.MOST_STRETCHES + 1
    assert [line.decode() for part in parts for line in reader.lines(part)] == lines
    assert len(ListedReader({"path": str(tmp_path / "manifest"), "stretch": "4096"}).partitions()) == -(-(tmp_path / "manifest").stat().st_size // 4096)
