"""Files named by a manifest of any length, read without listing or joining folders.

The manifest is text with one JSON entry ``{"path", "tree_sitter_file"}`` a line, in one file or a folder of files. A
partition is a stretch of its bytes, so the driver sees sizes of manifest files only, and tasks open just the files
their entries name. Every entry gives one row; what cannot be used carries a reason, first failing test first.

    spark.dataSource.register(ListedFiles)
    spark.read.format("listed_files").option("root", "/data/project").load("/data/manifest.jsonl")

Paths are those pyarrow's file systems open: plain ones, or URIs. Defined cases: blank lines are skipped; a line that
is no JSON object is a row with a reason and no path; an entry listed twice is read twice; an empty manifest or folder
gives no rows; keys other than the two are ignored; a manifest that is missing is an error.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, tree_path string, content string, md5 string, mtime timestamp, tree string, reason string"
_ARROW = pa.schema(
    [(name, pa.timestamp("us", "UTC") if name == "mtime" else pa.string()) for name in ("path", "tree_path", "content", "md5", "mtime", "tree", "reason")]
)
STRETCH_BYTES = 1 << 20
#: Stretches beyond which those asked for grow, up to ``STRETCH_BYTES``: a task costs more than reading a few entries.
MOST_STRETCHES = 1024
#: Bytes of text after which a batch is handed on.
BATCH_BYTES = 16 << 20
BATCH_ROWS = 1024


@dataclass
class Stretch(InputPartition):
    """The entries whose lines start within these bytes of a manifest file."""

    path: str
    start: int
    end: int


def _located(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///") if path.startswith("file:/") and "://" not in path else path)
    return fs.LocalFileSystem(), path


def _read_bytes(path: str):
    """Bytes and modification time of a file; None if there is none."""
    system, inner = _located(path)
    info = system.get_file_info(inner)
    if info.type != fs.FileType.File:
        return None
    with system.open_input_stream(inner) as file:
        return file.read(), info.mtime


def _decoded(raw: bytes) -> str | None:
    try:
        return raw.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
    except UnicodeDecodeError:
        return None


def _absolute(path: str, root: str) -> str:
    return path if "://" in path else posixpath.normpath(posixpath.join(root, path))


def _row(line: bytes, root: str) -> dict:
    row = dict.fromkeys(_ARROW.names)
    try:
        entry = json.loads(line)
    except ValueError:
        entry = None
    if not isinstance(entry, dict):
        return row | {"reason": "not a JSON object"}
    named = [entry.get(k) if isinstance(entry.get(k), str) else None for k in ("path", "tree_sitter_file")]
    row["path"], row["tree_path"] = (_absolute(p, root) if p else None for p in named)
    if not row["path"]:
        return row | {"reason": "no path"}
    source = _read_bytes(row["path"])
    if source is None:
        return row | {"reason": "source not found"}
    content = _decoded(source[0])
    if content is None:
        return row | {"reason": "not valid UTF-8"}
    row |= {"content": content, "md5": hashlib.md5(source[0]).hexdigest(), "mtime": source[1]}
    if not row["tree_path"]:
        return row | {"reason": "no tree path"}
    tree = _read_bytes(row["tree_path"])
    if tree is None:
        return row | {"reason": "tree not found"}
    row["tree"] = _decoded(tree[0])
    return row | {"reason": None if row["tree"] is not None else "tree is not valid UTF-8"}


class ListedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.manifest = options["path"]
        self.root = options.get("root", "/")
        self.stretch = int(options.get("stretch", STRETCH_BYTES))

    def partitions(self) -> list[Stretch]:
        system, inner = _located(self.manifest)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.manifest)
        files = [info]
        if info.type == fs.FileType.Directory:
            files = [f for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        base = self.manifest[: len(self.manifest) - len(inner)] if self.manifest.endswith(inner) else ""
        step = max(self.stretch, min(STRETCH_BYTES, -(-sum(f.size for f in files) // MOST_STRETCHES)))
        return [Stretch(base + f.path, at, min(at + step, f.size)) for f in files for at in range(0, f.size, step)]

    def lines(self, part: Stretch) -> Iterator[bytes]:
        system, inner = _located(part.path)
        with system.open_input_file(inner) as raw:
            at = max(0, part.start - 1)
            raw.seek(at)
            # the byte before the stretch ends a line or belongs to one that an earlier stretch reads
            rest, skip = b"", part.start > 0
            while at < part.end:
                more = raw.read(1 << 16)
                *whole, rest = (rest + more).split(b"\n") if more else [rest, b""]
                for line in whole:
                    if at >= part.end:
                        return
                    if not skip:
                        yield line
                    skip = False
                    at += len(line) + 1
                if not more:
                    return

    def read(self, part: Stretch | None) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for line in self.lines(part) if part else ():  # without partitions Spark asks for none
            if not line.strip():
                continue
            rows.append(_row(line, self.root))
            size += sum(len(rows[-1][c] or "") for c in ("content", "tree"))
            if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class ListedFiles(DataSource):
    """Options: ``path`` of the manifest, ``root`` of relative paths, ``stretch`` in bytes of manifest."""

    @classmethod
    def name(cls) -> str:
        return "listed_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListedReader:
        return ListedReader(self.options)
