"""Change plan of a stream: each path remembers its own fingerprint, so no batch reads the stored table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.changes import MTIME_TOLERANCE_MICROS

CHANGE_SCHEMA = "path string, md5 string, micros long, status string, version int"
#: Paths share a state by hash: calling Python for a group costs far more than judging a path.
BUCKETS = 1 << 14
_STATE = "path array<string>, md5 array<string>, micros array<long>, version array<int>"


def _judged(old: tuple | None, md5: str, micros: int) -> tuple[str, int]:
    """Status and version in force of a fingerprint against the ``(md5, micros, version)`` in force before."""
    if old is None:
        return "new", 1
    old_md5, old_micros, version = old
    if micros < old_micros - MTIME_TOLERANCE_MICROS:
        return "late", version
    if md5 == old_md5 and micros <= old_micros + MTIME_TOLERANCE_MICROS:
        return "unchanged", version
    return "changed", version + 1


def _judge(key: tuple, arrived: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The newest of the versions of each path that arrived together, against the one in force."""
    newest: dict[str, tuple[int, str]] = {}
    for frame in arrived:
        for path, md5, micros in zip(frame.path.tolist(), frame.md5.tolist(), frame.micros.tolist()):
            newest[path] = max(newest.get(path, (micros, md5)), (micros, md5))
    known: dict[str, tuple[str, int, int]] = {}
    if state.exists:
        paths, *rest = state.get
        known = dict(zip(paths, zip(*rest)))
    out, accepted = [], False
    for path, (micros, md5) in newest.items():
        status, version = _judged(known.get(path), md5, micros)
        if status in ("new", "changed"):
            known[path], accepted = (md5, micros, version), True
        out.append((path, md5, micros, status, version))
    if accepted:
        state.update((list(known), *(list(column) for column in zip(*known.values()))))
    yield pd.DataFrame(out, columns=["path", "md5", "micros", "status", "version"])


def change_stream(files: DataFrame) -> DataFrame:
    """Stream of ``(path, md5, micros, status, version)`` from a stream of file versions ``(path, md5, mtime)``.

    A row per path and micro-batch, for the newest version in it (of equal times the greatest digest): ``new``,
    ``changed``, ``unchanged``, or ``late`` if a newer one is in force already. ``version`` counts those accepted.
    As in the change plan of tables, times within 0.1 s are equal, and an unchanged file keeps its stored time.

    State is one fingerprint a path, kept in buckets of paths by hash, whose number is fixed since a checkpoint depends on
    it; contents never enter it. A path with very many versions in a batch is folded in portions. Rows without a path, a digest or a time say nothing and are left out.
    """
    narrow = files.select("path", "md5", F.unix_micros("mtime").alias("micros")).dropna()
    bucketed = narrow.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(BUCKETS)))
    return bucketed.groupBy("bucket").applyInPandasWithState(_judge, CHANGE_SCHEMA, _STATE, "append", GroupStateTimeout.NoTimeout)
