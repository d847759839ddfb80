"""Path, extension and fingerprint expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language tag of a code block by file suffix, first match wins.
LANGUAGE_SUFFIXES = (
    ("python", (".py",)),
    ("javascript", (".js",)),
    ("typescript", (".ts",)),
    ("go", (".go",)),
    ("rust", (".rs",)),
    ("java", (".java",)),
    ("ruby", (".rb",)),
    ("php", (".php",)),
    ("c", (".c", ".h")),
    ("cpp", (".cpp", ".hpp")),
    ("kotlin", (".kt", ".kts", ".ktm")),
    ("vala", (".vala", ".vapi")),
)


def normalize_path(path: Column, root: str | None = None) -> Column:
    """Absolute form of ``path`` with ``.``, ``..`` and repeated slashes folded.

    Relative paths hang below ``root``: a cluster has no working directory. Exactly
    two leading slashes are kept, as POSIX leaves their meaning open.
    """
    full = path
    if root is not None:
        full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    parts = F.filter(F.split(full, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.concat(acc, F.array(p))
        ),
    )
    lead = F.when(full.rlike("^//(?!/)"), F.lit("//")).otherwise(F.lit("/"))
    return F.concat(lead, F.array_join(kept, "/"))


def uri_to_path(uri: Column) -> Column:
    """Path part of a file-source URI (scheme and authority removed)."""
    return F.regexp_replace(uri, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "")


def file_key(path: Column) -> Column:
    """Sixteen hex digits naming a normalised path."""
    return F.substring(F.sha2(path, 256), 1, 16)


def file_ext(path: Column) -> Column:
    """Last suffix without its dot, lower-cased; ``''`` for dotfiles and bare names."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]*)$", 1))


def parse_ext_list(text: Column) -> Column:
    """Set of extensions named by a comma-separated list such as ``".py, JS"``."""
    return F.array_distinct(
        F.transform(F.split(text, ","), lambda x: F.lower(F.regexp_replace(F.trim(x), r"^\.+", "")))
    )


def parse_extensions(text: str) -> list[str]:
    """The same for an argument known when the query is built; a blank one names none, so it is no filter."""
    if not text.strip():
        return []
    return sorted({part.strip().lstrip(".").lower() for part in text.split(",")})


def lang_tag(path: Column) -> Column:
    """Code-block language of a path; ``''`` when the suffix is not listed."""
    tag = F.lit("")
    for name, suffixes in reversed(LANGUAGE_SUFFIXES):
        hit = F.lit(False)
        for suffix in suffixes:
            hit = hit | path.endswith(suffix)
        tag = F.when(hit, F.lit(name)).otherwise(tag)
    return tag
