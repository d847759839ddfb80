"""Line, indentation and formatting expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

# Lines around a hit, lines of a cluster member, text where there is no source.
CONTEXT_LINES = 2
FUNCTION_LINES = 50
UNREADABLE = "# Could not read file: "


def normalize_newlines(text: Column) -> Column:
    """``\\r\\n`` and lone ``\\r`` become ``\\n``, as text-mode readers do."""
    return F.regexp_replace(text, "\r\n?", "\n")


def strip(text: Column) -> Column:
    return F.regexp_replace(rstrip(text), r"^[\s\p{Z}\x1c-\x1f\x85]+", "")


def rstrip(text: Column) -> Column:
    """Remove trailing Unicode whitespace."""
    return F.regexp_replace(text, r"[\s\p{Z}\x1c-\x1f\x85]+\z", "")


def split_lines(text: Column) -> Column:
    """Lines of a text; a trailing newline yields a last empty line."""
    return F.split(text, "\n", -1)


def readable_lines(text: Column) -> Column:
    """Lines as a line-by-line reader sees them: no empty line after the last newline."""
    return let(
        split_lines(text),
        lambda lines: F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines),
    )


def line_count(text: Column) -> Column:
    return F.size(split_lines(text))


def slice_lines(lines: Column, start: Column, end: Column) -> Column:
    """Whole lines ``start`` to ``end`` inclusive (0-based), cut at the end of the file."""
    stop = F.least(end + 1, F.size(lines))
    return F.slice(lines, start + 1, F.greatest(stop - start, F.lit(0)))


def _common_prefix_length(a: Column, b: Column) -> Column:
    shorter = F.least(F.length(a), F.length(b))
    lengths = F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>"))
    same = F.filter(lengths, lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))
    return F.coalesce(F.array_max(same), F.lit(0))


def _margin(cleaned: Column) -> Column:
    """Length of the indentation all non-blank lines share. The longest common prefix of a
    set of strings is that of its least and greatest member, so nothing is folded."""
    indents = F.transform(F.filter(cleaned, lambda s: s != ""), lambda s: F.regexp_extract(s, r"^[ \t]*", 0))
    return let(
        indents,
        lambda i: F.when(F.size(i) == 0, F.lit(0)).otherwise(
            let(F.array_min(i), lambda lo: let(F.array_max(i), lambda hi: _common_prefix_length(lo, hi)))
        ),
    )


def dedent_lines(lines: Column) -> Column:
    """Remove the indentation common to all non-blank lines; blank lines become empty."""
    cleaned = F.transform(lines, lambda s: F.when(s.rlike(r"^[ \t]+\z"), F.lit("")).otherwise(s))
    return let(
        cleaned,
        lambda c: let(_margin(c), lambda m: F.transform(c, lambda s: F.substring(s, m + 1, F.length(s)))),
    )


def dedent(text: Column) -> Column:
    return F.array_join(dedent_lines(split_lines(text)), "\n")


def context_start(line: Column) -> Column:
    return F.greatest(line - CONTEXT_LINES, F.lit(0))


def context_end(lines: Column, line: Column) -> Column:
    """Exclusive end of the snippet around ``line``; as shown, the 1-based last line."""
    return F.least(line + CONTEXT_LINES + 1, F.size(lines))


def context_snippet(lines: Column, line: Column) -> Column:
    """Two lines before ``line`` to two after, right-stripped as one text."""
    start, end = context_start(line), context_end(lines, line)
    return rstrip(F.array_join(F.slice(lines, start + 1, F.greatest(end - start, F.lit(0))), "\n"))


def function_text(lines: Column, line: Column, path: Column) -> Column:
    """Up to fifty lines from ``line``; a comment naming the path if there is no source."""
    start = F.greatest(line, F.lit(0))
    end = F.least(start + FUNCTION_LINES, F.size(lines))
    text = rstrip(F.array_join(F.slice(lines, start + 1, F.greatest(end - start, F.lit(0))), "\n"))
    return F.coalesce(text, F.concat(F.lit(UNREADABLE), path))


def lines_between(content: Column, starts: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last`` (exclusive) with their newlines, cut out of the bytes by the offsets of line
    starts; ``starts`` ends with the length of the text, so it has one entry more than there are lines."""
    start = F.get(starts, first)
    piece = F.substring(content.cast("binary"), start + 1, F.get(starts, last) - start).cast("string")
    return F.when(last > first, piece).otherwise(F.when(starts.isNotNull(), F.lit("")))


def context_range(content: Column, starts: Column, line: Column) -> tuple[Column, Column]:
    """``context_end`` and ``context_snippet`` by offsets of line starts."""
    end = F.least(line + CONTEXT_LINES + 1, F.size(starts) - 1)
    return end, rstrip(lines_between(content, starts, context_start(line), end))


def function_range(content: Column, starts: Column, line: Column, path: Column) -> Column:
    """``function_text`` by offsets of line starts."""
    start = F.greatest(line, F.lit(0))
    end = F.least(start + FUNCTION_LINES, F.size(starts) - 1)
    return F.coalesce(rstrip(lines_between(content, starts, start, end)), F.concat(F.lit(UNREADABLE), path))


def indent(text: Column, prefix: str = "    ") -> Column:
    """Put ``prefix`` before every line that is not blank."""
    return F.regexp_replace(text, r"(?m)^(?=[^\n]*[^\s\p{Z}\x1c-\x1f\x85])", prefix)


def format_score(score: Column) -> Column:
    """Three decimals. Exact binary ties (odd sixteenths) go to the even digit."""
    tie = (score * 16) == F.floor(score * 16)
    return F.format_string("%.3f", F.when(tie, F.bround(score, 3)).otherwise(score))


def format_distance(distance: Column) -> Column:
    """Three significant digits without padding zeros, but at least one decimal."""
    text = F.format_string("%.3g", distance)
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^[^e]*", 0), r"\.?0+\z", "")
    exponent = F.regexp_extract(text, r"e.*\z", 0)
    plain = F.when(mantissa.contains("."), mantissa).otherwise(F.concat(mantissa, F.lit(".0")))
    return (
        F.when(distance == 0, F.lit("0.0"))
        .when(exponent != "", F.concat(mantissa, exponent))
        .otherwise(plain)
    )
