"""Parse-tree text to node spans, without building a tree.

A tree is text such as ``(module [0, 0] - [9, 0] name: (identifier [0, 4] - [0, 7]))``.
Pre-order of its nodes is the order of their opening brackets, so the nodes of a type
are the matching opening tokens, and one fold over the tokens tells whether the text
is well formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .text import strip

# Node types that define functions.
FUNCTION_NODE_TYPES = (
    "function_definition",
    "method_definition",
    "function_declaration",
    "method_declaration",
)

_GAP = r"[ \t\n]*"
_NAME = r"[^ \t\n():\[\]]*"
_RANGE = r"\[\d+,\s*\d+\]\s*-\s*\[\d+,\s*\d+[^\]]*\]"
_OPEN = rf"\({_GAP}{_NAME}{_GAP}(?:{_RANGE}|\[[^\]]*\])?{_GAP}"
_CLOSE = rf"\){_GAP}"
_LABEL = rf"\p{{L}}[^: \t\n]*:?{_GAP}"
_TOKEN = rf"(?s){_OPEN}|{_CLOSE}|{_LABEL}|."

_TYPE_OF = rf"^\({_GAP}({_NAME})"
_LINES_OF = rf"^\({_GAP}{_NAME}{_GAP}\[(\d+),\s*\d+\]\s*-\s*\[(\d+),\s*\d+"


def tree_tokens(tree: Column) -> Column:
    return F.regexp_extract_all(strip(tree), F.lit(_TOKEN), F.lit(0))


def token_count(tokens: Column, depth: Column | int = 0) -> Column:
    """Number of tokens up to the root's end; 0 if the text is not a well-formed tree.

    Whatever follows the root is ignored. A label may stand before a child or before
    the closing bracket, but not before another label. ``depth`` is that of the text before
    the tokens, for the last piece of a tree in pieces.
    """
    start = F.struct(
        (F.lit(depth) if isinstance(depth, int) else depth).cast("int").alias("depth"),
        F.lit(False).alias("labelled"),
        F.lit(False).alias("bad"),
        F.lit(0).alias("n"),
    )

    def step(s: Column, token: Column) -> Column:
        head = F.substring(token, 1, 1)
        opens, closes = head == "(", head == ")"
        label = ~opens & ~closes & head.rlike(r"^\p{L}")
        depth = s["depth"] + F.when(opens, F.lit(1)).when(closes, F.lit(-1)).otherwise(F.lit(0))
        fits = opens | (closes & (s["depth"] > 0)) | (label & (s["depth"] > 0) & ~s["labelled"])
        done = s["bad"] | ((s["n"] > 0) & (s["depth"] == 0))
        return F.when(done, s).otherwise(
            F.struct(depth.alias("depth"), label.alias("labelled"), (~fits).alias("bad"), (s["n"] + 1).alias("n"))
        )

    def finish(s: Column) -> Column:
        return F.when(~s["bad"] & (s["n"] > 0) & (s["depth"] == 0), s["n"]).otherwise(F.lit(0))

    return F.aggregate(tokens, start, step, finish)


#: A line no file has, with room for sums in 32 bits.
_FAR = 1 << 30


def piece_summary(tokens: Column, first: Column) -> Column:
    """``STRUCT<delta, low, bad>`` of a piece that opens with a bracket: the change of depth, its lowest value on
    the way, and whether a token cannot stand where it stands. Summaries of neighbours add up: deltas by sum,
    lows by minimum after the deltas before. Only the ``first`` piece may leave depth 0 or find tokens there;
    a bracket ends a label, so no label reaches over the start of a piece."""
    start = F.struct(F.lit(0).alias("delta"), F.lit(1 << 30).alias("low"), F.lit(False).alias("labelled"), F.lit(False).alias("bad"))

    def step(s: Column, token: Column) -> Column:
        head = F.substring(token, 1, 1)
        opens, closes = head == "(", head == ")"
        label = ~opens & ~closes & head.rlike(r"^\p{L}")
        delta = s["delta"] + F.when(opens, F.lit(1)).when(closes, F.lit(-1)).otherwise(F.lit(0))
        fits = opens | (~(first & (s["delta"] <= 0)) & (closes | (label & ~s["labelled"])))
        return F.struct(delta.alias("delta"), F.least(s["low"], delta).alias("low"), label.alias("labelled"), (s["bad"] | ~fits).alias("bad"))

    return F.aggregate(tokens, start, step, lambda s: F.struct(s["delta"].alias("delta"), s["low"].alias("low"), s["bad"].alias("bad")))


#: A piece ends before a bracket that follows white space, with only brackets that close nodes between it and the last
#: square bracket: no token reaches over such a place, however odd the text.
_PIECE_END = r"\][) \t\n]*[ \t\n](?=\()"


def tree_pieces(tree: Column, chars: int) -> Column:
    """The stripped text in pieces of at least ``chars`` characters (the last one may be shorter)."""
    return F.regexp_extract_all(strip(tree), F.lit(rf"(?s).{{{chars},}}?(?:{_PIECE_END}|\z)|.+\z"), F.lit(0))


def node_spans(tree: Column, node_types: Sequence[str] = FUNCTION_NODE_TYPES) -> Column:
    """``ARRAY<STRUCT<type, line, end_line>>`` of the wanted nodes in pre-order; empty
    for text that is not a tree. A node without a readable range spans line 0 to line 0; a number
    beyond ``_FAR`` counts as that, past the end of any file."""
    return let(tree_tokens(tree), lambda tokens: token_spans(F.slice(tokens, F.lit(1), token_count(tokens)), node_types))


def token_spans(tokens: Column, node_types: Sequence[str]) -> Column:
    """Spans of the wanted nodes among tokens."""

    def number(token: Column, group: int) -> Column:
        digits = F.nullif(F.regexp_extract(token, _LINES_OF, group), F.lit(""))
        line = F.least(F.coalesce(digits.try_cast("bigint"), F.lit(_FAR)), F.lit(_FAR)).cast("int")
        return F.when(digits.isNotNull(), line).otherwise(F.lit(0))

    wanted = F.filter(tokens, lambda t: t.startswith("(") & F.regexp_extract(t, _TYPE_OF, 1).isin(list(node_types)))
    return F.transform(
        wanted,
        lambda t: F.struct(
            F.regexp_extract(t, _TYPE_OF, 1).alias("type"),
            number(t, 1).alias("line"),
            number(t, 2).alias("end_line"),
        ),
    )
