"""Several values packed in one field: one row per value, with its position.

The field is split on quote characters: odd pieces are literals, even pieces are split on delimiters, and array folds
(transform, flatten, filter) reassemble the values with their ordinals. Only quotes that open or close a literal count,
so these are first replaced by one mark, in a single pass of a possessive pattern. A quote opens only at the start of a
value, so an apostrophe inside a bare path stays an ordinary character. The cost grows linearly with the field.

Defined results: a null, empty or blank field and an empty list give no row; empty values are skipped and not
counted; repeated values and repeated rows are kept; an unclosed quote runs to the end of the field; text between a
closing quote and the next delimiter belongs to the value; the noncharacter U+FDD0 is dropped; columns of the
input other than the packed one are carried along unchanged, and an output name that clashes with one of them raises.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELIMITERS = ",;|\n\r\t"
_BLANKS = " \t\n\x0b\f\r\u00a0\ufeff"
_STOP = DELIMITERS.replace("|", r"\|")
#: Takes the place of the quotes that open and close a literal: a noncharacter, which no text holds.
_MARK = "\ufdd0"


def _body(q: str) -> str:
    return rf"[^{q}\\]*+(?:(?:\\.|{q}{q})[^{q}\\]*+)*+"


#: A delimiter, blanks, a quoted literal (its quote doubled or escaped inside) and what follows up to the next delimiter.
#: All repetitions are possessive: one pass, whatever the length.
_LITERAL = rf"""(?s)([{_STOP}][ \x0B\f\u00a0\ufeff]*+)(?:(")({_body('"')})(?:"|\z)|(')({_body("'")})(?:'|\z))([^{_STOP}]*+)"""


def _strip(c: Column) -> Column:
    return F.trim(c, F.lit(_BLANKS))


def _let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c worked out once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _unwrap(c: Column) -> Column:
    """Without outer blanks, without the quoting of a whole list (inner quotes doubled), without list brackets."""

    def unquoted(s: Column) -> Column:
        whole = s.startswith('"') & s.rlike(r'(?s)^"\s*[\[{].*[\]}]\s*"$')
        return F.when(whole, _strip(F.replace(F.substring(s, F.lit(2), F.length(s) - 2), F.lit('""'), F.lit('"')))).otherwise(s)

    def unlisted(s: Column) -> Column:
        listed = (F.length(s) > 1) & ((s.startswith("[") & s.endswith("]")) | (s.startswith("{") & s.endswith("}")))
        return F.when(listed, F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s)

    return _let(_let(_strip(c), unquoted), unlisted)


def _unescape(c: Column) -> Column:
    r"""JSON escapes (\/ \" \\ \uXXXX ...) and \' resolved; a value that is no valid JSON text only loses \/ and \'."""
    plain = F.replace(c, F.lit("\\'"), F.lit("'"))
    # a bare quote inside (from a single-quoted literal) must be escaped before the JSON reader sees it
    guarded = F.regexp_replace(plain, r'(?<!\\)"', r'\\"')
    parsed = F.element_at(F.from_json(F.concat(F.lit('["'), guarded, F.lit('"]')), "array<string>"), 1)
    return F.when(F.instr(c, "\\") > 0, F.coalesce(parsed, F.replace(plain, F.lit("\\/"), F.lit("/")))).otherwise(c)


def packed_values(c: Column) -> Column:
    """array<string> of the single values of a packed field, in order, empty ones left out; null field -> empty."""
    # a delimiter in front gives every value, the first too, the same look
    text = F.concat(F.lit(","), F.replace(_unwrap(c), F.lit(_MARK), F.lit("")))
    pieces = F.split(F.regexp_replace(text, _LITERAL, f"$1{_MARK}$2$4$3$5$6{_MARK}"), _MARK, -1)

    def values(piece: Column, k: Column) -> Column:
        quote, rest = F.left(piece, F.lit(1)), F.substring(piece, 2, 1 << 30)
        return F.when(k % 2 == 1, F.array(F.replace(rest, F.concat(quote, quote), quote))).otherwise(F.split(piece, f"[{_STOP}]", -1))

    parts = F.filter(F.flatten(F.transform(pieces, values)), lambda v: v != "")
    return F.coalesce(F.filter(F.transform(parts, lambda v: _strip(_let(_strip(v), _unescape))), lambda v: v != ""), F.array().cast("array<string>"))


def split_packed(df: DataFrame, column: str, value: str = "value", pos: str = "pos") -> DataFrame:
    """One row per single value of ``column``: the other columns, ``pos`` (bigint from 1) and ``value``."""
    rest = [c for c in df.columns if c != column]
    for name in (value, pos):
        if name in rest:
            raise ValueError(f"output column {name!r} clashes with a column of the input")
    return df.select(*[F.col(f"`{c}`") for c in rest], F.posexplode(packed_values(F.col(f"`{column}`"))).alias("__p", "__v")).select(
        *[F.col(f"`{c}`") for c in rest], (F.col("__p") + 1).cast("bigint").alias(pos), F.col("__v").alias(value)
    )
