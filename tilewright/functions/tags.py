"""Tag lookups and value parsing as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.schema import BRIDGES, RAIL, TUNNELS


def tag(key: str, tags: str = "tags") -> Column:
    return F.col(tags)[key]


def has(key: str) -> Column:
    """Present, even with an empty value."""
    return tag(key).isNotNull()


def is_any(key: str, values: Sequence[str]) -> Column:
    return F.expr(f"coalesce({any_of(f'tags[{literal(key)}]', values)}, false)")


def non_empty(key: str) -> Column:
    return F.nullif(tag(key), F.lit(""))


def literal(value: object) -> str:
    """A value as SQL text."""
    if value is None:
        return "NULL"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else str(value)


def any_of(sql: str, values: Sequence[str]) -> str:
    return f"{sql} IN ({', '.join(map(literal, values))})"


def first_match(rows: Sequence[tuple], result: int, tags: str = "tags") -> Column:
    """Element ``result`` of the first (key, value, ...) row that fits; null if none.

    An unlisted value of an earlier key doesn't block a later row.  The long
    lists go to the parser as one text, not literal by literal.
    """
    groups: dict[tuple[str, object], list[str]] = {}  # rows of one key stand together
    for row in rows:
        groups.setdefault((row[0], None if row[result] == row[1] else row[result]), []).append(row[1])
    branches = []
    for (key, value), listed in groups.items():
        own = f"{tags}[{literal(key)}]"
        branches.append(f"WHEN {any_of(own, listed)} THEN {own if value is None else literal(value)}")
    return F.expr(f"CASE {' '.join(branches)} END")


def pick(sql: str, groups: dict, default=None) -> Column:
    """Key of the group that lists the value of a SQL expression."""
    branches = " ".join(f"WHEN {any_of(sql, values)} THEN {literal(result)}" for result, values in groups.items())
    return F.expr(f"CASE {branches} ELSE {literal(default)} END")


def named() -> Column:
    return F.coalesce(tag("name") != "", F.lit(False))


def is_tunnel() -> Column:
    return is_any("tunnel", TUNNELS) | F.coalesce(tag("covered") == "yes", F.lit(False))


def is_bridge() -> Column:
    return is_any("bridge", BRIDGES)


def is_rail() -> Column:
    return F.expr(any_of("_street", RAIL))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that stands in the plan once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def decimal(token: Column) -> Column:
    """A decimal number with the comma policy: grouping, unless one comma is the point."""

    def plain(t: Column) -> Column:
        commas = F.length(t) - F.length(F.replace(t, F.lit(","), F.lit("")))
        bare = F.replace(t, F.lit(","), F.lit(""))
        grouped = (F.length(F.substring_index(t, ",", -1)) == 3) & (F.length(F.substring_index(t, ",", 1)) > 0)
        return F.when(commas == 0, t).when(t.contains(".") | (commas > 1) | grouped, bare).otherwise(F.replace(t, F.lit(","), F.lit(".")))

    def number(t: Column) -> Column:
        return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))

    finite = lambda n: F.when(F.abs(n) < float("inf"), n)
    return let(let(F.trim(token), plain), lambda t: let(number(t), finite))


def length_m(raw: Column) -> Column:
    """Metres of a length: bare or metre values, feet, or feet and inches."""

    def metres(value: Column) -> Column:
        inches_form = value.rlike("^[^']*'.*\"$")
        feet_part = F.substring_index(value, "'", 1)
        inches_part = F.trim(F.regexp_replace(F.regexp_replace(value, "^[^']*'", ""), '"$', ""))
        size = F.abs(decimal(feet_part)) * 0.3048 + F.abs(decimal(inches_part)) * 0.0254
        both = F.when(inches_form, size * F.when(F.ltrim(feet_part).startswith("-"), -1.0).otherwise(1.0))
        number = decimal(F.regexp_extract(F.regexp_replace(value, "(feet|ft|'|meters|meter|m)$", ""), r"^\s*(\S+)", 1))
        return F.coalesce(both, number * F.when(value.rlike("(feet|ft|')$"), 0.3048).otherwise(1.0))

    return let(F.trim(F.substring_index(F.lower(F.trim(raw)), ";", 1)), metres)


def strict_int(raw: Column) -> Column:
    """A whole number without spaces; commas are grouping."""
    bare = F.replace(raw, F.lit(","), F.lit(""))
    return F.when(bare.rlike(r"^[+-]?[0-9]+$"), bare.try_cast("bigint"))


def count(raw: Column) -> Column:
    """A count, whole or decimal, not negative."""

    def counted(token: Column) -> Column:
        whole = F.when(~token.contains(".") & ~token.contains(","), strict_int(token).cast("double"))
        return let(F.when(token != "", F.coalesce(whole, decimal(token))), lambda n: F.when(n >= 0, n))

    return let(F.trim(F.substring_index(raw, ";", 1)), counted)


def admin_level(raw: Column) -> Column:
    """Levels 2 and 4 only; strict, as a byte: no spaces, an optional plus sign."""
    level = F.when(raw.rlike(r"^\+?[0-9]+$"), raw.try_cast("int"))
    return F.when(level.isin(2, 4), level)


def elevation(raw: Column) -> Column:
    """Whole metres, half away from zero; values beyond 64 bits are refused."""
    fits = lambda metres: F.when((metres >= -9.223372036854775e18) & (metres < 9.223372036854775e18), metres.cast("bigint"))
    return let(F.round(length_m(raw)), fits)


def ref_lines(ref: Column) -> dict[str, Column]:
    """A street's ref on lines, with their number and the longest line's characters."""
    text = F.replace(ref, F.lit(";"), F.lit("\n"))
    lines = F.split(F.regexp_replace(text, "\n\\z", ""), "\n")
    lines = F.when(text == "", F.array().cast("array<string>")).otherwise(lines)
    return {"ref": text, "ref_rows": F.size(lines).cast("bigint"), "ref_cols": F.coalesce(F.array_max(F.transform(lines, F.length)), F.lit(0)).cast("bigint")}
