"""Layouts of JSON values, compiled into predicates over ``VARIANT`` columns.

A layout is a function from an SQL expression of a variant to one that tells whether the value has the layout, built from
the ones below; a nested layout becomes one expression, so a table of any size is judged where its rows are, and a file's
rows never go to the driver. Objects are closed: a key that a layout doesn't know is a fault, as is a missing one, or a
null where a value must be.

``document`` and ``lines`` parse files; what isn't JSON is told apart from what has another layout.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, FractionalType, IntegralType, StructType

from rulesift.functions.text import trim

Layout = Callable[[str], str]
_NAMES = itertools.count()


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _get(v: str, kind: str, path: str = "$") -> str:
    return f"try_variant_get({v}, {_lit(path)}, '{kind}')"


def _list(values) -> str:
    return f"array({', '.join(values)})"


def _sure(test: str) -> str:
    return f"coalesce({test}, false)"


def _is_text(v: str) -> str:
    return f"schema_of_variant({v}) = 'STRING'"


def _is_number(v: str) -> str:
    return f"schema_of_variant({v}) rlike '^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$'"


def _every(items: str, layout: Layout) -> str:
    x = f"x{next(_NAMES)}"
    return f"forall({items}, {x} -> {layout(x)})"


def one_of(*values: object) -> Layout:
    """One of some texts, numbers or lists of numbers."""
    texts, lists = [_lit(x) for x in values if isinstance(x, str)], [x for x in values if isinstance(x, list)]
    numbers = [f"{float(x)}D" for x in values if not isinstance(x, (str, list))]

    def holds(v: str) -> str:
        tests = [f"{_is_text(v)} AND {_get(v, 'string')} IN ({', '.join(texts)})"] if texts else []
        tests += [f"{_is_number(v)} AND {_get(v, 'double')} IN ({', '.join(numbers)})"] if numbers else []
        tests += [f"{_get(v, 'array<double>')} = {_list(f'{float(y)}D' for y in x)}" for x in lists]
        return f"({' OR '.join(map(_sure, tests))})"

    return holds


def matching(pattern: str) -> Layout:
    whole_pattern = _lit(rf"\A(?:{pattern})\z")
    return lambda v: _sure(f"{_is_text(v)} AND {_get(v, 'string')} rlike {whole_pattern}")


def any_text(v: str) -> str:
    return _sure(_is_text(v))


#: A text that isn't blank.
_INK = _lit(r"(?U)[^\s\x{FEFF}]")


def text(v: str) -> str:
    """A text that isn't blank."""
    return _sure(f"{_is_text(v)} AND {_get(v, 'string')} rlike {_INK}")


def name(v: str) -> str:
    """A text of up to 200 UTF-16 units."""
    own = _get(v, "string")
    return _sure(f"{_is_text(v)} AND length({own}) + regexp_count({own}, {_lit(r'[\x{10000}-\x{10FFFF}]')}) BETWEEN 1 AND 200")


def number(v: str) -> str:
    return _sure(_is_number(v))


def whole(v: str, least: int | None = 1) -> str:
    own = _get(v, "double")
    return _sure(f"{_is_number(v)} AND {own} = floor({own})" + ("" if least is None else f" AND {own} >= {least}"))


def count(v: str) -> str:
    return whole(v, 0)


def flag(v: str) -> str:
    return _sure(f"schema_of_variant({v}) = 'BOOLEAN'")


def day(v: str) -> str:
    own = _get(v, "string")
    return _sure(f"{_is_text(v)} AND {own} rlike {_lit(r'\A\d{4}-\d{2}-\d{2}\z')} AND try_cast({own} AS date) IS NOT NULL")


def many(item: Layout, least: int = 0, most: int | None = None, distinct: bool = False) -> Layout:
    """An array; ``distinct`` is for texts."""

    def holds(v: str) -> str:
        items = _get(v, "array<variant>")
        test = f"{items} IS NOT NULL AND size({items}) >= {least} AND {_every(items, item)}"
        test += "" if most is None else f" AND size({items}) <= {most}"
        return _sure(test + (f" AND size(array_distinct({_get(v, 'array<string>')})) = size({items})" if distinct else ""))

    return holds


def closed(must: dict[str, Layout], may: dict[str, Layout] | None = None) -> Layout:
    """An object with all keys of ``must``, perhaps some of ``may``, and no others."""
    may = may or {}
    known = f"cast({_list(map(_lit, [*must, *may]))} AS array<string>)"

    def holds(v: str) -> str:
        keys = f"map_keys({_get(v, 'map<string,variant>')})"
        at = lambda k: _get(v, "variant", f"$['{k}']")
        tests = [f"size(array_except({keys}, {known})) = 0", *[layout(at(k)) for k, layout in must.items()]]
        return _sure(" AND ".join(tests + [f"(NOT array_contains({keys}, {_lit(k)}) OR {layout(at(k))})" for k, layout in may.items()]))

    return holds


def mapped(keys: tuple[str, ...], layout: Layout) -> Layout:
    """An object with just these keys, whose values all have one layout."""

    def holds(v: str) -> str:
        entries = _get(v, "map<string,variant>")
        return _sure(f"array_sort(map_keys({entries})) = {_list(map(_lit, sorted(keys)))} AND {_every(f'map_values({entries})', layout)}")

    return holds


def either(*layouts: Layout) -> Layout:
    return lambda v: f"({' OR '.join(f(v) for f in layouts)})"


def or_null(layout: Layout) -> Layout:
    return lambda v: f"(coalesce(schema_of_variant({v}), 'VOID') = 'VOID' OR {layout(v)})"


def layout_of(kind: DataType, required: tuple[str, ...] = ()) -> Layout:
    """The layout of a column type: closed objects, whole numbers for integers; only ``required`` keys of the outermost object must be there and not null."""
    if isinstance(kind, StructType):
        return closed({f.name: layout_of(f.dataType) for f in kind if f.name in required}, {f.name: or_null(layout_of(f.dataType)) for f in kind if f.name not in required})
    if isinstance(kind, ArrayType):
        return many(or_null(layout_of(kind.elementType)))
    if isinstance(kind, IntegralType):
        return lambda v: whole(v, None)
    return number if isinstance(kind, FractionalType) else flag if isinstance(kind, BooleanType) else any_text


def holds(layout: Layout, column: str = "v") -> Column:
    """Whether a column's values have the layout."""
    return F.expr(layout(column))


# --- reading ----------------------------------------------------------------------------------------------------


def parsed(raw: Column) -> Column:
    """The variant of a JSON text; null if it isn't one, or if something follows it. Of equal keys the last counts, where the session lets them be."""
    whole_text = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(whole_text) == 1, F.get(whole_text, 0))


def document(spark: SparkSession, path: str) -> DataFrame:
    """v: the value of a JSON file, null if it isn't one."""
    return spark.read.text(path, wholetext=True).select(parsed(F.col("value")).alias("v"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """blank and v of each line: lines end with LF or CRLF, and the last end may be missing."""
    rows = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("value"))
    return rows.select((trim(F.col("value")) == "").alias("blank"), parsed(F.col("value")).alias("v"))


def problem(rows: DataFrame, layout: Layout, by_line: bool = False) -> DataFrame:
    """One row, problem: why the values ``v`` of a file aren't of a layout: ``json-lines``, ``json-syntax`` or ``schema``, or null. A file without lines has no line that isn't blank."""
    blank = F.col("blank") if by_line else F.lit(False)
    one = F.when(blank, 1).when(F.col("v").isNull(), 2).when(~holds(layout), 3)
    worst = F.coalesce(F.min(one), F.when(F.count("*") == 0, 1 if by_line else 2))
    return rows.agg(F.when(worst == 1, "json-lines").when(worst == 2, "json-syntax").when(worst == 3, "schema").alias("problem"))


def columns(rows: DataFrame, nested: str) -> DataFrame:
    """The values ``v``, objects, as columns of a struct type."""
    return rows.select(F.try_variant_get("v", "$", nested).alias("x")).select("x.*")
