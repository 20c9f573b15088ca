"""Specimen tables: typed predicates, selections, levels, pairs, series and merges, all as plain DataFrame work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REAL_TOLERANCE = 1e-6
ORDERED = {"gt": "__gt__", "ge": "__ge__", "lt": "__lt__", "le": "__le__"}


def _typed(df: DataFrame, column: str, literal: str):
    """The literal as a value of the column's type; a literal that does not parse is an error."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.BooleanType):
        return literal[:1].lower() == "t"
    if isinstance(kind, T.IntegralType):
        return int(literal)
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return float(literal)
    return literal


def predicate(df: DataFrame, column: str, test: str, *literals: str) -> Column:
    """eq, ne, gt, ge, lt, le, in or notin of a typed column against text literals.

    Real values are equal within 1e-6; whole numbers, text and factors exactly; a Boolean literal is true if it starts
    with t or T. in and notin take a comma list whose items are not trimmed. An unknown column or a literal that does
    not parse raises.
    """
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    c, kind = F.col(column), df.schema[column].dataType
    if test in ORDERED:
        return getattr(c, ORDERED[test])(F.lit(_typed(df, column, literals[0])))
    values = [_typed(df, column, v) for v in (literals if test in ("eq", "ne") else [x for v in literals for x in v.split(",")])]
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        # Absolute tolerance around each value; scans still get the bounds as pushed filters.
        inside = F.lit(False)
        for v in values:
            inside = inside | ((c > v - REAL_TOLERANCE) & (c < v + REAL_TOLERANCE))
    else:
        inside = c.isin(values)
    if test in ("eq", "in"):
        return inside
    if test in ("ne", "notin"):
        return ~inside
    raise ValueError(f"no test {test}")


def select_rows(df: DataFrame, *tests: tuple) -> DataFrame:
    """Rows that meet all tests, each a tuple (column, test, literals...)."""
    for column, test, *literals in tests:
        df = df.where(predicate(df, column, test, *literals))
    return df


def select(selected: Column, test: Column) -> Column:
    return F.coalesce(selected | test, selected)


def unselect(selected: Column, test: Column) -> Column:
    return selected & ~F.coalesce(test, F.lit(False))


def invert(selected: Column, test: Column) -> Column:
    return selected != F.coalesce(test, F.lit(False))


def describe_selection(df: DataFrame, columns: Sequence[str], selected: str = "selected") -> DataFrame:
    """One row: description ("a=1 and b=x"), n_selected and is_complete.

    Columns that are constant over the selected rows make up the description; it is complete if their conjunction
    selects just these rows. Nothing selected gives "nothing", no constant column "n points". Two aggregations, no join
    beyond the one row that the first gives.
    """
    on = F.col(selected)
    parts = []
    for c in columns:
        parts += [F.min(F.when(on, F.col(c))).alias(f"_low_{c}"), F.max(F.when(on, F.col(c))).alias(f"_high_{c}"), F.count_if(on & F.col(c).isNull()).alias(f"_null_{c}")]
    facts = df.agg(F.count_if(on).alias("_n"), *parts)
    constant = lambda c: (F.col(f"_low_{c}") == F.col(f"_high_{c}")) & (F.col(f"_null_{c}") == 0)
    same = F.lit(True)
    for c in columns:
        same = same & F.when(F.coalesce(constant(c), F.lit(False)), F.coalesce(F.col(c) == F.col(f"_low_{c}"), F.lit(False))).otherwise(True)
    any_constant = F.lit(False)
    for c in columns:
        any_constant = any_constant | F.coalesce(constant(c), F.lit(False))
    # The facts are one row whatever the input.
    checked = df.select(selected, *columns).join(F.broadcast(facts))
    wrong = checked.agg(F.count_if(on != same).alias("_wrong"))
    said = F.concat_ws(" and ", *[F.when(constant(c), F.concat(F.lit(f"{c}="), F.col(f"_low_{c}").cast("string"))) for c in columns])
    text = F.when(F.col("_n") == 0, "nothing").when(~any_constant, F.concat(F.col("_n").cast("string"), F.lit(" points"))).otherwise(said)
    return facts.join(F.broadcast(wrong)).select(text.alias("description"), F.col("_n").alias("n_selected"), (any_constant & (F.col("_wrong") == 0) & (F.col("_n") > 0)).alias("is_complete"))


def declare(df: DataFrame, column: str, role: str, levels: Sequence[str] = ()) -> DataFrame:
    """``df`` with the role of a column (say factor, mesh, cloud, size) and, of a factor, its levels in order, in the column's metadata.

    The metadata goes along through select, filter, join and Parquet, so a saved table knows its roles.
    """
    facts = {"role": role} | ({"levels": list(levels)} if levels else {})
    return df.withColumn(column, F.col(column).alias(column, metadata=df.schema[column].metadata | facts))


def roles(df: DataFrame) -> dict[str, str]:
    """The declared role of each column that has one."""
    return {f.name: f.metadata["role"] for f in df.schema if "role" in f.metadata}


def columns_of_role(df: DataFrame, *wanted: str) -> list[str]:
    """Names of the columns declared as one of some roles: which columns an analysis can take."""
    return [name for name, role in roles(df).items() if role in wanted]


def declared_levels(df: DataFrame, column: str) -> list[str]:
    return list(df.schema[column].metadata.get("levels", []))


def unique_values(df: DataFrame, column: str) -> DataFrame:
    """level_index and level: all declared levels of a factor, also unused ones; false and true of a Boolean; the distinct values
    of text and whole numbers, in order; nothing of other types."""
    spark, kind, named = df.sparkSession, df.schema[column].dataType, declared_levels(df, column)
    if isinstance(kind, T.BooleanType):
        named = ["false", "true"]
    if named or not isinstance(kind, (T.StringType, T.IntegralType)):
        return spark.createDataFrame(list(enumerate(named)), "level_index int, level string")
    found = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_v")).distinct()
    # Levels are few; numbering them takes one window.
    return found.select((F.row_number().over(Window.orderBy("_v")) - 1).alias("level_index"), F.col("_v").cast("string").alias("level"))


def level_counts(df: DataFrame, column: str) -> DataFrame:
    """level and n of every declared level of a factor or both Booleans, 0 where no row has it."""
    counts = df.groupBy(F.col(column).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(unique_values(df, column).select("level")).join(counts, "level", "left").fillna(0, ["n"])


def clear(df: DataFrame) -> Column:
    """A selection of nothing."""
    return F.lit(False)


def add_column(df: DataFrame, other: DataFrame, row_index: str, column: str, force: bool = False) -> DataFrame:
    """``df`` with a column of another table by row index. A name that exists is an error without ``force``, and so are tables of different rows."""
    if column in df.columns and not force:
        raise ValueError(f"column {column} exists")
    own, rows = other.select(row_index, column), df.select(row_index)
    if not (rows.join(own, row_index, "left_anti").isEmpty() and own.join(rows, row_index, "left_anti").isEmpty()):
        raise ValueError("the tables have different rows")
    return df.drop(column).join(own, row_index)


def levels(df: DataFrame, column: str, row_index: str) -> DataFrame:
    """Distinct values of a text or whole-number column with the row that shows each first: level, first_row."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("level")).agg(F.min(row_index).alias("first_row"))


def factor_codes(df: DataFrame, column: str, names: Sequence[str]) -> Column:
    """Zero-based place of a label among the declared levels, -1 for others."""
    return F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column)).cast("int") - 1


def pairs(df: DataFrame, ident: str, order: str, first: str, second: str, row_index: str) -> DataFrame:
    """For each id the last row of either order value: id, first_row, second_row; ids that lack one are left out."""
    at = lambda v: F.max(F.when(F.col(order) == v, F.col(row_index)))
    return df.groupBy(F.col(ident).alias("id")).agg(at(first).alias("first_row"), at(second).alias("second_row")).where("first_row IS NOT NULL AND second_row IS NOT NULL")


def series(df: DataFrame, ident: str, row_index: str, min_points: int = 2, *keep: str) -> DataFrame:
    """One row a point: series_id, pos (from 0, in row order), row_index and the columns ``keep``; series with fewer points are left out.

    A series is one entity's repeated measurements; the window runs over one of them at a time.
    """
    out = df.select(F.col(ident).alias("series_id"), F.col(row_index).alias("row_index"), *keep)
    own = Window.partitionBy("series_id")
    out = out.withColumns({"_n": F.count(F.lit(1)).over(own), "pos": F.row_number().over(own.orderBy("row_index")) - 1})
    return out.where(F.col("_n") >= min_points).select("series_id", "pos", "row_index", *keep)


def merge(left: DataFrame, right: DataFrame, row_index: str = "row_index", overwrite: bool = False, simple_only: bool = False) -> DataFrame:
    """Columns of both tables by row index. Of equal names the left one stays, or the right one with ``overwrite``.

    ``simple_only`` takes only columns of plain values from the right table.
    """
    taken = [f.name for f in right.schema if f.name != row_index and not (simple_only and isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.BinaryType)))]
    clash = set(taken) & set(left.columns)
    if overwrite:
        left = left.drop(*clash)
    else:
        taken = [c for c in taken if c not in clash]
    return left.join(right.select(row_index, *taken), row_index, "left")


def append_default(df: DataFrame, row_index: str) -> DataFrame:
    """One more row with the next index and the types' default values."""
    default = {T.StringType: F.lit(""), T.BooleanType: F.lit(False)}
    fields = [F.lit(0).cast(f.dataType) if isinstance(f.dataType, T.NumericType) else default.get(type(f.dataType), F.lit(None)).cast(f.dataType) for f in df.schema]
    row = df.agg((F.coalesce(F.max(row_index), F.lit(-1)) + 1).alias("_next"))
    row = row.select(*[(F.col("_next") if f.name == row_index else c).cast(f.dataType).alias(f.name) for f, c in zip(df.schema, fields, strict=True)])
    return df.unionByName(row)


def delete_row(df: DataFrame, row_index: str, at: int) -> DataFrame:
    """Without the row, the rows after it moving up by one."""
    i = F.col(row_index)
    return df.where(i != at).withColumn(row_index, F.when(i > at, i - 1).otherwise(i))


def set_cell(df: DataFrame, row_index: str, at: int, column: str, literal: str) -> DataFrame:
    value = F.lit(_typed(df, column, literal)).cast(df.schema[column].dataType)
    return df.withColumn(column, F.when(F.col(row_index) == at, value).otherwise(F.col(column)))


def display(df: DataFrame, column: str) -> Column:
    """A cell as text; null as "(null)"."""
    return F.coalesce(F.col(column).cast("string"), F.lit("(null)"))


def columns_of_type(df: DataFrame, *kinds: type) -> list[str]:
    """Names of the columns of some types: which columns an analysis can take."""
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def column_window(df: DataFrame, names: Sequence[str], first: int, count: int, pattern: str = "PC{0}") -> DataFrame:
    """A window of columns renamed by a pattern with the zero-based number."""
    return df.select(*[F.col(c).alias(pattern.format(first + k)) for k, c in enumerate(names[first : first + count])])


def parse_column_ranges(text: str) -> list[int]:
    """``1-3,5`` (from 1, inclusive) as zero-based numbers."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        low, _, high = part.partition("-")
        out += range(int(low) - 1, int(high or low))
    return out


def parse_index_list(text: str) -> list[int]:
    """Non-negative numbers of a comma list; anything else is left out."""
    return [int(p) for p in (x.strip() for x in text.split(",")) if p.isdecimal()]
