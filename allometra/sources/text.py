"""Delimited text in and out: rows of cells, typed columns, landmark files, and files of plain lines."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allometra.sources.scratch import written


#: Parts the texts of a file that holds many of them.
PAGE = "\f"


def texts(spark: SparkSession, path: str, paged: bool = False) -> DataFrame:
    """path and value of the text files under ``path``, a file one row; if they are ``paged``, each page is one.

    Pages are as ``write_pages`` makes them: the first line is a name, and the path is the file's, ``#`` and that name. Files are split between pages.
    """
    if not paged:
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parts = F.split("value", r"\r?\n", 2)
    return spark.read.text(path, lineSep=PAGE).select(F.concat("_metadata.file_path", F.lit("#"), parts[0]).alias("path"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("value"))


def write_pages(rows: DataFrame, path: str) -> None:
    """Many small texts (name, value) in few files, one a partition, each text a page under its name; a form feed in a text, or a name of several lines, is an error."""
    odd = F.contains("value", F.lit(PAGE)) | F.col("name").rlike(r"[\f\r\n]") | F.col("name").isNull()
    page = F.when(odd, F.raise_error(F.lit("a form feed in a text, or a name that is no line"))).otherwise(F.concat_ws("\n", "name", "value"))
    rows.select(page.alias("value")).write.text(path, lineSep=PAGE)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_index (from 0, by file) and value of every line of the text files under ``path``.

    Files are split as Spark likes. Lines are numbered within each split, and splits by the counts of those before: no
    task sees more of a file than one split.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value"
    )
    split = Window.partitionBy("path", "_block").orderBy("_at")
    counts = raw.groupBy("path", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("path", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = raw.withColumn("_inside", F.row_number().over(split) - 1).join(counts, ["path", "_block"])
    return numbered.select("path", (F.col("_before") + F.col("_inside")).alias("line_index"), "value")


def cells(line: Column, separators: str) -> Column:
    """The cells of a line, any of ``separators`` parting two; in double quotes a cell may hold separators, and the quotes go."""
    one = "[" + "".join("\\t" if s == "\t" else f"\\{s}" if s in "\\]^-" else s for s in separators) + "]"
    other = "[^" + one[1:]
    # A separator in front of the first cell makes every match begin with one.
    found = F.regexp_extract_all(F.concat(F.lit(separators[0]), line), F.lit(f'{one}("[^"]*"?{other}*|{other}*)'), F.lit(1))
    return F.transform(found, lambda c: F.regexp_replace(c, '(?s)^"([^"]*)"?', "$1"))


def _open_after(line: Column, separators: str) -> Column:
    """Whether a quoted cell is open at the end of a line: of one that begins a row, and of one that goes on inside a quoted cell."""
    one = "[" + "".join("\\t" if s == "\t" else f"\\{s}" if s in "\\]^-" else s for s in separators) + "]"
    other = "[^" + one[1:]
    ends = f'("[^"]*"{other}*|(?!"){other}*)'
    row = f'{ends}({one}{ends})*'
    return F.struct((~line.rlike(f"^{row}$")).alias("fresh"), (~line.rlike(f'^[^"]*"{other}*({one}{ends})*$')).alias("inside"))


def records(rows: DataFrame, separators: str) -> DataFrame:
    """Lines (path, line_index, value) joined where a quoted cell goes on: path, line_index of the first line, and value.

    Each line says what it makes of an open and of a closed cell; the windows, by file, have only lines with quotes.
    """
    judged = rows.withColumn("_open", _open_after(F.col("value"), separators))
    # A line opens a cell, closes one, turns the state around, or leaves it; only the last kind needs no look at others.
    marks = judged.where("_open.fresh OR NOT _open.inside").select("path", "line_index", "_open")
    if marks.where("_open.fresh").isEmpty():  # every quote closes in its line
        return rows
    order = Window.partitionBy("path").orderBy("line_index")
    marks = marks.withColumn("_turns", F.sum((F.col("_open.fresh") & ~F.col("_open.inside")).cast("int")).over(order))
    fixed = F.when(F.col("_open.fresh") == F.col("_open.inside"), F.struct(F.col("_open.fresh").alias("open"), "_turns"))
    marks = marks.withColumn("_fixed", F.last(fixed, ignorenulls=True).over(order))
    turned = (F.col("_turns") - F.coalesce("_fixed._turns", F.lit(0))) % 2 == 1
    marks = marks.withColumn("_is", F.coalesce("_fixed.open", F.lit(False)) != turned)
    spans = marks.withColumn("_was", F.coalesce(F.lag("_is").over(order), F.lit(False))).where("_was <> _is")
    spans = spans.withColumn("_end", F.lead("line_index").over(order)).where("_is").select("path", F.col("line_index").alias("_begin"), F.coalesce("_end", "line_index").alias("_end"))
    inside = spans.select("path", "_begin", F.explode(F.sequence("_begin", "_end")).alias("line_index"))
    placed = rows.join(inside, ["path", "line_index"], "left").withColumn("_begin", F.coalesce("_begin", "line_index"))
    joined = placed.groupBy("path", "_begin").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "value"))), lambda x: x["value"]), "\n").alias("value"))
    return joined.select("path", F.col("_begin").alias("line_index"), "value")


def read_delimited(spark: SparkSession, path: str, separators: str = ",", skip_first: bool = False, skip_empty: bool = True) -> DataFrame:
    """path, row_index (from 0, by file, of the rows that stay in order but not without gaps) and cells of every row; rows may differ in length.

    A cell in double quotes may hold line ends. A quote that never closes opens nothing but its own line.
    """
    out = records(lines(spark, path), separators)
    if skip_first:
        out = out.where("line_index > 0")
    if skip_empty:
        out = out.where("value <> ''")
    return out.select("path", F.col("line_index").alias("row_index"), cells(F.col("value"), separators).alias("cells"))


@dataclass(frozen=True)
class Field:
    """A typed column made of cell number ``index`` (from 0); ``kind``: integer, real, string, boolean, factor or reference."""

    name: str
    kind: str
    index: int
    levels: Sequence[str] = ()


def typed(rows: DataFrame, fields: Sequence[Field], *keep: str) -> DataFrame:
    """Typed columns from ``cells``. What is missing or does not parse becomes 0, 0.0, the empty text or false.

    A factor is the label itself, null if it is none of its levels; ``table.levels`` finds levels where none are given. A
    reference is a struct of path (with slashes) and format by the file's ending, null for an unknown one.
    """

    def column(f: Field) -> Column:
        cell = F.get("cells", F.lit(f.index))
        bare = F.trim(cell)
        if f.kind == "integer":
            return F.coalesce(bare.try_cast("long"), F.lit(0).cast("long"))
        if f.kind == "real":
            return F.coalesce(bare.try_cast("double"), F.lit(0.0))
        if f.kind == "boolean":
            return F.coalesce(F.lower(bare) == "true", F.lit(False))
        if f.kind == "factor":
            return F.when(cell.isin(*f.levels), cell) if f.levels else cell
        if f.kind == "reference":
            path = F.regexp_replace(cell, r"\\", "/")
            ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
            kind = F.coalesce(*[F.when(ending == e, F.lit(FORMATS[e])) for e in FORMATS])
            return F.when(kind.isNotNull(), F.struct(path.alias("path"), kind.alias("format")))
        if f.kind == "string":
            return F.coalesce(cell, F.lit(""))
        raise ValueError(f"no kind {f.kind}")

    return rows.select(*keep, *[column(f).alias(f.name) for f in fields])


# What the endings of referenced files say.
FORMATS = {"obj": "obj", "ply": "ply", "txt": "landmarks", "jpg": "image", "jpeg": "image", "png": "image"}


def floats(text: Column, separator: str) -> Column:
    """The numbers of a text, by a separator; what does not parse is null, and no text gives an empty array."""
    parts = F.split(text, f"\\Q{separator}\\E")
    return F.when(F.trim(text) == "", F.array().cast("array<double>")).otherwise(F.transform(parts, lambda p: F.trim(p).try_cast("double")))


def read_landmarks(spark: SparkSession, path: str, paged: bool = False) -> tuple[DataFrame, DataFrame]:
    """Landmark files: a label, a tab, and two or three numbers parted by tabs in each line; lines without a tab are left out.

    Returns vertices (path, vertex_id, x, y, z; z null in the plane) and errors (path, message) of files whose lines
    differ in length or hold something else; these give no vertices. A landmark file, or a page of ``paged`` files, is small: each is one row,
    read and parsed once for both tables.
    """
    files = texts(spark, path, paged).select("path", F.split("value", r"\r\n|\r|\n").alias("lines"))
    marked = F.filter("lines", lambda line: F.instr(line, "\t") > 0)
    numbers = F.transform(marked, lambda line: floats(F.substring(line, F.instr(line, "\t") + 1, F.length(line)), "\t"))
    rows = files.select("path", F.filter(numbers, lambda v: F.size(v) > 0).alias("v")).where(F.size("v") > 0)
    sizes = F.transform("v", lambda v: F.size(v))
    bad = F.exists("v", lambda v: F.exists(v, lambda x: x.isNull()))
    message = F.when(F.array_min(sizes) != F.array_max(sizes), "lines of different length").when(~F.array_min(sizes).isin(2, 3), "neither two nor three numbers").when(bad, "not a number")
    judged = written(rows.withColumn("message", message))
    good = judged.where("message IS NULL").select("path", F.posexplode("v").alias("vertex_id", "p"))
    return good.select("path", "vertex_id", *[F.get("p", F.lit(k)).alias(c) for k, c in enumerate("xyz")]), judged.where("message IS NOT NULL").select("path", "message")


def as_lines(df: DataFrame, separator: str = ",", null_text: str = "") -> DataFrame:
    """One text column ``value``: the plain columns of each row, cells with separators or quotes in quotes; nested columns are left out."""
    plain = [f for f in df.schema if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.BinaryType))]

    def cell(f: T.StructField) -> Column:
        text = F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit(null_text))
        return F.when(F.contains(text, F.lit(separator)) | text.rlike('["\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit("'")), F.lit('"'))).otherwise(text)

    return df.select(F.concat_ws(separator, *[cell(f) for f in plain]).alias("value"))


def write_delimited(df: DataFrame, path: str, separator: str = ",", header: bool = True, null_text: str = "") -> None:
    """A folder of text files with the plain columns of ``df``; each file begins with the names if ``header`` says so.

    Rows keep their order within a file. Double quotes inside a cell become single ones, as the reader knows no escapes.
    """
    plain = [f.name for f in df.schema if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.BinaryType))]
    if not header:
        as_lines(df, separator, null_text).write.text(path)
        return
    quoted = df.select(*[F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(null_text)), F.lit('"'), F.lit("'")).alias(c) for c in plain])
    quoted.write.option("header", True).option("sep", separator).option("emptyValue", "").option("escapeQuotes", False).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
