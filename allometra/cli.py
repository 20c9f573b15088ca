"""Command line: what a project holds, a report on an entry, and a table as text.

    python -m allometra.cli --open PROJECT --info
    python -m allometra.cli --open PROJECT --list [kind=correspondence]
    python -m allometra.cli --open PROJECT --columns
    python -m allometra.cli --open PROJECT --report 2
    python -m allometra.cli --open PROJECT --export 2 FOLDER [separator=;]

Several commands may follow one another; each works on the project opened last.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from allometra.sources import catalog, text

SHORT = {"o": "open", "i": "info", "l": "list", "c": "columns", "r": "report", "e": "export"}


def commands(arguments: Sequence[str]) -> list[tuple[str, list[str], dict[str, str]]]:
    """name, plain and named (``key=value``) parameters of each command; what begins with a dash begins a command."""
    out: list[tuple[str, list[str], dict[str, str]]] = []
    for word in arguments:
        if word.startswith("-") and len(word.lstrip("-")) > 0:
            name = word.lstrip("-")
            out.append((SHORT.get(name, name) if not word.startswith("--") else name, [], {}))
        elif not out:
            raise ValueError(f"{word}: no command")
        else:
            key, mark, value = word.partition("=")
            if mark and key.isidentifier():
                out[-1][2][key] = value
            else:
                out[-1][1].append(word)
    return out


def _lines(df: DataFrame, *order: str) -> list[str]:
    """The rows of a short listing, cells parted by tabs."""
    return ["\t".join("" if v is None else str(v) for v in row) for row in df.orderBy(*order).collect()]


def run(spark: SparkSession, arguments: Sequence[str], say: Callable[[str], None] = print) -> None:
    """All commands in order. An unknown command, a missing parameter or a project that is not there is a ValueError."""
    path = None
    for name, plain, named in commands(arguments):
        if name == "open":
            (path,) = plain or [None]
            catalog.entries(spark, path or "")
            continue
        if name not in ("info", "list", "columns", "report", "export"):
            raise ValueError(f"no command {name}")
        if path is None:
            raise ValueError(f"{name}: no project is open")
        found = catalog.entries(spark, path, named.get("kind"))
        if name == "info":
            say(f"{path}: version {catalog.latest(spark, path)}")
            for line in _lines(found.groupBy("kind").count(), "kind"):
                say(line)
        elif name == "list":
            for line in _lines(found.selectExpr("id", "kind", "name", "array_join(deps, ',')"), "id"):
                say(line)
        elif name == "columns":
            for line in _lines(catalog.columns_of(spark, path), "entry_id", "column"):
                say(line)
        elif not plain or not plain[0].isdecimal():
            raise ValueError(f"{name}: the number of an entry is missing")
        elif name == "report":
            for section, key, value in catalog.summary(spark, path, int(plain[0])).orderBy("place").select("section", "key", "value").collect():
                say(f"{section}\t{key}\t{value}")
        else:
            if len(plain) < 2:
                raise ValueError("export: a folder is missing")
            text.write_delimited(catalog.full_table(spark, path, int(plain[0])), plain[1], named.get("separator", ","))


def main() -> None:
    if len(sys.argv) < 2:
        print(__doc__)
        return
    spark = SparkSession.builder.appName("allometra").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        run(spark, sys.argv[1:])
    except ValueError as error:
        sys.exit(str(error))


if __name__ == "__main__":
    main()
