"""Quality rules as a short-circuit cascade, native DataFrame functions only.

A rule is a test on measures of a text. ``plan_order`` estimates on a sample what each measure costs and which rows
each rule rejects, and puts first the rule with the most rejections per second that it adds. ``keep_documents`` runs
the rules one after the other in that order: a rejected row is gone before the next rule's measures are taken, and
arrays that no later rule needs are dropped on the way. The verdict is a conjunction, so the sample decides how
fast the cascade runs and never what it returns.

There is no shuffle: a text's words, lines and windows stay in arrays of its own row.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allometra.llm.common import SPACE_CLASS, packed, word_array

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "[#*$%&|<>]+"
SAMPLE_ROWS = 1000


@dataclass(frozen=True)
class Measure:
    """A column computed from the columns named in ``needs``, which are ``_text`` or other measures."""

    needs: tuple[str, ...]
    make: Callable[[], Column]


def _windows() -> Column:
    window = lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)])
    return F.when(F.size("_hashes") > WINDOW, F.transform(F.sequence(F.lit(0), F.size("_hashes") - WINDOW), window))


def _placed() -> Column:
    """Windows with their places, in order of the window; null where all windows differ."""
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    return F.when(repeated, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))


def _starts() -> Column:
    """Where the windows begin that stand twice or more."""
    same = lambda w, j: (F.get("_placed", j - 1)["h"] == w["h"]) | (F.get("_placed", j + 1)["h"] == w["h"])
    twice = F.filter("_placed", lambda w, j: F.coalesce(same(w, j), F.get("_placed", j + 1)["h"] == w["h"], F.lit(False)))
    return F.sort_array(F.transform(twice, lambda w: w["i"]))


def _n_repeat_words() -> Column:
    """Each start covers the words that no earlier start covers."""
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("covered"))
    add = lambda acc, i: F.struct(i.alias("last"), (acc["covered"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("covered"))
    return F.coalesce(F.aggregate("_starts", start, add, lambda acc: acc["covered"]), F.lit(0)).cast("long")


MEASURES = {
    "_words": Measure(("_text",), lambda: word_array(F.col("_text"))),
    "n_words": Measure(("_words",), lambda: F.size("_words").cast("long")),
    "word_chars": Measure(("_words",), lambda: F.length(F.array_join("_words", "")).cast("long")),
    "n_symbols": Measure(("_text",), lambda: (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS, ""))).cast("long")),
    "_lines": Measure(("_text",), lambda: F.filter(F.split("_text", "\n"), lambda line: F.regexp_replace(line, SPACE_CLASS + "+", "") != "")),
    "_n_lines": Measure(("_lines",), lambda: F.size("_lines")),
    "n_dup_lines": Measure(("_lines",), lambda: (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")),
    "_hashes": Measure(("_words",), lambda: F.transform("_words", lambda w: F.xxhash64(w))),
    "_windows": Measure(("_hashes",), _windows),
    "_placed": Measure(("_windows",), _placed),
    "_starts": Measure(("_placed",), _starts),
    "n_repeat_words": Measure(("_starts",), _n_repeat_words),
    "_n_upper": Measure(("_text",), lambda: F.length(F.regexp_replace("_text", r"\P{Lu}+", ""))),
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a test on the measures named in ``needs``."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[], Column]


def default_rules() -> list[Rule]:
    return [
        Rule("too_few_words", ("n_words",), lambda: F.col("n_words") < MIN_WORDS),
        Rule("symbols", ("n_words", "n_symbols"), lambda: F.col("n_symbols") * 10 > F.col("n_words")),
        Rule("repeated_words", ("n_words", "n_repeat_words"), lambda: F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT),
        Rule("duplicate_lines", ("n_dup_lines", "_n_lines"), lambda: (F.col("n_dup_lines") > 2) & (F.col("n_dup_lines") * 10 > F.col("_n_lines") * 3)),
        Rule("word_length", ("n_words", "word_chars"), lambda: (F.col("word_chars") < F.col("n_words") * 2) | (F.col("word_chars") > F.col("n_words") * 20)),
        Rule("upper_case", ("word_chars", "_n_upper"), lambda: F.col("_n_upper") * 2 > F.col("word_chars")),
    ]


#: Rules whose failure makes a document ``base_failed``.
BASE_RULES = ("too_few_words", "repeated_words")
BASE_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def chain(names: Collection[str], have: Collection[str] = ("_text",)) -> list[str]:
    """The measures that ``names`` take, each after those that it needs, without those that are there."""
    out: list[str] = []
    for name in names:
        if name not in have and name not in out:
            out += [m for m in chain(MEASURES[name].needs, have) if m not in out] + [name]
    return out


def measured(df: DataFrame, names: Collection[str], keep: Collection[str]) -> DataFrame:
    """``df`` with the measures ``names``; of other measures and the text just those in ``keep`` stay."""
    for name in chain(names, df.columns):
        df = df.withColumn(name, MEASURES[name].make())
    return df.select([c for c in df.columns if c in names or c in keep])


def plan_order(documents: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[Rule]:
    """Rules by rejections per second of added work, most first, as a Bernoulli sample of about ``sample_rows`` rows shows them.

    A measure's cost is the time that a job with it takes over the one that stops before it, each the least of three
    runs after one that compiles. A rule is charged with the measures that no rule before it has taken, and
    credited with the rows that none before it rejects.
    """
    total = documents.count()
    if total == 0:
        return list(rules)
    sample = documents.select(F.coalesce("text", F.lit("")).alias("_text")).sample(min(1.0, sample_rows / total), seed).repartition(4).persist()
    sample.count()

    def seconds(names: Sequence[str]) -> float:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            measured(sample, names, ()).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        return min(runs[1:])

    cost = {}
    for name in chain([m for rule in rules for m in rule.needs]):
        needs = MEASURES[name].needs
        cost[name] = max(1e-4, seconds((name,)) - seconds([n for n in needs if n != "_text"]))
    verdicts = measured(sample, [m for rule in rules for m in rule.needs], ()).select(*[F.coalesce(rule.rejects(), F.lit(False)).alias(rule.name) for rule in rules]).collect()
    sample.unpersist()
    left, done, order = list(rules), ["_text"], []
    while left:
        added = {rule.name: sum(cost[m] for m in chain(rule.needs, done)) or 1e-4 for rule in left}
        best = max(left, key=lambda rule: (sum(v[rule.name] for v in verdicts) / added[rule.name], -added[rule.name], rule.name))  # noqa: B023
        order.append(best)
        left.remove(best)
        done += chain(best.needs, done)
        verdicts = [v for v in verdicts if not v[best.name]]
    return order


def cascade(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows (``_row``, ``_text``) that no rule rejects, as ``_row``.

    Between two rules stands a generator, through which no filter is pushed and no projection is merged: each rule is
    compiled alone and sees just the rows that are left.
    """
    for k, rule in enumerate(rules):
        have = {*rows.columns, *chain(rule.needs, rows.columns)}
        asked = [m for r in rules[k + 1 :] for m in r.needs]
        inputs = {n for m in chain(asked, have) for n in MEASURES[m].needs}
        kept = ["_row", *sorted(have & {*asked, *inputs})]
        alive = ~F.coalesce(rule.rejects(), F.lit(False))
        rows = measured(rows, rule.needs, kept).select(F.inline(F.when(alive, F.array(F.struct(*kept)))))
    return rows.select("_row")


def score_documents(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Measures and verdict of every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept
    and rejected_by (the rule that spoke first; it depends on the planned order, the verdict does not). The five
    measures are asked for of every row; what else a rule needs is taken only where no rule before it rejects.

    Null or empty text: no words, all measures 0, base_failed. Very long texts are measured whole. Repeated
    rows each give a row; an empty table gives an empty result; other columns of the input are ignored.
    Windows are compared by 64-bit hashes within one text.
    """
    rules = plan_order(documents, default_rules(), sample_rows)
    df = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    df = measured(df, (*BASE_MEASURES, "_n_lines"), ("doc_id", "_text"))
    rejected = F.lit(None).cast("string")
    for rule in rules:
        for name in chain(rule.needs, df.columns):
            df = df.withColumn(name, F.when(rejected.isNull(), MEASURES[name].make()))
        rejected = F.coalesce(rejected, F.when(rule.rejects(), F.lit(rule.name)))
    base = {rule.name: rule for rule in rules}
    failed = base["too_few_words"].rejects() | base["repeated_words"].rejects()
    df = df.withColumn("rejected_by", rejected)
    return df.select("doc_id", *BASE_MEASURES, failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"), "rejected_by")


def keep_documents(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``documents`` that every rule lets through, with their columns as they came.

    The cascade runs over the rows themselves, packed in one struct, so that extra columns keep their names,
    repeated rows stay repeated and nothing is joined back. Null and empty texts have too few words and go; very long
    texts are judged whole; an empty table gives an empty result.
    """
    rules = plan_order(documents, default_rules(), sample_rows)
    rows = documents.select(packed(documents), F.coalesce("text", F.lit("")).alias("_text"))
    return cascade(rows, rules).select("_row.*")
