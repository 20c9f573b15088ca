"""Secret scan, native DataFrame functions only.

Three patterns give the base spans: assignments, access keys and long hexadecimal runs. On top of them,
Shannon entropy in a sliding window finds other random-looking strings: each window's character counts
follow from the ones before by adding the character that enters and taking away the one that leaves.
The threshold depends on the character class of the candidate. An allow-list suppresses placeholders.

Offsets are code points, end exclusive. A text's matches stay in arrays of its own row: no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allometra.llm.common import let

# The base patterns and the least lengths of what counts.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
MIN_ASSIGNED = 8

#: Kinds in their order at equal starts.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
#: Bits a character that a window must reach; a window of 20 holds 4.32 at most.
MIN_BITS = {"entropy_hex": 3.0, "entropy_base64": 3.85}
CHUNK = 1024
BLOCK = 256

ALLOW = (
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]",
    r"(?i)x{8,}|0{12,}|abcdefgh|01234567",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
)

_SCALE = 1_000_000
#: count * log2(count), in millionths, so that sums are exact in any order.
_TERMS = [0, *(round(_SCALE * c * math.log2(c)) for c in range(1, WINDOW + 1))]


def _limit(bits: float) -> int:
    """Entropy is log2(WINDOW) - sum(count * log2(count)) / WINDOW: the largest sum that reaches ``bits``."""
    return math.floor(_SCALE * WINDOW * (math.log2(WINDOW) - bits))


def _runs(text: Column, pattern: str, detail_group: int | None = None) -> Column:
    """Matches in order as structs (start, end, detail): the gaps between matches give the places.

    Blocks of ``BLOCK`` matches keep the cost of appending linear for texts with very many matches.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    detail = F.regexp_extract_all(text, F.lit(pattern), F.lit(detail_group)) if detail_group else found
    sizes = F.zip_with(F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))), detail, lambda s, d: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), d.alias("detail")))
    sizes = F.filter(sizes, lambda s: s["size"].isNotNull())
    nothing = F.array().cast("array<struct<start:int,end:int,detail:string>>")

    def one(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        span = F.struct(start.alias("start"), (start + s["size"]).alias("end"), s["detail"].alias("detail"))
        return F.struct((start + s["size"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def block(sizes: Column):
        def step(acc: Column, i: Column) -> Column:
            inner = F.aggregate(F.slice(sizes, i * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["at"].alias("at"), nothing.alias("out")), one)
            return let(inner, lambda done: F.struct(done["at"].alias("at"), F.concat(acc["out"], F.array(done["out"])).alias("out")))

        return step

    def spans(sizes: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,detail:string>>>").alias("out"))
        return F.when(F.size(sizes) == 0, nothing).otherwise(F.aggregate(blocks, start, block(sizes), lambda acc: F.flatten(acc["out"])))

    return let(sizes, spans)


def _labelled(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _windows_of(chunk: Column, limit: Column, mixed: Column) -> Column:
    """Merged spans, within ``chunk``, of the windows whose entropy reaches the threshold.

    ``mixed`` asks that the window also holds a digit and a letter.
    """
    codes = F.transform(F.sequence(F.lit(1), F.length(chunk)), lambda i: F.ascii(F.substring(chunk, i, 1)))
    terms = F.array(*[F.lit(t) for t in _TERMS])

    def scan(codes: Column, letters: Column, places: Column) -> Column:
        is_digit = lambda code: F.when((code >= 48) & (code <= 57), 1).otherwise(0)
        start = F.struct(
            F.transform(letters, lambda _: F.lit(0)).alias("counts"),
            F.lit(0).alias("total"),
            F.lit(0).alias("digits"),
            F.array().cast("array<struct<start:int,end:int>>").alias("out"),
        )

        def step(acc: Column, i: Column) -> Column:
            enters, leaves = F.get(places, i), F.get(places, i - WINDOW)
            gain = lambda c: F.get(terms, c + 1) - F.get(terms, c)
            same = F.coalesce(enters == leaves, F.lit(False))
            total = (
                acc["total"]
                + F.when(same, 0).otherwise(gain(F.get(acc["counts"], enters)))
                - F.when(same | leaves.isNull(), 0).otherwise(gain(F.get(acc["counts"], leaves) - 1))
            )
            counts = F.transform(acc["counts"], lambda c, k: c + F.when(k == enters, 1).otherwise(0) - F.when(k == leaves, 1).otherwise(0))
            digits = acc["digits"] + is_digit(F.get(codes, i)) - F.coalesce(is_digit(F.get(codes, i - WINDOW)), F.lit(0))

            def close(now: Column) -> Column:
                hit = (i >= WINDOW - 1) & (now["total"] <= limit) & (~mixed | ((now["digits"] > 0) & (now["digits"] < WINDOW)))
                begin, last = i - (WINDOW - 1), F.get(acc["out"], F.size(acc["out"]) - 1)
                joins = F.coalesce(last["end"] >= begin, F.lit(False))
                grown = F.concat(
                    F.when(joins, F.slice(acc["out"], 1, F.size(acc["out"]) - 1)).otherwise(acc["out"]),
                    F.array(F.struct(F.when(joins, last["start"]).otherwise(begin).alias("start"), (i + 1).alias("end"))),
                )
                return F.struct(now["counts"].alias("counts"), now["total"].alias("total"), now["digits"].alias("digits"), F.when(hit, grown).otherwise(acc["out"]).alias("out"))

            return let(F.struct(counts.alias("counts"), total.alias("total"), digits.alias("digits")), close)

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda acc: acc["out"])

    place = lambda codes: lambda letters: let(F.transform(codes, lambda c: (F.array_position(letters, c) - 1).cast("int")), lambda places: scan(codes, letters, places))
    return let(codes, lambda codes: let(F.array_distinct(codes), place(codes)))


def _entropy_spans(candidate: Column) -> Column:
    """Spans, in the text, of one candidate (start, end, detail); long candidates go in overlapping chunks."""
    is_hex = candidate["detail"].rlike("^([0-9a-f]+|[0-9A-F]+)$")
    kind = F.when(is_hex, F.lit("entropy_hex")).otherwise(F.lit("entropy_base64"))
    limit = F.when(is_hex, F.lit(_limit(MIN_BITS["entropy_hex"]))).otherwise(F.lit(_limit(MIN_BITS["entropy_base64"])))
    size = candidate["end"] - candidate["start"]
    chunks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((size - WINDOW) / CHUNK)).cast("int"))
    of_chunk = lambda k: F.transform(
        _windows_of(F.substring(candidate["detail"], k * CHUNK + 1, F.lit(CHUNK + WINDOW - 1)), limit, ~is_hex),
        lambda s: F.struct((candidate["start"] + k * CHUNK + s["start"]).alias("start"), (candidate["start"] + k * CHUNK + s["end"]).alias("end")),
    )

    def merge(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), s["end"].alias("end"))))
        return F.when(F.coalesce(last["end"] >= s["start"], F.lit(False)), joined).otherwise(F.concat(acc, F.array(s)))

    merged = F.aggregate(F.flatten(F.transform(chunks, of_chunk)), F.array().cast("array<struct<start:int,end:int>>"), merge)
    return F.transform(merged, lambda s: F.struct(s["start"].alias("start"), F.when(is_hex, KINDS.index("entropy_hex")).otherwise(KINDS.index("entropy_base64")).alias("rank"), kind.alias("kind"), s["end"].alias("end")))


def _marks(base: Column, spans: Column, at, before: bool, test) -> Column:
    """'1' or '0' for each span, in order: ``test`` of the farthest end among the base spans that start before ``at`` of the span, and of the span.

    ``spans`` are in order of ``at``; ``before`` counts base spans that start just there, too. Both arrays are walked once,
    merged by place.
    """
    events = F.sort_array(
        F.concat(
            F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("order"), F.lit(0).alias("start"), b["end"].alias("end"))),
            F.transform(spans, lambda s: F.struct(at(s).alias("at"), F.lit(2 if before else 0).alias("order"), s["start"].alias("start"), s["end"].alias("end"))),
        )
    )

    def step(acc: Column, e: Column) -> Column:
        is_base = e["order"] == 1
        mark = F.when(is_base, "").when(test(acc["reach"], e), "1").otherwise("0")
        return F.struct(F.when(is_base, F.greatest(acc["reach"], e["end"])).otherwise(acc["reach"]).alias("reach"), F.concat(acc["marks"], mark).alias("marks"))

    return F.aggregate(events, F.struct(F.lit(-1).alias("reach"), F.lit("").alias("marks")), step, lambda acc: F.split(acc["marks"], ""))


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(documents: DataFrame, allow: Sequence[str] = ALLOW) -> DataFrame:
    """Spans of secrets in every document: doc_id, base and added, arrays of (start, rank, kind, end).

    Base spans always stay. An entropy span is added where it overlaps no base span and its candidate (a run
    of 20 or more characters of the base64 alphabets with a digit and a letter in it) matches no pattern of ``allow``.

    Null or empty text: no spans. Repeated rows each give a row; an empty table gives an empty result; other
    columns of the input are ignored.
    """
    text = F.col("_text")
    df = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    assigned = F.filter(_runs(text, ASSIGN, 2), lambda s: F.length(s["detail"]) >= MIN_ASSIGNED)
    df = df.select(
        "doc_id",
        "_text",
        F.when(text.rlike(ASSIGN_HEAD), _labelled(assigned, "assign")).otherwise(none).alias("_assign"),
        F.when(text.rlike(ACCESS), _labelled(_runs(text, ACCESS), "access")).otherwise(none).alias("_access"),
        F.when(text.rlike(HEX), _labelled(_runs(text, HEX), "hex")).otherwise(none).alias("_hex"),
        F.when(text.rlike(CANDIDATE), _runs(text, CANDIDATE)).alias("_runs"),
    )
    df = df.select("doc_id", F.sort_array(F.concat("_assign", "_access", "_hex")).alias("base"), "_runs")

    def suspicious(run: Column) -> Column:
        plain = run["detail"].rlike("[0-9]") & run["detail"].rlike("[A-Za-z]")
        for pattern in allow:
            plain = plain & ~run["detail"].rlike(pattern)
        return plain

    base, runs = F.col("base"), F.col("_runs")
    inside = _marks(base, runs, lambda s: s["start"], True, lambda reach, s: reach >= s["end"])
    own = let(inside, lambda marks: F.filter(runs, lambda run, i: suspicious(run) & (F.get(marks, i) == "0")))
    added = let(F.flatten(F.transform(own, _entropy_spans)), lambda found: _apart(base, found))
    return df.select("doc_id", "base", F.when(F.size("_runs") > 0, added).otherwise(none).alias("added"))


def _apart(base: Column, spans: Column) -> Column:
    """The spans, in order, that overlap no base span."""
    meets = _marks(base, spans, lambda s: s["end"], False, lambda reach, s: reach > s["start"])
    return let(meets, lambda marks: F.filter(spans, lambda s, i: F.get(marks, i) == "0"))


def secret_report(documents: DataFrame, allow: Sequence[str] = ALLOW) -> DataFrame:
    """One row a document: counts of the base kinds, digest of the base spans and all spans as text."""
    spans = find_secrets(documents, allow)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(_said(F.col("base")), 256).alias("base_sha256"),
        _said(F.sort_array(F.concat("base", "added"))).alias("spans"),
    )


def redact(documents: DataFrame, allow: Sequence[str] = ALLOW, mask: str = "[secret]") -> DataFrame:
    """doc_id and the text with every span replaced by ``mask``; spans that overlap are replaced as one."""
    texts = documents.select(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")).alias("doc_id"), "text")
    found = find_secrets(texts, allow).select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.text").alias("text"), F.sort_array(F.concat("base", "added")).alias("_spans"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] > acc["at"], F.concat(F.expr("''"), acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)))
        first = F.when((s["start"] == 0) & (acc["at"] == 0), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.coalesce(gap, first, acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    return found.select("doc_id", F.aggregate("_spans", start, step, rest).alias("text"))
