"""Sketches, source divergence, collocations and the quality classifier against plain versions of themselves."""

import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from plain import documents
from pyspark.sql import functions as F

from allometra.llm import quality_model, sketch
from allometra.llm.collocations import collocations
from allometra.llm.divergence import audit

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, total string, term string, p string, rank int"


def corpus(spark, rows):
    """Documents from (text, lang, source), with columns of clashing names."""
    return spark.createDataFrame([(k, t, lang, source, len(t or ""), "x", "y", "z", 1) for k, (t, lang, source) in enumerate(rows)], SCHEMA)


def random_rows(rng, n=120):
    words = ["alpha", "Beta", "gamma", "ÉTÉ", "été", "naïve", "x", "日本", "delta", "eps", "zeta", "Z9q", "it's"]
    rows = []
    for _ in range(n):
        text = "".join(str(rng.choice(words, p=np.arange(13, 0, -1) / 91)) + str(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "-", "7", "\x0b"])) for _ in range(rng.integers(0, 40)))
        rows.append((text, str(rng.choice(["en", "fr", ""])), str(rng.choice(["a", "b", "c", "é", ""]))))
    return [*rows, (None, "en", "a"), ("alpha beta", None, None), ("alpha beta", None, "a"), ("", "de", "only"), *rows[:7], (" alpha beta" * 60, "en", "a")]


def plain_audit(rows, least=3, top=200):
    lower = [("" if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t), lang or "", source or "") for t, lang, source in rows]
    terms = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t), lang, source) for t, lang, source in lower]
    in_docs, counts, of_lang, groups = Counter(), defaultdict(Counter), defaultdict(Counter), sorted({x[1:] for x in terms})
    for words, lang, source in terms:
        in_docs.update((lang, w) for w in set(words))
        counts[lang, source].update(words)
        of_lang[lang].update(words)
    out = []
    for lang, source in groups:
        kept = [w for (k, w), n in in_docs.items() if k == lang and n >= least]

        def rates(found):
            total = sum(found[w] for w in kept) + len(kept)
            return {w: 1 + 1000000000 * (found[w] + 1) // total for w in kept}

        p, whole, found = rates(counts[lang, source]), rates(of_lang[lang]), []
        others = [(sum((p[w] - q[w]) ** 2 // q[w] for w in kept), other) for k, other in groups if k == lang and other != source for q in [rates(counts[lang, other])]]
        found.append(("pair", others, len(others)))
        found.append(("term", [((p[w] - whole[w]) ** 2 // whole[w], w) for w in kept if counts[lang, source][w] and p[w] > whole[w]], top))
        for part, values, limit in found:
            for rank, (value, item) in enumerate(sorted(values, key=lambda v: (-v[0], v[1].encode()))[:limit], 1):
                out.append((lang, source, part, item, value, rank))
    return out


def test_audit_against_a_plain_version(spark):
    rows = random_rows(np.random.default_rng(31))
    found = {tuple(r) for r in audit(corpus(spark, rows), top=4).collect()}
    assert found == set(plain_audit(rows, top=4)) and len(found) > 60


def test_audit_of_few_rows(spark):
    assert audit(corpus(spark, []).limit(0)).isEmpty()
    assert audit(corpus(spark, [(None, None, None)])).isEmpty()
    rows = [("rare", "en", "a"), (None, "en", "b"), ("other", "fr", "a")]
    assert sorted(tuple(r) for r in audit(corpus(spark, rows)).collect()) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def plain_collocations(rows, least, share, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts[lang].update(tuple(words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    out = []
    for lang, found in counts.items():
        candidates, scored = {p: a for p, a in found.items() if a >= least and len(p) > 1}, []
        for p, a in candidates.items():
            inside = any(100 * b >= share * a and len(o) > len(p) and any(o[i : i + len(p)] == p for i in range(len(o))) for o, b in candidates.items())
            if not inside:
                cuts = [(1000 * a * totals[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return out


def test_collocations_against_a_plain_version(spark):
    rows = random_rows(np.random.default_rng(32))
    for least, share, top in ((3, 100, 2000), (2, 70, 9)):
        found = {tuple(r) for r in collocations(corpus(spark, rows).repartition(5), least, share, top).collect()}
        assert found == set(plain_collocations(rows, least, share, top)) and len(found) > 20


def test_collocations_of_few_rows_and_a_long_text(spark):
    assert collocations(corpus(spark, []).limit(0)).isEmpty()
    assert collocations(corpus(spark, [(None, None, None), ("", "en", "a"), (". , !", "en", "a")])).isEmpty()
    long = "one two three four five six " * 200_000  # over one stretch
    rows = [(long, None, "a"), ("one two", "en", "b")]
    assert {tuple(r) for r in collocations(corpus(spark, rows)).collect()} == set(plain_collocations(rows, 100, 100, 2000))


def test_runs_with_a_rare_part_are_not_counted_in_a_crowded_sketch(spark, monkeypatch):
    from allometra.llm import collocations as c

    for name in ("WIDTH", "LEAST_WIDTH"):
        monkeypatch.setattr(c, name, 1 << 16, raising=False)
    words = np.random.default_rng(35).integers(0, 1000, (400, 500))  # each word some 200 times, hardly a pair 10 times, some 15 runs for each cell
    rows = [(" ".join(f"w{w}" for w in text), "en", "a") for text in words] + [("w1 w2 w3 " * 20, "en", "a")]
    counted = []
    added = c._added
    monkeypatch.setattr(c, "_added", lambda packed: counted.append(packed.agg(F.sum(F.size("a"))).first()[0]) or added(packed))
    found = {tuple(r) for r in collocations(corpus(spark, rows), 10, 100, 2000).collect()}
    assert found == set(plain_collocations(rows, 10, 100, 2000)) and len(found) > 2
    assert counted[0] < 20_000  # of some 1,000,000 runs


def test_same_rows_as_sql(spark, sf_dir):
    from compare import same_rows

    from allometra.llm import queries as q

    for name in ("op11_source_divergence", "op13_phrase_collocations"):
        same_rows(spark, sf_dir, q.QUERIES[name], q.ORACLES[name])


def test_sketches_never_underestimate():
    rng = np.random.default_rng(33)
    keys = rng.integers(0, 2**63, 4000).astype(np.uint64)
    counts = rng.integers(1, 9, len(keys))
    for width, discards in ((1 << 10, 0), (1 << 16, 0.9)):
        parts = [sketch.Cells(width, 5) for _ in range(3)]
        for k, chunk in enumerate(np.array_split(rng.permutation(np.repeat(keys, counts)), 7)):
            parts[k % 3].add(chunk)
        total = np.minimum(sum(p.cells.astype(int) for p in parts), 5)
        may = sketch.Survivors(width, np.packbits(total.reshape(-1) >= 5)).may(keys)
        assert may[counts >= 5].all() and (~may[counts < 5]).mean() >= discards


def test_merged_blocks_are_those_of_all_tasks(spark):
    keys = np.arange(3000, dtype=np.uint64)

    def run(batches):
        cells = sketch.Cells(sketch.BLOCK * 2, 3)
        for batch in batches:
            cells.add(batch.column(0).to_numpy().astype(np.uint64))
        yield from cells.batches()

    rows = spark.range(3000).select(F.explode(F.array_repeat("id", (F.col("id") % 4 + 1).cast("int"))).alias("id")).repartition(6)
    may = sketch.merge(rows.mapInArrow(run, "block int, cells binary"), sketch.BLOCK * 2, 3).may(keys)
    assert may[keys % 4 >= 2].all() and (~may[keys % 4 < 2]).mean() > 0.99


def test_machine_sums_all_pairs():
    rng = np.random.default_rng(34)
    machine = quality_model.Machine(0.3, rng.normal(size=quality_model.FEATURES), rng.normal(size=(quality_model.FEATURES, quality_model.FACTORS)))
    features = quality_model.Features([b"One two two THREE!!\nx | y", b"", "é è é".encode()], [24, None, 5])
    logits, _ = machine.logits(features.at, features.x, features.begins)
    ends = [*features.begins[1:], len(features.at)]
    for k, (begin, end) in enumerate(zip(features.begins, ends)):
        at, x = features.at[begin:end], features.x[begin:end]
        pairs = sum(machine.vectors[at[i]] @ machine.vectors[at[j]] * x[i] * x[j] for i, j in combinations(range(len(at)), 2))
        assert abs(logits[k] - (0.3 + machine.weights[at] @ x + pairs)) < 1e-4


def test_quality_of_held_out_documents(spark):
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    machine = quality_model.fit(docs, labels)
    assert np.array_equal(machine.vectors, quality_model.fit(docs.repartition(3), labels).vectors)
    found = quality_model.score_documents(docs, machine).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = found[found.quality == 1], found[found.quality == 0]
    assert (good.score.to_numpy()[:, None] > bad.score.to_numpy()).mean() > 0.98 and good.predicted.mean() > 0.97 and bad.predicted.mean() < 0.3


def test_quality_of_odd_rows(spark):
    docs = documents(spark, ["Plain words of a text.", None, "", " \n\t ", "x" * 5_000_000, "ab " * 2_000_000])
    machine = quality_model.train(["Good words here."] * 5 + ["BAD!! BAD!! BAD!!"] * 5, [1] * 5 + [0] * 5)
    rows = quality_model.score_documents(docs.union(docs).withColumn("score", F.lit("x")), machine).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert quality_model.score_documents(docs.limit(0), machine).isEmpty()
    assert quality_model.score_documents(docs.drop("n_chars"), machine).count() == 6
    empty = quality_model.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality_model.score_documents(docs, empty).collect()} == {0.5}
    assert {r.predicted for r in quality_model.score_documents(docs, quality_model.train(["a"], [0])).collect()} == {0}
    assert quality_model.score_documents(docs.withColumn("doc_id", F.lit(None).cast("long")), machine).where("held_out").isEmpty()
