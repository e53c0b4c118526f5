"""That results come through the methods: plans and levels of line dedup, substring dedup, decontamination."""
from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F


def test_runs_are_merged_without_shuffle_or_sort(spark):
    from moneta.llm.line_dedup import LineRuns, long_lines
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(
        F.repeat(F.lit("x"), 50), (F.col("id") % 90).cast("string"), F.lit("\n"), F.repeat(F.lit("y"), 50), (F.col("id") % 7).cast("string")).alias("text"))
    lines = long_lines(docs, 40)
    runs = LineRuns(spark, fanout=3)
    for b in range(2):
        runs.add(lines.where(F.col("doc_id") % 3 == b))
    first, second = runs.levels[0]
    before = spark.conf.get(runs.ORDERED)
    spark.conf.set(runs.ORDERED, "true")
    try:
        merge = runs.merge_plan(first, second)._jdf.queryExecution().executedPlan().toString()
        batch = lines.where(F.col("doc_id") % 3 == 2).groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        anti = runs.marked(batch)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(runs.ORDERED, before)
    assert "SortMergeJoin" in merge and "Exchange" not in merge and not re.search(r"\bSort \[", merge)
    assert anti.count("SortMergeJoin") == 2
    for side in anti.split("Bucketed: true")[:-1]:  # what stands above each run, up to its join
        own = side[side.rindex("SortMergeJoin") if "SortMergeJoin" in side.rsplit("+- ", 2)[-2] else side.rindex("+- "):]
        assert "Exchange" not in own and "Sort [" not in own
    runs.add(lines.where(F.col("doc_id") % 3 == 2))  # three runs: one of the next level
    assert [len(x) for x in runs.levels] == [0, 1]
    total = {(r["h1"], r["h2"]): (r["n_docs"], r["last_doc"]) for r in runs.totals().collect()}
    want = lines.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("m")).collect()
    assert total == {(r["h1"], r["h2"]): (r["n"], r["m"]) for r in want}
    runs.drop()
    assert not runs.paths


def plain_substrings(docs, length):
    words = [(i, t.split(" ")) for i, t in docs]
    first: dict[tuple, int] = {}
    for i, w in words:
        for p in range(len(w) - length + 1):
            key = tuple(w[p:p + length])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - length + 1):
            if first[tuple(w[p:p + length])] < i:
                gone.update(range(p, p + length))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length", [14, 20, 50, 60])
def test_every_level_of_substring_dedup(spark, length):
    from moneta.llm.substring import dedup_substrings, levels
    assert levels(50) == [13, 25, 50] and levels(60) == [8, 15, 30, 60] and levels(14) == [7, 14]
    assert all(b <= 2 * a for n in range(14, 200) for a, b in zip(levels(n), levels(n)[1:]))
    rng = random.Random(length)
    noise = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    hot = noise(2 * length)
    docs = [(i, " ".join(noise(rng.randrange(5, 2 * length)) + hot[rng.randrange(3):] + noise(rng.randrange(40)))) for i in range(40)]
    shared = [noise(n) for n in (12, 13, 20, 25, 30, length - 1, length)]  # repeats that die at each level
    docs += [(100 + 10 * k + j, " ".join(noise(60) + s + noise(60))) for k, s in enumerate(shared) for j in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [tuple(r) for r in dedup_substrings(df, length).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got) == plain_substrings(docs, length)
    none = spark.createDataFrame([(i, " ".join(f"u{i}x{k}" for k in range(90))) for i in range(5)], "doc_id long, text string")
    assert {r["n_removed"] for r in dedup_substrings(none, length).collect()} == {0}  # the loop ends at the first level


def test_a_short_item_leaves_the_winnowing_of_long_ones(spark):
    from moneta.llm import decontam
    seen = {}
    real = decontam.written

    def spy(df, name):
        seen[name] = real(df, name)
        return seen[name]
    long_ = " ".join(f"t{i}" for i in range(30))
    items = spark.createDataFrame([(1, long_), (2, "zebra"), (3, None), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"t{i % 30} other words here") for i in range(100)] + [(200, "a " + long_ + " b"), (201, "one zebra two")],
                                 "doc_id long, text string")
    decontam.written = spy
    try:
        out = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontam.decontaminate(docs, items).collect()}
    finally:
        decontam.written = real
    assert seen["prints"].count() < 15  # the long item's minima and the short item; its 30 words aren't among them
    assert out[200] == (30, ["1"]) and out[201] == (1, ["2"]) and all(out[i] == (0, []) for i in range(100))


def test_a_text_with_very_many_matches(spark):
    """100,000 matches in one text: places come from one running sum."""
    from moneta.llm.secret_scan import scan_secrets
    n = 100_000
    text = " ".join(f"{i:016x}" for i in range(n)) + " Aa0Aa0Aa0Aa0Aa0Aa0Aa0"
    df = spark.createDataFrame([(1, text, "s"), (1, text, "s"), (2, "x " + f"{5:016x}", "t")], "doc_id long, text string, source string")
    out = scan_secrets(df).select("doc_id", F.size("spans").alias("n"), F.col("spans")[0]["start"].alias("a"),
                                  F.element_at("spans", -1)["end"].alias("z")).collect()
    assert sorted((r["doc_id"], r["n"], r["a"], r["z"]) for r in out) == [(1, n + 1, 0, len(text))] * 2 + [(2, 1, 2, 18)]


def test_live_spans_beside_and_inside_base_spans(spark):
    from moneta.llm.secret_scan import scan_secrets
    inside = 'token = "Zx9abcdefghIJKL0123Q"'
    text = f'{inside} Yy8abcdefghIJKL0123Q é {inside}'
    df = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    spans = scan_secrets(df).first()["spans"]
    assert [(s["kind"], s["start"], s["end"]) for s in spans] == [
        (0, 0, len(inside) - 1), (3, len(inside) + 1, len(inside) + 21), (0, len(text) - len(inside), len(text) - 1)]
