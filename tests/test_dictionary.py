"""The trigram index against comparing everything, and its plan."""
import random

import pytest
from pyspark.sql import functions as F

from moneta.operators import dictionary as dic


def _pairs(spark, small, large):
    df = lambda rows: spark.createDataFrame(list(enumerate(rows)), "id long, s string")
    return sorted(map(tuple, dic.containing(df(small), df(large)).collect()))


def test_containing_equals_all_pairs(spark):
    rng = random.Random(4)
    make = lambda n: "".join(rng.choices("abcé \U0001f600", k=n))  # noqa: E731  a character outside the basic plane too
    small = [make(rng.randint(0, 6)) for _ in range(80)] + ["a", "ab", "zzz", "%", "\\"]
    large = [make(rng.randint(0, 60)) for _ in range(120)] + ["zz", "", "a%b", "x\\y"]
    assert _pairs(spark, small, large) == sorted((i, j) for i, a in enumerate(small) for j, b in enumerate(large) if a and b and a in b)


def _plain(texts, words, limit=5):
    order = {}
    for c, p, _ in words:
        order[c] = min(order.get(c, p), p)
    out = []
    for t in texts:
        t = None if t is None else t.lower()
        hit = {c for c, _, k in words if t is not None and k is not None and (t in k or k in t)}
        out.append(",".join(sorted(hit, key=lambda c: (order[c], c))[:limit]) or "outros")
    return out


def test_suggestions_equal_plain(spark):
    rng = random.Random(9)
    words = [(f"cat{i % 9}", i % 9, "".join(rng.choices("abcd ", k=rng.randint(1, 7)))) for i in range(150)] + [("cat1", 1, None), ("late", 99, "qqqqq")]
    texts = ["".join(rng.choices("abcdeQ ", k=rng.randint(0, 40))) for _ in range(200)] + [None, "", "QQ", "qqqqqq", "abc" * 5000]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "n long, text string, s string, id int")
    d = spark.createDataFrame(words, "category string, place int, keyword string")
    out = dic.suggest_from_dictionary(df, d).orderBy("n")
    assert [",".join(r["suggestions"]) for r in out.collect()] == _plain(texts, words)
    assert set(df.columns) <= set(out.columns)
    assert dic.suggest_from_dictionary(df.limit(0), d).count() == 0
    assert {tuple(r["suggestions"]) for r in dic.suggest_from_dictionary(df, d.limit(0)).collect()} == {("outros",)}


def test_a_large_dictionary_without_comparing_all(spark):
    """100,000 keywords: every join is on a key."""
    words = spark.range(100_000).select(F.concat(F.lit("cat"), F.col("id") % 50).alias("category"), (F.col("id") % 50).cast("int").alias("place"),
                                        F.concat(F.lit("w"), F.conv((F.col("id") * 7919).cast("string"), 10, 36)).alias("keyword"))
    texts = spark.range(300).select("id", F.concat(F.lit("pay to w"), F.conv((F.col("id") * 7919 * 300).cast("string"), 10, 36), F.lit(" now")).alias("text"))
    out = dic.suggest_from_dictionary(texts.withColumn("text", F.lower("text")), words.withColumn("keyword", F.lower("keyword")))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert len(rows) == 300 and all(r["suggestions"] != ["outros"] for r in rows)
    one = next(r for r in rows if r["id"] == 7)
    assert f"cat{7 * 300 % 50}" in one["suggestions"]
