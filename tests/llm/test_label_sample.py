"""Labels that few learning rows have are learned all the same."""
from __future__ import annotations

import random

from pyspark.sql import functions as F


def test_rows_of_every_label(spark):
    from moneta.llm.common import label_sample
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 77, "one").when(
        F.col("id") % 1000 == 5, "few").when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("lang"))
    rows, counts = label_sample(df, 200, "lang", "doc_id")
    got = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    assert got == {"one": 1, "few": 20, "even": 90, "odd": 89}
    assert counts == {"one": 1, "few": 20, "even": 10_000, "odd": 9979}
    same = df.withColumn("doc_id", F.lit(3))  # one hash for all rows
    rows, _ = label_sample(same, 200, "lang", "doc_id")
    assert {r["lang"] for r in rows.select("lang").distinct().collect()} == set(got)
    rows, counts = label_sample(df.limit(0), 200, "lang", "doc_id")
    assert rows.count() == 0 and counts == {}


def test_a_rare_language_is_predicted(spark):
    from moneta.llm.langid import identify
    rng = random.Random(4)
    words = {"aa": "alpha bravo candle dorado ember".split(), "bb": "zulu yonder xylo wovik vurtz".split(),
             "cc": "quoth qibla qanat qormi qupso".split()}
    rows = [(i, " ".join(rng.choices(words[lang], k=12)), lang) for i in range(6000)
            for lang in ["cc" if i % 600 == 9 else "aa" if i % 2 else "bb"]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = identify(df, sample=60).where("lang = 'cc'").select("lang_pred").collect()
    assert len(out) == 10 and all(r["lang_pred"] == "cc" for r in out)


def test_rare_toxic_texts_are_learned(spark):
    from moneta.llm.toxicity import score_toxicity
    rng = random.Random(5)
    plain = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(8000):
        t = rng.choices(plain, k=15)
        rows.append((i, " ".join([*t, "you", "are", "a", "grobnik"] if i % 200 == 7 else t), int(i % 200 == 7)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = score_toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic"), sample=200).select("doc_id", "predicted").collect()
    assert {r["doc_id"] for r in out if r["predicted"]} == {r[0] for r in rows if r[2]}
