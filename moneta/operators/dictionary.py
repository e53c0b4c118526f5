"""Category suggestions from a dictionary that is a table: a trigram index with verification.

A text is matched by every keyword that it contains or that contains it.  Comparing each
text with each keyword would be a join on a condition, rows times keywords.  Instead
the contained string must bring all its trigrams along (strings of one or two characters:
themselves), so one of them is enough to find every candidate by an equi-join; it
is the one that the fewest strings of the other side have.  Candidates are then
verified on the whole strings.

Counts come before the join, map-side; the rarest gram keeps the common ones (a gram that a third
of all texts has) out of the join wherever a string has another.  Where it hasn't, AQE splits the
join's skewed side: both sides are written, so no aggregate stands in its stage.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moneta.functions.common import spread
from moneta.session import checkpoint_dir

GRAM = 3


def _written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/moneta-files/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def grams(text: Column, sizes: list[int]) -> Column:
    """The different substrings of the given sizes, put together from single characters."""
    chars = F.split(text, "")

    def of(n: int) -> Column:
        out = chars
        for k in range(1, n):  # the shorter side of a pair ends the list
            out = F.zip_with(out, F.slice(chars, k + 1, F.greatest(F.size(chars) - k, F.lit(0))), lambda a, c: F.concat(a, c))
        return F.filter(out, lambda g: g.isNotNull() & (g != ""))

    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


def own_grams(text: Column) -> Column:
    """The grams that any string containing ``text`` has: its trigrams, or itself if it is shorter."""
    return F.when(F.char_length(text) < GRAM, F.array(text)).otherwise(grams(text, [GRAM]))


def _gram_sizes(strings: DataFrame) -> list[int]:
    """Which sizes of grams the strings are looked up by: of 1, 2 and 3."""
    return sorted(r["n"] for r in strings.select(F.least(F.char_length("s"), F.lit(GRAM)).alias("n")).distinct().collect())


def containing(small: DataFrame, large: DataFrame) -> DataFrame:
    """(small_id, large_id) of all pairs where ``small.s`` (not empty) is a substring of ``large.s``.
    Both have an id and a string ``s``; ids are unique."""
    small, large = small.where("s <> ''"), large.where("s <> ''")
    sizes = _gram_sizes(small)
    parts = _written(small.select("id", F.explode(own_grams(F.col("s"))).alias("gram")), "small-grams")
    used = parts.select("gram").distinct()
    inside = spread(large).select("id", F.explode(grams(F.col("s"), sizes or [GRAM])).alias("gram")).join(used, "gram", "left_semi")
    inside = _written(inside, "large-grams")
    often = inside.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a string one of whose grams nobody has is contained nowhere
    key = (parts.join(often, "gram", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("k"))
           .where("k.n > 0").select(F.col("id").alias("small_id"), F.col("k.gram").alias("gram")))
    pairs = inside.join(_written(key, "keys"), "gram").select("small_id", F.col("id").alias("large_id"))
    pairs = pairs.join(small.select(F.col("id").alias("small_id"), F.col("s").alias("_small")), "small_id")
    pairs = pairs.join(large.select(F.col("id").alias("large_id"), F.col("s").alias("_large")), "large_id")
    return pairs.where(F.contains("_large", F.col("_small"))).select("small_id", "large_id")


def suggest_from_dictionary(df: DataFrame, dictionary: DataFrame, text: str = "text", limit: int = 5) -> DataFrame:
    """``df`` plus ``suggestions``: categories with a keyword that contains the lower-cased text or is
    contained in it, in the order of ``place``, the first ``limit``; none -> [outros].

    ``dictionary``: (category, place, keyword), any number of rows; a category's place is its smallest.  The
    empty text is contained in every keyword; a null text has no match; null keywords are left out.
    Equal texts are matched once."""
    spark = df.sparkSession
    words = dictionary.where("keyword is not null and category is not null")
    order = words.groupBy("category").agg(F.min("place").alias("place"))
    words = words.select("category", F.col("keyword").alias("s")).distinct()
    keywords = _written(words.select("s").where("s <> ''").distinct().withColumn("id", F.monotonically_increasing_id()), "keywords")
    texts = _written(df.select(F.lower(F.col(text)).alias("s")).where("s is not null").distinct().withColumn(
        "id", F.monotonically_increasing_id()), "texts")
    longest = keywords.agg(F.max(F.char_length("s")).alias("n")).first()["n"] or 0
    held = containing(keywords, texts).select(F.col("small_id").alias("word"), F.col("large_id").alias("id"))
    short = texts.where(F.char_length("s") <= longest)  # a longer text is in no keyword
    within = containing(short, keywords).select(F.col("large_id").alias("word"), F.col("small_id").alias("id"))
    hits = held.unionByName(within).join(keywords.select(F.col("id").alias("word"), "s"), "word").join(words, "s").join(order, "category")
    found = hits.groupBy("id").agg(F.collect_set(F.struct("place", "category")).alias("found"))  # a row for each category at most
    first = [r["category"] for r in order.orderBy("place", "category").limit(limit).collect()]
    said = texts.join(found, "id", "left").select("s", F.when(F.col("s") == "", F.array(*map(F.lit, first)).cast("array<string>")).otherwise(
        F.slice(F.transform(F.sort_array("found"), lambda x: x["category"]), 1, limit)).alias("suggestions"))
    key = f"_s_{uuid.uuid4().hex[:8]}"
    out = df.join(said.withColumnRenamed("s", key), F.lower(F.col(text)) == F.col(key), "left").drop(key)
    others = F.array(F.lit("outros"))
    return out.withColumn("suggestions", F.when(F.size(F.coalesce("suggestions", F.array().cast("array<string>"))) > 0, F.col("suggestions")).otherwise(others))
