"""Secret scans: corpus-wide ownership frequency of candidate values.

Spans are found with regular expressions over whole texts, as code-point offsets:
the pieces between the matches (``split``) and the matches themselves
(``regexp_extract_all``) alternate, so a running sum of their lengths gives every
start.  Then each candidate value is hashed and its hash is counted over the
corpus by distinct repositories (here: documents) and distinct owners (here:
sources).  A value that ``min_owners`` owners have is a widely copied example;
one with fewer owners is owner-specific and may be live.

Base kinds are always reported.  The method adds spans of kind ``live``: long
tokens with digits, capitals and small letters, outside base spans, whose value
is owner-specific.

Built-in expressions only.  Values are reduced to distinct (value, owner,
document) rows before they are counted, map-side first, so an example key that a
third of all documents hold is no hot group.  Places and overlaps come from running sums and
maxima over the matches of one text, so a text with very many of them takes linear time.

Defined results: null or empty text has no spans; null doc_id is kept, and its
row counts as a repository of its own owner; a null owner is an owner; identical
rows count as one repository; an empty table gives an empty result; only the
columns named in the arguments are read, so other columns cannot clash.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moneta.llm.common import written

# --- FIXED VALUES: kinds, in the order of the output, with their expressions ---
KINDS = ("assign", "access", "hex", "live")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{16,})"
TOKEN = r"([A-Za-z0-9+/_=-]{20,})"


def matches_of(text: Column, pattern: str, kind: int, ok) -> Column:
    """array<struct<kind,pos,gap,size,value,ok>>: the leftmost non-overlapping matches in order, with the
    number of code points before each (since the last one) and in it; value is the expression's only group."""
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    found = F.arrays_zip(whole.alias("m"), value.alias("v"), F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("p"))
    each = F.transform(found, lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("pos"), F.char_length(x["p"]).alias("gap"), F.char_length(x["m"]).alias("size"),
        x["v"].alias("value"), ok(x["m"], x["v"]).alias("ok")))
    return F.when(F.coalesce(F.regexp_like(text, F.lit(pattern)), F.lit(False)), each)


def find_spans(docs: DataFrame) -> DataFrame:
    """(repo, owner, row, start, kind, end, value) of the accepted matches in ``docs`` (repo, owner, row, text).
    A match starts where the gaps and matches before it end: one running sum over a text's matches of a kind."""
    long_enough = {
        "assign": lambda m, v: F.char_length(v) >= 12,
        "access": lambda m, v: F.char_length(m) >= 18,
        "hex": lambda m, v: F.lit(True),
        "live": lambda m, v: v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]"),
    }
    none = F.array().cast("array<struct<kind:int,pos:int,gap:int,size:int,value:string,ok:boolean>>")
    each = F.concat(*[F.coalesce(matches_of(F.col("text"), p, k, long_enough[KINDS[k]]), none) for k, p in enumerate((ASSIGN, ACCESS, HEX, TOKEN))])
    who = ["repo", "owner", "row"]
    rows = docs.select(*who, F.explode(each).alias("x")).select(*who, "x.*").dropDuplicates([*who, "kind", "pos"])
    before = Window.partitionBy(*who, "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before).cast("int")).where("ok")
    return rows.select(*who, (F.col("end") - F.col("size")).alias("start"), "kind", "end", "value")


def scan_secrets(docs: DataFrame, repo: str = "doc_id", owner: str = "source", min_owners: int = 3) -> DataFrame:
    """One row per row of ``docs``: repo, spans (array of start, kind, end, n_repos, n_owners, example),
    sorted by start and kind; ``live`` candidates stay only if they are outside base spans
    and their value has fewer than ``min_owners`` owners."""
    rows = docs.select(F.col(repo).alias("repo"), F.col(owner).alias("owner"), F.xxhash64("text").alias("row"), "text")
    one = find_spans(rows).select("repo", "owner", "row", "start", "kind", "end",
                                  F.xxhash64("value").alias("v1"), F.xxhash64(F.lit(1), "value").alias("v2"))
    one = written(one, "spans")
    held = one.groupBy("v1", "v2", "owner", "repo").agg(F.lit(1).alias("x"))
    held = held.groupBy("v1", "v2", "owner").agg(F.count("*").alias("n"))
    owners = held.groupBy("v1", "v2").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"))
    owners = written(owners.withColumn("example", F.col("n_owners") >= min_owners), "owners")
    each = one.join(owners, ["v1", "v2"])
    # a live span is inside a base span if one that starts before its end goes on beyond its start
    base = F.col("kind") != KINDS.index("live")
    upto = Window.partitionBy("repo", "row").orderBy(F.when(base, F.col("start")).otherwise(F.col("end")), base).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("inside", F.coalesce(F.max(F.when(base, F.col("end"))).over(upto) > F.col("start"), F.lit(False)))
    known = each.where(base | (~F.col("example") & ~F.col("inside"))).groupBy("repo", "row").agg(F.array_sort(F.collect_set(F.struct(
        "start", "kind", "end", "n_repos", "n_owners", "example"))).alias("spans"))
    known = known.select(F.col("repo").alias("_r"), F.col("row").alias("_w"), F.col("spans").alias("_s"))
    rows = rows.drop("text")
    out = rows.join(known, rows["repo"].eqNullSafe(F.col("_r")) & (rows["row"] == F.col("_w")), "left")
    empty = F.array().cast(known.schema["_s"].dataType)
    return out.select(F.col("repo").alias(repo), F.coalesce("_s", empty).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
