"""Savings from one base aggregate."""
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from moneta import params as P
from moneta.operators import savings


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    cats = [*P.REDUCIBLE_CATEGORIES, "salário", "outros", None]
    out = []
    for i in range(4000):
        user = 1 if i % 3 == 0 else rng.randrange(2, 20)  # one user has a third of all rows
        out.append((i, user, rng.choice(cats), rng.choice(["m%d" % rng.randrange(12), None]), rng.randrange(1, 9000) / 100 if i % 50 else None, rng.randrange(24)))
    return out


def _tx(spark, rows):
    df = spark.createDataFrame(rows, "id long, user_id long, category string, merchant string, amount double, h int")
    return df.withColumn("timestamp", F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(5), F.col("h"), F.lit(0), F.lit(0))).drop("h")


def _plain(rows):
    """All suggestions of each user, best first."""
    found = {}
    for user in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == user]
        total = sum(r[4] or 0 for r in own)
        by_cat, by_mer, n_mer = defaultdict(float), defaultdict(float), Counter()
        for _, _, c, m, a, _ in own:
            by_cat[c] += a or 0
            if m is not None:
                by_mer[m] += a or 0
                n_mer[m] += 1
        out = [("category_reduction", c, by_cat[c], by_cat[c] * 0.3, "alta" if by_cat[c] * 0.3 > total * 0.02 else "média", 0, i)
               for i, c in enumerate(P.REDUCIBLE_CATEGORIES) if c in by_cat]
        top = sorted((m for m in by_mer if n_mer[m] >= 3), key=lambda m: (-round(by_mer[m], 6), m))[:5]
        out += [("recurring_expense", m, by_mer[m], by_mer[m] * 0.2, "média", 1, i) for i, m in enumerate(top, 1)]
        night = sum(r[4] or 0 for r in own if r[5] <= 6)
        if night > total * 0.1:
            out.append(("behavioral", "gastos_noturnos", night, night * 0.5, "alta", 2, 0))
        found[user] = sorted(out, key=lambda x: (-round(x[3], 2), x[5], x[6])), total
    return found


def test_against_plain_python(spark, rows):
    tx = _tx(spark, rows)
    want = _plain(rows)
    got = defaultdict(list)
    for r in savings.savings_suggestions(tx).orderBy("user_id", "rank").collect():
        got[r["user_id"]].append((r["type"], r["name"], r["priority"], r["current_spending"], r["potential_savings"]))
        assert r["rank"] == len(got[r["user_id"]]) and r["suggestion"]
    for user, (out, _) in want.items():
        assert [(x[0], x[1], x[4]) for x in out[:10]] == [x[:3] for x in got[user]]
        for x, g in zip(out, got[user]):
            assert g[3] == pytest.approx(x[2], abs=0.0051) and g[4] == pytest.approx(x[3], abs=0.0051)
    for r in savings.savings_totals(tx).collect():
        out, total = want[r["user_id"]]
        assert r["total_potential_savings"] == pytest.approx(sum(x[3] for x in out), abs=0.1)
        assert r["target_savings"] == pytest.approx(total * 0.1, abs=0.0051)
        assert r["achievable"] == (r["total_potential_savings"] >= r["target_savings"])


def test_one_scan(spark, rows, tmp_path):
    _tx(spark, rows).write.parquet(str(tmp_path / "tx"))
    tx = spark.read.parquet(str(tmp_path / "tx"))
    for df in (savings.savings_suggestions(tx), savings.savings_totals(tx)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall("FileScan parquet", plan)) == 1


def test_missing_columns_and_one_batch(spark, rows):
    tx = _tx(spark, rows)
    only = savings.savings_suggestions(tx.select("user_id", "amount", "category"))
    assert {r["type"] for r in only.select("type").distinct().collect()} == {"category_reduction"}
    batch = savings.savings_totals(tx, keys=()).collect()
    assert len(batch) == 1 and batch[0]["target_savings"] == pytest.approx(sum(r[4] or 0 for r in rows) * 0.1, abs=0.0051)
    assert savings.savings_suggestions(tx.limit(0)).count() == 0
