"""The pipeline's stages take effect, on whole inputs; SQL twins at the small size."""
from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from conftest import SF_SMALL  # noqa: E402


def test_stages(spark):
    import corpus_pipeline as C
    from moneta.llm.common import read, written
    from moneta.llm.decontam import decontaminate
    from moneta.llm.line_dedup import dedup_lines
    from moneta.llm.minhash import near_duplicates
    docs = read(spark, SF_SMALL, "documents")
    assert [k for k, _ in C.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    kept = {}
    for name, stage in C.STAGES:
        before, docs = docs, written(stage(spark, docs, SF_SMALL), name)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == before.columns
    ids = {k: {r["doc_id"] for r in d.select("doc_id").collect()} for k, d in kept.items()}
    assert ids["toxicity"] == ids["line_dedup"] > ids["near_dedup"] >= ids["decontamination"] == ids["packing"]
    assert dedup_lines(kept["line_dedup"]).where("n_dropped > 0").count() == 0
    assert near_duplicates(kept["near_dedup"]).where("not kept").count() == 0
    assert decontaminate(kept["decontamination"], read(spark, SF_SMALL, "benchmark")).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("key", ["op1_line_dedup", "op3_secret_scan", "op4_decontam", "op7_embedding", "op9_minhash", "op10_substring"])
def test_sql_twin(spark, key):
    from moneta.llm.oracle import SQL
    from moneta.llm.queries import QUERIES
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    want = con.execute(SQL[key])
    names = [d[0] for d in want.description]
    got = QUERIES[key](spark, SF_SMALL)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)
