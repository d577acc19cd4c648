import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import scans, threat
from tidewatch.plans import details, lifecycle, texts

SF = "/root/testdata/sf0.001"


def test_passing_over_plain_words_loses_no_candidate(spark, monkeypatch):
    rng = random.Random(3)
    parts = ["a", "example", ".", ".", "..", ":", "::1", "fe80", "10", ".com", "192.168.0.1", "http://", "HTTPS://u@h.example/p", "f" * 31, "0aF" * 11, "d" * 32, "e" * 40, "b" * 64, "@", "-", "_", "/", "+", " ", " ", ",", "(", ")", "[", "]", ";", "\n", "é"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(3000)] + [(3000, None), (3001, "a" * 100_000 + ".com"), (3002, "." * 50_000 + "x.example" + "." * 50_000), (3003, "..." + "c" * 32 + ".")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {tuple(r) for r in threat.candidates(df, "doc_id").collect()}
    few = df.select(F.size(F.regexp_extract_all(F.lit("plain words. End... and more a_b c/d"), F.lit(threat.RUN), F.lit(1))).alias("n")).first()["n"]
    monkeypatch.setattr(threat, "RUN", "([A-Za-z0-9:@._/%?=&+-]+)")
    assert got == {tuple(r) for r in threat.candidates(df, "doc_id").collect()} and {t for _, t, _ in got} >= {"URL", "DOMAIN", "IPV4", "IPV6", "MD5", "SHA1", "SHA256"}
    assert few == 0 and (3002, "DOMAIN", "x.example") in got and (3003, "MD5", "c" * 32) in got


@pytest.mark.parametrize("query", [lifecycle.thr_backfill, details.thr_asset_matches, texts.thr_shared_hashes])
def test_texts_are_read_once(spark, query):
    """What comes after the candidates reads these, not the texts again."""
    plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "text:string" not in plan  # as in the columns that a scan reads


@pytest.mark.parametrize("n", [0, 1, 7, 500, 1000, 5000])
def test_first_rows_in_ranges(spark, monkeypatch, n):
    monkeypatch.setattr(scans, "FEW", 5)
    rows = spark.range(1000).select("id", (F.col("id") % 13).alias("t")).repartition(7)
    order = [F.desc("t"), F.asc("id")]
    out = scans.first_rows(rows, order, n)
    assert out.columns == ["id", "t"] and sorted(map(tuple, out.collect())) == sorted(map(tuple, rows.orderBy(*order).limit(n).collect()))
    assert n <= 5 or "Limit" not in str(out._jdf.queryExecution().optimizedPlan())
