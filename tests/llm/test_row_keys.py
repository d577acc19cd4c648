"""Null and repeated ids in the stages of the pipeline."""

import random
from collections import Counter

import corpus_pipeline as p
from tidewatch.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], SCHEMA).repartition(3)


def words(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_one_row_of_each_group_of_near_copies_stays(spark):
    rng = random.Random(1)
    a, b, c, d, e = (words(rng, 60) for _ in range(5))
    rows = [(None, a, "x"), (None, b, "x"), (None, b, "x"), (7, c, "x"), (7, c, "x"), (7, c, "x"), (8, d, "x"), (8, e, "x"), (9, d, "x"), (None, e, "x")]
    got = p.drop_near_copies(spark, documents(spark, rows), "")
    assert got.columns == p.DOCUMENT
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter([(None, a), (None, b), (7, c), (8, d), (8, e)])
    # A row equal in id and text, but not in its source: which stays doesn't depend on the partitions.
    twins = [(4, a, s) for s in "xyz"]
    assert len({p.drop_near_copies(spark, documents(spark, twins).repartition(n, "source"), "").first()["source"] for n in (1, 2, 7)}) == 1


def test_only_rows_with_a_test_item_go(spark, tmp_path):
    rng = random.Random(2)
    item, clean = words(rng, 30), words(rng, 40)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, f"so {item} then", "x"), (None, clean, "x"), (3, item, "x"), (3, clean, "x"), (3, clean, "x")]
    got = p.drop_leaks(spark, documents(spark, rows), str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([(None, clean), (3, clean), (3, clean)])


def test_mixed_rows_keep_the_limit_and_the_targets(spark):
    rng = random.Random(3)
    same, none = words(rng, 30), words(rng, 30)
    rows = [(5, same, "x")] * 6 + [(None, none, "x")] * 4 + [(100 + i, words(rng, rng.randint(5, 40)), "xyz"[i % 3]) for i in range(300)]
    docs = documents(spark, rows)
    got = p.mix(spark, docs, "").collect()
    often = Counter((r["doc_id"], r["text"]) for r in got)
    times = Counter((i, t) for i, t, _ in rows)
    assert all(n <= mixing.MOST * times[k] for k, n in often.items())
    assert often[(None, none)] > 0
    taken = Counter()
    for r in got:
        taken[r["source"]] += len(r["text"].split())
    for r in mixing.mix_sources(docs).select("source", "target").distinct().collect():
        assert abs(taken[r["source"]] - r["target"]) <= 45


def tables(spark, folder, items=((1, "the one test item of this benchmark is a line of words that no other text holds"),), labels=((1, 0, 0), (2, 0, 1))):
    spark.createDataFrame(list(items), "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")


def test_every_stage_of_an_empty_table_is_empty(spark, tmp_path):
    tables(spark, tmp_path)
    docs = documents(spark, [(1, "x", "s")]).limit(0)
    for name, stage in p.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0, name
        assert name == "training_order" or out.columns == p.DOCUMENT


def test_every_stage_takes_nulls_ties_repeats_and_very_long_texts(spark, tmp_path):
    tables(spark, tmp_path)
    rng = random.Random(7)
    long = words(rng, 150_000)
    rows = [(None, None, None), (None, None, None), (3, "", "s"), (3, "", "s"), (4, " \t\n", "s"), (5, long, "s"), (5, long, "s"), (6, long, None), (7, "tie one", "s"), (7, "tie two", "s"), *((10 + i, words(rng, 30), "st"[i % 2]) for i in range(40))]
    docs = spark.createDataFrame([(*r, None if r[0] == 7 else "en", r[0]) for r in rows], "doc_id long, text string, source string, lang string, clash long")
    docs = docs.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as int) as n_chars", "clash as row", "clash as copy", "clash as toxic").repartition(3)
    want = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    for name, stage in p.STAGES[:-1]:
        got = Counter((r["doc_id"], r["text"]) for r in stage(spark, docs, str(tmp_path)).collect())
        assert got.keys() <= want.keys(), name
        if name in ("toxicity", "decontamination"):  # labels of one class reject nothing, and no text holds the item
            assert got == want
        if name == "near_copies":
            assert all(n == 1 for n in got.values()) and sum(t == long for _, t in got) == 1 and sum(not (t or "").split() for _, t in got) == 1
        if name == "mixing":
            assert all(n <= mixing.MOST * want[k] for k, n in got.items()) and not got[(None, None)]
    out = p.order_tokens(spark, docs, str(tmp_path))
    n = out.count()
    assert sorted(r["slot"] for r in out.select("slot").collect()) == list(range(n)) and out.where("seq = 0").count() == len(rows)
