import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    x = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[i : i + 8], 16) for i in (0, 8, 16, 24))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    form, out = ("spm", f"<S>{suffix}<P>{prefix}<M>{middle}") if h4 % 100 < 80 else ("psm", f"<P>{prefix}<S>{suffix}<M>{middle}")
    return doc_id, len(units), form, len(prefix), len(middle), sha(out), sha(text)


@settings(max_examples=300, deadline=None)
@given(st.text("abé\U0001f600 \t\n\x0b\x0c\r\x85 ", max_size=60), st.integers(1, 7))
def test_boundaries_are_those_of_the_pattern(text, step):
    want = [0, *(m.end() for m in UNIT.finditer(text))]
    assert fim.boundaries(text, step).tolist() == want == fim.boundaries(text).tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 12), st.integers(1, 100_000)), max_size=2000), st.sampled_from([0, 1, 5, 126]))
def test_every_rank_is_found_and_lines_keep_their_error(lengths, error):
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    index = fim.fit(offsets, error)
    assert [index.offset(r) for r in range(len(offsets))] == offsets.tolist()
    assert np.abs(index.missed.astype(int)).max() <= error + 1


def test_words_of_usual_length_need_few_lines():
    lengths = np.random.default_rng(1).integers(2, 11, 200_000)
    index = fim.fit(np.concatenate([[0], np.cumsum(lengths)]))
    assert index.missed.dtype == np.int8 and len(index.first) < 400


def test_rows_equal_the_pattern_written_out(spark):
    texts = [None, "", " ", "\t\n  ", "one", " one ", "a b c\nd", "x <P> y", "<S", "<<S", "P>", "a <", "é 😀  ü\r\n\r\nz ", "w" * 300_000 + " v", " " * 300_000, "ab cd\n" * 60_000, "same", "same"]
    rows = [(i, t) for i, t in enumerate(texts * 6)] + [(None, "no id but words enough"), (7, "an id twice"), (7, "an id twice"), (-3, "less than zero it is")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("output", F.lit(1)).repartition(5)
    got = sorted((tuple(r) for r in fim.digest(fim.fill_in_middle(docs)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()), key=str)
    assert got == sorted((expected(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


def test_an_output_is_restored_whatever_stands_at_the_cuts(spark):
    rows = [(i, x + " <" + y) for i in range(40) for x, y in (("<", "P"), ("<S <M", "> M>"), ("<P", "S>"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    done = fim.fill_in_middle(docs, rate=100, spm=50)
    got = done.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(map(tuple, got)) == sorted(rows)


def test_no_rows(spark):
    assert fim.digest(fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_marks_that_overlap_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for marks in (("<P>", "P", "<M>"), ("aba", "<S>", "<M>"), ("<P", "<S", "P<"), ("", "<S>", "<M>"), ("<P>", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(docs, marks=marks)
