import hashlib
import random

from tidewatch.llm import phrases


def brute(docs, window=20):
    split = sorted((i, (t or "").encode().split()) for i, t in docs)
    first, out = {}, {}
    for i, ws in split:
        for s in range(len(ws) - window + 1):
            first.setdefault(tuple(ws[s : s + window]), (i, s))
    for i, ws in split:
        gone = set()
        for s in range(len(ws) - window + 1):
            if first[tuple(ws[s : s + window])] != (i, s):
                gone.update(range(s, s + window))
        out[i] = (len(ws), len(gone), hashlib.sha256(b" ".join(w for k, w in enumerate(ws) if k not in gone)).hexdigest())
    return out


def corpus():
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(60)] + ["é", " x"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, line = text(55), text(23)
    docs = [(i, text(rng.randint(0, 120))) for i in range(40)]
    docs += [(50 + i, f"{text(9)}\n{passage}\t{text(rng.randint(0, 30))}") for i in range(12)]
    docs += [(80 + i, f"{line} {text(5)}  {line} {text(30)} {passage[40:]}") for i in range(12)]
    return docs + [(100, docs[3][1]), (101, docs[3][1]), (102, "same " * 90), (103, "same " * 21), (104, None), (105, "  "), (106, text(19))]


def check(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, 3) for i, t in docs], "doc_id long, text string, kept int")
    found = phrases.digest(phrases.remove_repeats(df, **kw)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == brute(docs)
    return found


def test_against_brute_force(spark):
    check(spark, corpus())


def test_hot_anchors_in_several_shards(spark, monkeypatch):
    monkeypatch.setattr(phrases.repeated_windows, "__defaults__", (20, 6, 3))  # three segments to a shard
    check(spark, corpus())


def test_long_text_null_id_repeated_rows_and_no_rows(spark):
    rng = random.Random(4)
    long = " ".join(f"u{rng.randrange(10**6)}" for _ in range(30_000))
    df = spark.createDataFrame([(None, long), (1, long), (1, long), (2, "short text")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in phrases.remove_repeats(df).collect())
    assert got == [(-1, 0), (1, 30_000), (1, 30_000), (2, 0)]
    assert phrases.remove_repeats(df.limit(0)).count() == 0


def test_texts_that_share_an_id_are_documents_of_their_own(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    passage, line, own = text(30), text(25), [text(n) for n in (5, 90, 7, 80)]
    rows = [(None, f"{own[0]} {passage}"), (None, f"{own[1]} {passage}"), (4, f"{own[2]} {line}"), (4, f"{own[3]} {line}"), (9, passage), (9, line)]
    for salt_rows in (2000, 1):
        monkeypatch.setattr(phrases.repeated_windows, "__defaults__", (20, 6, salt_rows))
        got = phrases.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        kept = sorted((r["doc_id"] or -1, r["n_words"], r["kept"]) for r in got)
        for at, (words, shared) in enumerate([(own[:2], passage), (own[2:], line)]):
            pair = kept[2 * at : 2 * at + 2]
            assert [k[2].startswith(w) for k, w in zip(pair, words, strict=True)] == [True, True]
            assert sum(shared in k[2] for k in pair) == 1 and sorted(len(k[2].split()) - len(w.split()) for k, w in zip(pair, words, strict=True)) == [0, len(shared.split())]
        assert [k[2] for k in kept[4:]] == ["", ""]


def segments_of(docs, window=20):
    """Whole documents as segments of one anchor."""
    return [(0, (i, 0), 0, t.encode()) for i, t in docs if len(t.split()) >= window]


def test_only_what_the_automaton_finds_is_an_occurrence(monkeypatch):
    rng = random.Random(3)
    for trial in range(30):
        vocab = [f"v{i}" for i in range(rng.choice([1, 2, 3, 40]))]
        text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
        passage = text(rng.randint(20, 60))
        docs = [(i, f"{text(rng.randint(0, 30))} {passage if i % 2 else text(40)} {text(rng.randint(0, 30))}") for i in range(8)]
        got = {doc[0]: late for doc, late, _ in phrases.repeated(segments_of(docs), 20, False)}
        first, want = {}, {}
        for i, t in docs:
            ws = t.split()
            want[i] = [s for s in range(len(ws) - 19) if first.setdefault(tuple(ws[s : s + 20]), (i, s)) != (i, s)]
        assert got == want
        assert any(want.values())
        with monkeypatch.context() as m:  # with an automaton of nothing, nothing is found
            m.setattr(phrases, "compiled", lambda *a: (phrases.ahocorasick.Automaton(phrases.ahocorasick.STORE_INTS, phrases.ahocorasick.KEY_SEQUENCE), []))
            assert not any(late for _, late, _ in phrases.repeated(segments_of(docs), 20, False))
        with monkeypatch.context() as m:  # without one of its passages, that one's occurrences are not found
            m.setattr(phrases, "confirmed", lambda keys, times, f=phrases.confirmed: set(sorted(f(keys, times))[1:]))
            assert sum(map(len, want.values())) > sum(len(late) for _, late, _ in phrases.repeated(segments_of(docs), 20, False))


def test_one_long_text_that_repeats_itself(spark, monkeypatch):
    rows = [(1, "same " * 1_000_000), (2, "a b " * 30_000), (3, " ".join(f"w{i % 700}" for i in range(60_000))), (4, "same " * 600)]
    for salt_rows in (2000, 50):
        monkeypatch.setattr(phrases.repeated_windows, "__defaults__", (20, 6, salt_rows, 200))
        got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in phrases.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {1: (1_000_000, 999_999), 2: (60_000, 59_998), 3: (60_000, 59_300), 4: (600, 600)}


def test_texts_that_repeat_only_themselves(spark):
    """One document each of short and long periods, whose phrases no other document has."""
    rng = random.Random(12)
    docs = []
    for i, period in enumerate([1, 2, 3, 5, 14, 15, 16, 17, 19, 20, 21, 30, 64, 300]):
        own = [f"d{i}w{rng.randrange(10**6)}" for _ in range(period)]
        docs.append((i, " ".join(own[k % period] for k in range(period + rng.choice([19, 20, 21, 40, 200])))))
    docs += [(50 + k, " ".join([f"e{k}"] * k)) for k in (19, 20, 21, 34, 35, 36, 60)]
    check(spark, docs)


def test_columns_of_other_names_and_types(spark):
    df = spark.createDataFrame([(5, "word " * 30, "x", 1), (6, "word " * 30, None, 2)], "key int, body string, id string, anchor int")
    got = {r["key"]: r["n_removed"] for r in phrases.remove_repeats(df, "key", "body").collect()}
    assert got == {5: 29, 6: 30}
