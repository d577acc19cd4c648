import base64

import numpy as np
import pytest

from tidewatch.llm import tokens


def plain():
    import tiktoken

    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["Hello world, it's 12 o'clock.\nNew line don't", "  two  spaces\n\nand\ttab ", "Éàü naïve 日本語 😀", "", None, "x", "a b c", "end \n", "tokens " * 5000]


def test_permutation_is_one_to_one():
    for n in (1, 2, 3, 17, 1000, 4097):
        out = tokens.feistel(np.arange(n), n, 99)
        assert sorted(out.tolist()) == list(range(n))
    assert tokens.feistel(np.arange(1000), 1000, 1).tolist() != tokens.feistel(np.arange(1000), 1000, 2).tolist()


def test_chunked_encoding_equals_the_tokenizer():
    encode, enc = tokens.Encoder(tokens.VOCABULARY, most=5), plain()
    for t in TEXTS:
        assert np.frombuffer(encode(t), "<u2").tolist() == enc.encode_ordinary(t or "")


def test_round_trip_and_places(spark, tmp_path):
    docs = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "clash"), (None, "no id", "clash")]
    df = spark.createDataFrame(docs, "doc_id long, text string, slot string")
    got = tokens.training_order(df, length=16, shard_rows=64, bucket_rows=3).collect()
    assert sorted(r["slot"] for r in got) == list(range(len(got)))
    assert all(len(r["tokens"]) == 32 and r["shard"] == r["slot"] // 64 and r["byte_offset"] == r["slot"] % 64 * 32 for r in got)
    enc, parts = plain(), {}
    for r in sorted(got, key=lambda r: r["seq"]):
        parts.setdefault((r["doc_id"], r["seq"]), []).append(np.frombuffer(r["tokens"], "<u2")[: r["n_tokens"]].tolist())
    for i, t, _ in docs:
        ids = [x for s in range(1000) if (i, s) in parts for x in parts[(i, s)][0]] if (i, 0) in parts and len(t or "") < 1000 else None
        if ids is not None:
            assert ids == [*enc.encode_ordinary(t or ""), tokens.END]
    assert len(parts[(0, 0)]) == 2  # a repeated row is a document like any other
    again = tokens.training_order(df.repartition(5), length=16, shard_rows=64, bucket_rows=3).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got), key=lambda r: r[0]) or {tuple(r) for r in again} == {tuple(r) for r in got}
    path = str(tmp_path / "shards")
    write = lambda docs=df, **k: tokens.write_shards(docs, path, **({"length": 16, "shard_rows": 64, "bucket_rows": 3} | k))
    assert write() == -(-len(got) // 64)
    assert tokens.damaged(spark, path).collect() == []
    rest = tokens.read_from(spark, path, 70).collect()
    assert [r["slot"] for r in rest] == list(range(70, len(got)))
    assert tokens.training_order(df.limit(0)).count() == 0
    # A slot is found by its offset alone, in a file of nothing but ids.
    by_slot = {r["slot"]: r for r in got}
    for slot in (0, 63, 64, 200, len(got) - 1):
        r = by_slot[slot]
        with open(f"{path}/shard-{r['shard']:09}.bin", "rb") as f:
            f.seek(r["byte_offset"])
            assert f.read(32) == bytes(r["tokens"]) == tokens.read_slot(path, slot).tobytes()
    assert all(bytes(r["tokens"]) == bytes(by_slot[r["slot"]]["tokens"]) for r in rest)
    # A broken run goes on where it ended: what is there at full size is passed over, also if a task left half a file.
    (tmp_path / "shards" / "shard-000000001.bin").unlink()
    (tmp_path / "shards" / "shard-000000002.bin").write_bytes(b"half")
    before = (tmp_path / "shards" / "shard-000000000.bin").stat().st_mtime_ns
    assert sorted(map(tuple, tokens.damaged(spark, path).collect())) == [(1, "missing"), (2, "changed")]
    assert write(df.repartition(3)) == 2 and write() == 0
    assert (tmp_path / "shards" / "shard-000000000.bin").stat().st_mtime_ns == before
    assert [bytes(r["tokens"]) for r in tokens.read_from(spark, path, 0).collect()] == [bytes(by_slot[i]["tokens"]) for i in range(len(got))]


def test_shards_of_another_corpus_key_or_length_are_never_kept(spark, tmp_path):
    path = str(tmp_path)
    one, two = (spark.createDataFrame([(i, f"{x} words {i} " * 20) for i in range(30)], "doc_id long, text string") for x in ("some", "else"))
    settings = {"length": 16, "shard_rows": 8}
    tokens.write_shards(one, path, **settings)
    for docs, other in ((two, {}), (one, {"key": 5}), (one, {"length": 8}), (one, {"shard_rows": 4})):
        with pytest.raises(ValueError):
            tokens.write_shards(docs, path, **(settings | other))
    order = {r["slot"]: bytes(r["tokens"]) for r in tokens.training_order(two, key=5, **settings).collect()}
    assert tokens.write_shards(two, path, overwrite=True, key=5, **settings) == -(-len(order) // 8)
    assert {s: tokens.read_slot(path, s).tobytes() for s in order} == order


def test_long_white_space_is_cut_as_the_pattern_cuts_it(spark):
    encode, whole = tokens.Encoder(tokens.VOCABULARY), plain()
    for space in (" ", "\n", " \n\t", "\xa0", "\u3000"):
        for text in (space * 40, "a" + space * 40 + "b", "a\n" + space * 41, space * 3 + " word"):
            assert np.frombuffer(encode(text), "<u2").tolist() == whole.encode_ordinary(text)
    # Ten million of each, where the pattern itself overflows: the ids grow with the run as those of a short one do.
    for space in (" ", "\n", "\t ", "\xa0"):
        n = 10_000_000 // len(space)
        ids = np.frombuffer(encode("a" + space * n + "b"), "<u2").tolist()
        assert whole.decode(ids) == "a" + space * n + "b"
        short = whole.encode_ordinary("a" + space * 4000 + "b")
        assert ids[:3] == short[:3] and ids[-3:] == short[-3:]
    docs = spark.createDataFrame([(1, " " * 1_500_000 + "x"), (2, "a" + "\n" * 1_500_000)], "doc_id long, text string")
    assert tokens.training_order(docs).agg({"n_tokens": "sum"}).first()[0] == (1_500_000 + 1) + (1 + 750_000 + 1)


def test_partitions_hold_whole_shards_in_order(spark):
    df = spark.createDataFrame([(i, "some words of a text " * 40) for i in range(60)], "doc_id long, text string")
    out = tokens.training_order(df, length=16, shard_rows=8, part_shards=2)
    parts = out.rdd.mapPartitionsWithIndex(lambda p, rows: [(p, [r["slot"] for r in rows])]).collect()
    n = sum(len(x) for _, x in parts)
    assert len(parts) == -(-n // 16) and all(x == list(range(16 * p, min(n, 16 * p + 16))) for p, x in parts)


def test_many_equal_rows_are_numbered_apart(spark):
    rows = [(None, None)] * 300 + [(7, "same text")] * 200 + [(1, "other")]
    got = tokens.training_order(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), length=16, bucket_rows=20).collect()
    assert sorted(r["slot"] for r in got) == list(range(501))
    assert sum(r["doc_id"] is None and r["n_tokens"] == 1 for r in got) == 300
