from tidewatch.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, participant string"


def plain(turns):
    """Each participant's view, text and trained pieces."""
    out = {}
    for me in {r or "unknown" for _, r, _ in turns} - {"system"}:
        text, trained = "", []
        for _, role, t in turns:
            role, t = role or "unknown", t or ""
            text += "<|system|>\n" if role == "system" else "<|assistant|>\n" if role == me else f"<|user name={role}|>\n"
            start = len(text)
            text += t + chat.END
            if role == me:
                trained.append((start, len(text)))
        out[me] = (text, trained)
    return out


def test_every_participant_once(spark):
    turns = [(0, "system", "Be kind."), (1, "ann", "Hé 😀"), (2, "bob", None), (3, None, "who"), (4, "ann", "bye\nbye")]
    df = spark.createDataFrame([(7, n, r, t, "clash") for n, r, t in turns], SCHEMA)
    got = {r["participant"]: r for r in chat.rotate_perspectives(df).collect()}
    want = plain(turns)
    assert set(got) == {"ann", "bob", "unknown"}
    for p, (text, trained) in want.items():
        assert got[p]["rendered"] == text and got[p]["mask"] == ",".join(f"{a}:{b}" for a, b in trained)
        assert (got[p]["n_turns"], got[p]["n_trained"]) == (5, len(trained))


def test_long_dialogues_in_parts_ties_nulls_and_no_rows(spark):
    rows = [(1, i, "ab"[i % 2], "x" * (i % 5), "") for i in range(1200)] + [(None, None, "a", "n", ""), (None, 0, "a", "m", ""), (2, 0, "system", "only", ""), (3, 0, "a", "t", ""), (3, 0, "a", "t", "")]
    got = chat.rotate_perspectives(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["part"], r["n_turns"]) for r in got if r["conv_id"] == 1) == [(0, 512)] * 2 + [(1, 512)] * 2 + [(2, 176)] * 2
    assert {r["rendered"] for r in got if r["conv_id"] is None} == {"<|assistant|>\nn<|end|>\n<|assistant|>\nm<|end|>\n"}
    assert not [r for r in got if r["conv_id"] == 2] and [r["n_turns"] for r in got if r["conv_id"] == 3] == [2]
    assert chat.rotate_perspectives(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_and_null_turn_numbers_in_pieces(spark):
    rows = [(1, None, "ab"[i % 2], f"{i:05}", "") for i in range(3000)] + [(1, 7, "a", "same", "")] * 700 + [(None, 5, "c", f"{i:04}", "") for i in range(600)] + [(2, 3, "a", "t", "")]
    got = chat.rotate_perspectives(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert max(r["n_turns"] for r in got) == 512 and len(got) == 2 * 8 + 2 + 1
    for me in "ab":
        own = sorted((r for r in got if r["conv_id"] == 1 and r["participant"] == me), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(8)) and sum(r["n_turns"] for r in own) == 3700
        turns = sorted([(0 if n is None else 1 + n, role, t) for c, n, role, t, _ in rows if c == 1])
        assert "".join(r["rendered"] for r in own) == plain([(n, role, t) for n, role, t in turns])[me][0]
        for r in own:
            spans = [tuple(map(int, x.split(":"))) for x in r["mask"].split(",") if x]
            assert len(spans) == r["n_trained"] and all(r["rendered"][: a].endswith("<|assistant|>\n") and r["rendered"][a:b].endswith(chat.END) for a, b in spans)
