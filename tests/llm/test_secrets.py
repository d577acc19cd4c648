import hashlib
import random

from tidewatch.llm import secrets

SCHEMA = "doc_id long, text string, source string, lang string, findings string"
HEX = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
LIVE = "Zk3v9QpXr7LmT2wB8nYc5HdF"


def rows(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, (sources or ["s"] * len(texts))[i], "en", "clash") for i, t in enumerate(texts)], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_base_spans_and_digest(spark):
    text = f'é token = "{HEX}" x PASSWORD: abc AKIA{"A1" * 10} api_key=zzzzzzz'
    got = by_id(secrets.digest(secrets.scan_secrets(rows(spark, [text, None, ""]))))
    spans = [("assign", 2, 2 + len('token = "') + 40), ("hex", 11, 51)]
    at = text.index("AKIA")
    spans += [("access", at, at + 24), ("assign", text.index("api_key"), len(text))]
    want = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: s[1]))
    assert got[0]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert (got[0]["n_assign"], got[0]["n_access"], got[0]["n_hex"]) == (2, 1, 1)
    assert got[1]["spans"] == got[2]["spans"] == "" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_ownership_separates_examples_from_live(spark):
    shared = "q9Ws8Ed7Rf6Tg5Yh4Uj3Ik2Ol1"
    texts = [f"see {shared} here"] * 4 + [f"mine {LIVE} only"]
    got = by_id(secrets.digest(secrets.scan_secrets(rows(spark, texts, ["a", "b", "c", "d", "e"]))))
    assert got[4]["spans"] == f"owned:5:{5 + len(LIVE)}" and got[4]["n_live"] == 1
    assert all(got[i]["spans"] == "" for i in range(4))
    # The same string in the hands of one owner, however often, stays live.
    got = by_id(secrets.digest(secrets.scan_secrets(rows(spark, texts, ["a"] * 5))))
    assert all(got[i]["n_live"] == 1 for i in range(5))


def test_long_text_repeated_rows_nulls_and_no_rows(spark):
    long = "word " * 40_000 + f"token={LIVE}"
    df = spark.createDataFrame([(1, long, None, None, ""), (1, long, None, None, ""), (None, long, "s", "en", "")], SCHEMA)
    got = secrets.digest(secrets.scan_secrets(df)).collect()
    assert len(got) == 3 and all(r["n_assign"] == 1 for r in got)
    assert secrets.digest(secrets.scan_secrets(df.limit(0))).count() == 0


WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def run_from(text, at, allowed):
    while at < len(text) and text[at] in allowed:
        at += 1
    return at


def scanned(text):
    """Base spans by hand, a character at a time: [(start, kind, stop, value)]."""
    found, at = [], 0
    while at < len(text):
        word = next((w for w in WORDS if text[at : at + len(w)].lower() == w and text[at : at + len(w)].isascii()), None)
        if word:
            p = at + len(word)
            p += text[p : p + 1] in ("'", '"') and text[p : p + 1] != ""
            p = run_from(text, p, " ")
            if text[p : p + 1] in (":", "="):
                p = run_from(text, p + 1, " ")
                p += text[p : p + 1] in ("'", '"') and text[p : p + 1] != ""
                stop = run_from(text, p, VALUE)
                if stop > p:
                    if stop - p >= 6:
                        found.append((at, 0, stop, text[p:stop]))
                    at = stop
                    continue
        at += 1
    at = 0
    while (at := text.find("AKIA", at)) >= 0:
        stop = run_from(text, at, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
        if stop - at >= 20:
            found.append((at, 1, stop, text[at:stop]))
        at = max(stop, at + 4)
    at = 0
    while at < len(text):
        stop = run_from(text, at, set("0123456789abcdef"))
        if stop - at >= 24:
            found.append((at, 2, stop, text[at:stop]))
        at = stop + 1
    return sorted(found)


def test_base_spans_and_owners_by_hand(spark):
    rng = random.Random(9)
    chars = "abcdefABCXYZ0123456789+/_.=-"
    value = lambda n: "".join(rng.choice(chars) for _ in range(n))
    common = ["sharedvalue1x9Zq7", "AKIA" + "Q7" * 9, "0a1b2c3d" * 4, "tWo0wner5Val9ue"]
    piece = lambda: rng.choice([
        rng.choice(WORDS).title() + rng.choice(["", '"', "'"]) + " " * rng.randint(0, 2) + rng.choice([":", "=", "==", ""]) + " " * rng.randint(0, 2) + rng.choice(["", '"']) + rng.choice([*common, value(rng.randint(1, 12))]),
        "AKIA" + "".join(rng.choice("ABZ019") for _ in range(rng.randint(0, 22))), "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(20, 40))), rng.choice(common), "é", "AKIAAKIA", "plain words", "paſſword=longenough", value(rng.randint(18, 30)),
    ])
    docs = [(i, rng.choice(["", " ", "\n"]).join(piece() for _ in range(rng.randint(0, 9))), rng.choice("ABC"), rng.choice(["x", "y", None])) for i in range(250)]
    got = {r["doc_id"]: r["findings"] for r in secrets.scan_secrets(spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").repartition(3)).collect()}
    want = {i: scanned(t) for i, t, _, _ in docs}
    digest = lambda v: hashlib.sha256(v.encode()).hexdigest()
    owners, repos = {}, {}
    for i, t, s, lang in docs:
        # Every candidate counts, bare tokens too.
        for v in {x[3] for x in want[i]} | {x for x in bare(t) if secrets.live_looking(x)}:
            owners.setdefault(digest(v), set()).add(s)
            repos.setdefault(digest(v), set()).add((s, lang or ""))
    for i, t, _, _ in docs:
        base = [f for f in got[i] if f["kind"] < 3]
        assert [(f["start"], f["kind"], f["stop"], f["value_hash"]) for f in base] == [(a, k, b, digest(v)) for a, k, b, v in want[i]], t
        for f in got[i]:
            n, m = len(owners[f["value_hash"]]), len(repos[f["value_hash"]])
            assert (f["n_owners"], f["n_repos"]) == (n, m)
            assert f["verdict"] == ("example" if n > 2 or m > 4 else "live" if f["live_looking"] else "weak")
        covered = {p for a, _, b, _ in want[i] for p in range(a, b)}
        live = {x for x in bare(t) if secrets.live_looking(x) and len(owners[digest(x)]) <= 2 and len(repos[digest(x)]) <= 4}
        for f in got[i]:
            if f["kind"] == 3:
                assert t[f["start"] : f["stop"]] in live and covered.isdisjoint(range(f["start"], f["stop"]))
        assert {t[f["start"] : f["stop"]] for f in got[i] if f["kind"] == 3} <= live


def bare(text):
    """Runs of 20 characters or more that a token is made of."""
    out, at = [], 0
    while at < len(text):
        stop = run_from(text, at, VALUE - {"."})
        if stop - at >= 20:
            out.append(text[at:stop])
        at = stop + 1
    return out


def test_kinds_at_one_start_and_clashing_columns(spark):
    text = "AKIA" + "0" * 30 + " token=0123456789abcdef0123456789"
    df = spark.createDataFrame([(1, text, "s", "l", "x", 1)], "doc_id long, text string, source string, lang string, findings string, row_id int")
    got = secrets.digest(secrets.scan_secrets(df)).first()
    assert got["spans"].startswith("access:0:34,hex:4:34,assign:35:") and (got["n_assign"], got["n_access"], got["n_hex"]) == (1, 1, 2)
    same = "f" * 40
    both = secrets.find(f"{same}")
    assert [x["kind"] for x in both] == [2] and secrets.find("") == secrets.find(None) == []


def test_very_many_findings_in_one_text(spark):
    """Time grows with the text: two hundred thousand tokens, each second one inside an assignment."""
    import time

    text = " ".join(f"{'token=' if i % 2 else ''}{hashlib.sha256(str(i).encode()).hexdigest()[:30].upper()}q7" for i in range(200_000))
    began = time.perf_counter()
    found = secrets.find(text)
    assert time.perf_counter() - began < 20
    assert sum(x["kind"] == 0 for x in found) == 100_000
    covered = [(x["start"], x["stop"]) for x in found if x["kind"] < 3]
    starts = sorted(covered)
    import bisect

    assert sum(x["kind"] == 3 and x["covered"] for x in found) > 50_000 < sum(x["kind"] == 3 and not x["covered"] for x in found)
    for x in found:
        if x["kind"] == 3 and not x["covered"]:
            i = bisect.bisect_left(starts, (x["start"], 0))
            assert all(not (a < x["stop"] and x["start"] < b) for a, b in starts[max(0, i - 3) : i + 3])
