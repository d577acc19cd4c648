import random

from pyspark.sql import functions as F

from tidewatch.operators import campaigns, evaluation, graph, quality, serving, text, threat


def machine(rows, threshold):
    """The order-book machine step by step."""
    state, last, out = "VALID", None, []
    for seq, age, is_book in rows:
        gap = last is not None and (seq > last + 1 or seq <= last)
        last = max(seq, last or seq)
        if is_book:
            if age > threshold:
                state = "STALE"
            elif gap:
                state = "GAP_DETECTED"
            else:
                state = {"GAP_DETECTED": "RESYNCING", "STALE": "RESYNCING", "RESYNCING": "RECOVERED", "RECOVERED": "VALID"}.get(state, state)
        out.append(state if is_book else None)
    return out


def test_book_states_equal_the_machine(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for a in range(30):
        seq, own = 0, []
        for i in range(40):
            seq += rng.choice([1, 1, 1, 1, 2, 0])
            own.append((seq, rng.choice([1, 1, 1, 99]), rng.random() < 0.7))
        want[f"A{a}"] = machine(own, 30)
        rows += [("s", f"A{a}", i, 0.0, float(age), s, b) for i, (s, age, b) in enumerate(own)]
    df = spark.createDataFrame(rows, "source string, asset_id string, arrival int, epoch double, ingested_epoch double, sequence long, is_orderbook boolean")
    for r in quality.observe(df, 30).collect():
        assert r["orderbook_state"] == want[r["asset_id"]][r["arrival"]]
    golden = spark.createDataFrame([("s", "g", i, 0.0, 1.0, s, True) for i, s in enumerate((1, 3, 4, 5))], df.schema)
    assert [r["orderbook_state"] for r in quality.observe(golden, 30).orderBy("arrival").collect()] == ["VALID", "GAP_DETECTED", "RESYNCING", "RECOVERED"]


def test_stage_path_and_sessions(spark):
    z = lambda t, sev, social=0.0, coord=0.0, market=0.0, ret=0.0, p=0.0: ("A", t, sev, social, coord, market, ret, p)
    rows = [z(0, "NORMAL"), z(60, "WATCH", 0.5), z(120, "WATCH", 0.6, 0.7), z(180, "HIGH", 0.6, 0.7, 0.8), z(240, "HIGH", 0.6, 0.7, 0.8, -0.1), z(300, "NORMAL"), z(300 + 1801, "WATCH", 0.5)]
    got = campaigns.stages(spark.createDataFrame(rows, "asset_id string, epoch long, severity string, social double, coordination double, market double, price_return double, pressure double")).orderBy("epoch").collect()
    assert [r["stage"] for r in got] == ["NORMAL", "EARLY_SOCIAL_SEEDING", "COORDINATED_AMPLIFICATION", "MARKET_PUMP", "DUMP", "POST_EVENT", "EARLY_SOCIAL_SEEDING"]
    assert [r["session"] for r in got] == [0] * 6 + [1]


def test_alert_cool_down(spark):
    rows = [("A", "T", t, s) for t, s in ((0, "WATCH"), (100, "WATCH"), (290, "WATCH"), (310, "WATCH"), (320, "HIGH"), (400, "WATCH"))]
    states = campaigns.alert_state(spark.createDataFrame(rows, "asset_id string, alert_type string, epoch long, alert_severity string"))
    got = campaigns.notified(states, 300).orderBy("epoch").collect()
    assert [r["event"] for r in got] == ["created", "refreshed", "refreshed", "refreshed", "severity_changed", "refreshed"]
    assert [r["suppressed"] for r in got] == [False, True, True, False, False, True]


def test_depth_is_cycle_safe(spark):
    rows = [(1, f"p{i}", f"p{i - 1}" if i else None) for i in range(6)] + [(2, "x", "y"), (2, "y", "x"), (3, "z", "gone")]
    got = {r["g"]: r["propagation_depth"] for r in graph.depth(spark.createDataFrame(rows, "g int, post_id string, reply_to string"), "g").collect()}
    assert got[1] == 5 and got[3] == 0 and got[2] >= 1


def test_clusters_do_not_depend_on_input_order(spark):
    rows = [("g", 1, 1, [1.0, 0.0]), ("g", 2, 2, [0.98, 0.2]), ("g", 3, 3, [0.0, 1.0]), ("g", 4, 4, [0.05, 1.0]), ("h", 5, 1, [1.0, 0.0])]
    schema = "grp string, post_id long, epoch long, vector array<double>"
    a = sorted(map(tuple, text.cluster(spark.createDataFrame(rows, schema), "grp").collect()))
    b = sorted(map(tuple, text.cluster(spark.createDataFrame(rows[::-1], schema).repartition(3), "grp").collect()))
    assert a == b == [(1, 1, 2), (2, 1, 2), (3, 3, 2), (4, 3, 2), (5, 5, 1)]


def test_posts_claims_and_chunks(spark):
    p = spark.createDataFrame([(1, "Buy #Pump2 now é$AB $xyz @bob_1 https://a.example/x?y=1, (http://b.example)!")], "post_id long, text string")
    r = text.parse_posts(p).first()
    assert (r["hashtags"], r["cashtags"], r["mentions"], r["urls"]) == (["PUMP2"], ["XYZ"], ["bob_1"], ["https://a.example/x?y=1", "http://b.example"])
    c = text.claims(spark.createDataFrame([(1, "The firm won a contract award of 500 units. It denied any listing plans and the promoter did not buy shares")], "k long, text string"), "k").orderBy("n").collect()
    assert [(x["claim_type"], x["polarity"], x["amounts"]) for x in c] == [("CONTRACT_AWARD", "POSITIVE", ["500"]), ("EXCHANGE_LISTING", "NEGATIVE", []), ("INSIDER_PURCHASE", "NEGATIVE", [])]
    t = "\n".join(["a" * 500, "", "b" * 600, "c" * 200, "d" * 2000])
    got = [x["text"] for x in text.chunks(spark.createDataFrame([(1, t), (2, None)], "k long, text string"), "k").orderBy("chunk").collect()]
    assert [len(x) for x in got] == [1101, 200, 2000] and "".join(got).replace("\n", "") == t.replace("\n", "")


def test_indicator_normal_forms(spark):
    cases = [("Domain", "Example.COM.", "example.com"), ("url", "HTTP://Ex.com:80#f", "http://ex.com/"), ("URL", "https://a.b:8443/p?q=1", "https://a.b:8443/p?q=1"), ("IPv4", "1.2.3.4", "1.2.3.4"), ("IPv4", "1.2.3.400", None), ("IPv6", "2001:0DB8::0001", "2001:db8::1"), ("FileHash-MD5", "A" * 32, "a" * 32), ("md5", "a" * 31, None), ("email", "Bob@EX.com", "bob@ex.com"), ("bitcoinaddress", "x" * 30, "x" * 30), ("what", "x", None), ("domain", "-bad-.com", None)]
    df = spark.createDataFrame([(i, t, v) for i, (t, v, _) in enumerate(cases)], "i int, type string, indicator string")
    got = {r["i"]: r["indicator_value"] for r in threat.normalize(df).collect()}
    assert [got.get(i) for i in range(len(cases))] == [w for _, _, w in cases]
    found = threat.candidates(spark.createDataFrame([(1, f"see http://x.example/a and evil.example, 10.0.0.1 {'f' * 32}")], "post long, text string"), "post").collect()
    assert {(r["indicator_type"], r["indicator_value"]) for r in found} == {("URL", "http://x.example/a"), ("DOMAIN", "x.example"), ("DOMAIN", "evil.example"), ("IPV4", "10.0.0.1"), ("DOMAIN", "10.0.0.1"), ("MD5", "f" * 32)}
    more = threat.candidates(spark.createDataFrame([(1, "(HTTPS://User@Bad.Example:443/x?y#z) ::1 2001:DB8::5, a@b.example")], "post long, text string"), "post").collect()
    assert {(r["indicator_type"], r["indicator_value"]) for r in more} == {("URL", "https://bad.example/x?y"), ("DOMAIN", "bad.example"), ("IPV6", "::1"), ("IPV6", "2001:db8::5")}


def test_percentile_calibration_and_platt(spark):
    p = evaluation.exact_percentile(spark.createDataFrame([(1, 21.0), (1, 22.0), (1, 23.0)], "k int, v double"), ["k"], "v", 0.95).first()
    assert p["percentile"] == 23.0
    rows = [(0.9, 1)] * 15 + [(0.2, 0)] * 15
    df = spark.createDataFrame(rows, "p double, y int")
    a, b = evaluation.fit_platt(df, "p", "y")
    assert (a, b) == evaluation.fit_platt(df.orderBy(F.desc("p")), "p", "y")
    before, after = (evaluation.calibration_metrics(d, "p", "y").first() for d in (df, evaluation.calibrated(df, "p", a, b).select(F.col("calibrated").alias("p"), "y")))
    assert before["auc"] == after["auc"] == 1.0 and after["brier"] < before["brier"]


def test_as_of_scd_and_chain(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 3, "x"), ("a", 5, "y"), ("a", 6, "z")], "k string, t int, v string")
    assert sorted(map(tuple, serving.as_of(left, right, "k", "t", "t", ["v"]).collect())) == [("a", 1, None), ("a", 5, "y"), ("b", 9, None)]
    v = serving.versions(spark.createDataFrame([("d", 1, "x"), ("d", 2, "x"), ("d", 3, "y")], "k string, n int, c string"), "k", "n", "c").orderBy("n").collect()
    assert [(r["n"], r["version"], r["status"]) for r in v] == [(1, 1, "SUPERSEDED"), (3, 2, "CURRENT")]
    chain = serving.evidence_chain(spark.createDataFrame([("k", 1, "x"), ("k", 2, "y")], "k string, v int, c string"), "k", "v", ["c"]).orderBy("version").collect()
    again = serving.evidence_chain(spark.createDataFrame([("k", 1, "other"), ("k", 2, "y")], "k string, v int, c string"), "k", "v", ["c"]).orderBy("version").collect()
    assert chain[1]["content_hash"] == again[1]["content_hash"] and chain[1]["chain_hash"] != again[1]["chain_hash"]


def test_depth_around_cycles(spark):
    rows = [(2, "a", "b"), (2, "b", "c"), (2, "c", "a"), (2, "d", "a"), (2, "e", "d"), (3, "s", "s")]
    got = graph.depth(spark.createDataFrame(rows, "g int, post_id string, reply_to string"), "g").collect()
    assert {r["g"]: r["propagation_depth"] for r in got} == {2: 4, 3: 0}


def test_depth_of_a_long_chain(spark):
    rows = [(1, f"p{i}", f"p{i - 1}" if i else None) for i in range(600)]
    assert [r["propagation_depth"] for r in graph.depth(spark.createDataFrame(rows, "g int, post_id string, reply_to string"), "g").collect()] == [599]


LONG = "The very long registered name of a company that has more than sixty-four characters in it"
R, A, U = "RESOLVED", "AMBIGUOUS", "UNRESOLVED"
#: Texts and what they mention, in the order of their places: what is said, how, and what is made of it.
MENTIONS = [
    ("$ACME and #zed, go go GO stock!", [("$ACME", "CASHTAG", A, 0.7), ("#zed", "HASHTAG", R, 0.82), ("go", "BARE", R, 0.88), ("go", "BARE", R, 0.88), ("GO", "BARE", R, 0.88)]),
    ("I like Acme Corp & sons; the acme corp &sons are not", [("Acme", "BARE", A, 0.4), ("Acme Corp & sons", "BARE", R, 0.62), ("acme", "BARE", A, 0.4)]),
    ("buy zed coin, zed coins, $zed $NOPE #GO #what_ever", [("zed", "BARE", R, 0.88), ("zed coin", "BARE", R, 0.88), ("zed", "BARE", R, 0.88), ("$zed", "CASHTAG", R, 0.98), ("$NOPE", "CASHTAG", U, 0.0), ("#GO", "HASHTAG", R, 0.82), ("#what_ever", "HASHTAG", U, 0.0)]),
    ("#go and then nothing", [("#go", "HASHTAG", A, 0.6)]),
    ("s&p 500 and S&P, $S&P; x$ACME #ACME_x ##zed $go", [("s&p", "BARE", R, 0.62), ("s&p 500", "BARE", R, 0.62), ("S&P", "BARE", R, 0.62), ("$S", "CASHTAG", U, 0.0), ("#ACME_x", "HASHTAG", U, 0.0), ("#zed", "HASHTAG", R, 0.82), ("$go", "CASHTAG", R, 0.98)]),
    ("nothing here", []),
    ("Straße ß zed — ZED’s full width", [("zed", "BARE", R, 0.62), ("ZED", "BARE", R, 0.62), ("full width", "BARE", R, 0.62)]),
    ("", []),
    (None, []),
    ("go " * 5 + "token", [("go", "BARE", R, 0.88)] * 5),
    ("other Other $other $Other16charslong0x", [("other", "BARE", R, 0.62), ("Other", "BARE", R, 0.62), ("$other", "CASHTAG", R, 0.98), ("$Other16charslong", "CASHTAG", U, 0.0)]),
    (f"x {LONG.lower()}, {LONG}s {LONG}", [(LONG.lower(), "BARE", R, 0.62), (LONG, "BARE", R, 0.62)]),
]


def test_mentions_of_a_table_of_cases(spark):
    assets = [("a1", "ACME", "Acme Corp & Sons"), ("a2", "GO", "Go"), ("a3", "ZED", "Zed Coin"), ("a4", "ACME", "Other"), ("a5", "S&P", "S&P 500"), ("a6", "ＦＵＬＬ", "Full Width"), ("a7", "LNG", LONG)]
    table = text.alias_table(spark.createDataFrame(assets, "asset_id string, symbol string, name string"), ["go"])
    posts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(MENTIONS)], "post_id int, text string")
    got = {}
    for r in sorted(text.resolve_mentions(posts, table).collect(), key=lambda r: (r["post_id"], r["start"], r["stop"])):
        got.setdefault(r["post_id"], []).append((r["mention_text"], r["kind"], r["status"], r["confidence"]))
        assert r["mention_text"] == MENTIONS[r["post_id"]][0][r["start"] : r["stop"]]
        assert (r["asset_id"] is not None) == (r["status"] == "RESOLVED")
    assert [got.get(i, []) for i in range(len(MENTIONS))] == [want for _, want in MENTIONS]

def test_mentions_hold_few_places_at_a_time(spark):
    """Many places of a text go on in pieces, beside aliases of any length; the texts are read once."""
    registry = spark.createDataFrame([("GO", "A1", False), ("STAY " + "X" * 50_000, "A2", False), ("Ü", "A3", False), (None, "A4", False)], "alias string, asset_id string, ambiguous boolean")
    long = "go on " * 30_000
    posts = spark.createDataFrame([(1, long), (2, "stay " + "x" * 50_000), (3, "stay " + "x" * 50_001 + " $go #None \ufb01 ü"), (4, None)], "post_id int, text string")
    got = text.resolve_mentions(posts, registry)
    assert got.groupBy("post_id", "kind", "asset_id").count().orderBy("post_id", "kind", "asset_id").collect() == [(1, "BARE", "A1", 30_000), (2, "BARE", "A2", 1), (3, "BARE", "A3", 1), (3, "CASHTAG", "A1", 1), (3, "HASHTAG", None, 1)]
    handed = list(text.pieces((1, "x" * 10, i, "y" * 1000) for i in range(20_000)))
    assert sum(map(len, handed)) == 20_000 and max(map(len, handed)) <= text.HELD and max(sum(len(r[-1]) for r in x) for x in handed) <= text.HELD_CHARACTERS
    assert str(got._jdf.queryExecution().optimizedPlan()).count("MapInArrow") == 1


def test_clusters_take_the_best_that_both_limits_allow(spark):
    """A post whose nearest centroid has a member too far from it joins the next group, which admits it."""
    import numpy as np

    rng = np.random.default_rng(8)
    base = rng.normal(size=(3, 6))
    rows = [("g", i, i, (base[rng.integers(3)] + 0.45 * rng.normal(size=6)).tolist()) for i in range(60)]
    out = text.cluster(spark.createDataFrame(rows, "grp string, post_id long, epoch long, vector array<double>"), "grp").collect()
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    groups = []
    for _, i, _, v in rows:
        unit = {j: np.array(rows[j][3]) / np.linalg.norm(rows[j][3]) for j in range(60)}
        open_ = [(-cos(v, np.mean([unit[j] for j in m], 0)), m[0], m) for m in groups if cos(v, np.mean([unit[j] for j in m], 0)) >= 0.76 and min(cos(v, unit[j]) for j in m) >= 0.68]
        min(open_)[2].append(i) if open_ else groups.append([i])
    assert {r["post_id"]: r["seed_id"] for r in out} == {i: m[0] for m in groups for i in m}


def test_verdicts_in_their_order(spark):
    """Conflict, support in time, support later, incomplete sources, candidates that don't match, none at all."""
    m = [(1, 0.5, 0.9, True, True), (1, 0.9, 0.9, True, False), (2, 0.4, 0.7, True, False), (2, 0.34, 0.8, True, False), (2, 0.9, 0.95, False, False), (2, 0.2, 0.99, True, False), (3, 0.4, 0.9, False, False), (4, 0.3, 0.9, True, False), (5, 0.3, 0.9, True, True), (8, 0.5, 0.6, False, True)]
    matches = spark.createDataFrame(m, "claim int, score double, reliability double, before boolean, conflict boolean")
    claims = spark.createDataFrame([(i,) for i in range(1, 9)], "claim int")
    coverage = spark.createDataFrame([(2, False), (4, False), (5, True), (6, False), (7, True)], "claim int, complete boolean")
    got = {r["claim"]: (r["result"], r["claim_risk"], r["legitimate"], r["candidates"]) for r in text.verdicts(claims, matches, "claim", coverage).collect()}
    assert got == {
        1: ("CONFLICTING", 1.0, 0.0, 2), 2: ("SUPPORTED_BEFORE", 0.15, 0.8, 4), 3: ("SUPPORTED_AFTER", 0.75, 0.0, 1), 4: ("UNKNOWN", 0.5, 0.0, 1),
        5: ("UNSUPPORTED", 0.9, 0.0, 1), 6: ("UNKNOWN", 0.5, 0.0, 0), 7: ("UNKNOWN", 0.5, 0.0, 0), 8: ("SUPPORTED_AFTER", 0.75, 0.0, 1),
    }
    assert {r["claim"]: r["result"] for r in text.verdicts(claims, matches, "claim").collect()}[4] == "UNSUPPORTED"


def test_graph_projection_is_typed_distinct_and_idempotent(spark):
    schema = "g string, post_id string, author_id string, asset_id string, narrative_id string, scope_id string, epoch long, reply_to string, repost_of string, urls array<string>, hashtags array<string>"
    rows = [("g", "p1", "u", "A", "n", "S", 1, None, None, [], []), ("g", "p2", "u", "A", "n", "S", 2, "p1", None, ["x"], None), ("g", "p3", "v", "A", "m", "S", 3, "", "gone", None, []), ("g", "late", "v", "A", "m", "S", 99, None, None, [], [])]
    posts = spark.createDataFrame(rows, schema)
    campaigns, alerts = spark.createDataFrame([("g", "c")], "g string, campaign_id string"), spark.createDataFrame([("g", "a1"), ("g", "a2")], "g string, alert_id string")
    got = sorted((r["src"], r["relation"], r["dst"]) for r in graph.relations(posts.unionAll(posts), campaigns, alerts, "g", 10).collect())
    assert got == sorted([
        ("u", "POSTED", "p1"), ("u", "POSTED", "p2"), ("v", "POSTED", "p3"), *((p, "MENTIONS", "A") for p in ("p1", "p2", "p3")), ("p1", "MEMBER_OF", "n"), ("p2", "MEMBER_OF", "n"), ("p3", "MEMBER_OF", "m"), ("p2", "REPLIES_TO", "p1"),
        ("p3", "REPOSTS", "gone"), ("p2", "AMPLIFIES", "n"), ("p3", "AMPLIFIES", "m"), ("c", "TARGETS", "A"), *((n, "EVIDENCE_FOR", x) for n in "nm" for x in ("c", "a1", "a2")),
    ])
    counts = graph.projection_counts(posts, campaigns, alerts, "g", 10).first()
    assert (counts["nodes"], counts["relations"]) == (2 + 3 + 2 + 1 + 1 + 2, 9 + 1 + 1 + 2)
    one, two = graph.nodes(posts.where("post_id <> 'p1'"), campaigns, alerts, "g", 10, 1), graph.nodes(posts.where("post_id in ('p1', 'p2')").withColumn("scope_id", F.lit("T")), campaigns, alerts, "g", 10, 2)
    want = sorted(map(tuple, graph.merged(one.unionAll(two)).drop("write").collect()), key=str)
    assert sorted(map(tuple, graph.merged(graph.merged(two.unionAll(two)).unionAll(one).unionAll(two)).drop("write").collect()), key=str) == want
    post = {i: (t, s) for label, i, t, s in want if label == "Post"}
    assert post == {"p1": (1, "T"), "p2": (2, "T"), "p3": (3, "S"), "gone": (None, None)} and len(want) == 4 + 2 + 2 + 1 + 1 + 2


def test_depth_goes_on_over_reposts(spark):
    rows = [(1, "a", None, None), (1, "b", "a", None), (1, "c", None, "b"), (1, "d", "", "c"), (1, "e", "a", "d")]
    assert graph.depth(spark.createDataFrame(rows, "g int, post_id string, reply_to string, repost_of string"), "g").first()["propagation_depth"] == 3


def test_messages_of_one_channel_lie_in_many_tasks(spark):
    """And are signed as the standard library does, each channel with its own secret."""
    import hashlib
    import hmac

    secrets = {0: "pepper", 1: None, 2: "", 3: "k" * 64, 4: "sält"}
    channels = spark.createDataFrame([(i, "WEBHOOK" if i != 3 else "SLACK", s) for i, s in secrets.items()] + [(5, "WEBHOOK", "k" * 64)], "channel_id int, channel_type string, secret string")
    secrets |= {3: None, 5: "k" * 64}
    text_of = lambda v: F.lit(v).alias(v)
    sent = spark.range(1200).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 6).cast("int").alias("channel_id"), F.col("id").cast("string").alias("event_id"), *(text_of(c) for c in serving.MESSAGE if c != "event_id"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = serving.messages(sent, channels).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 1200 and len({r["task"] for r in got if r["channel_id"] == 0}) > 1
    for r in got:
        secret = secrets[r["channel_id"]]
        assert r["signature"] == ("sha256=" + hmac.new(secret.encode(), r["body"].encode(), hashlib.sha256).hexdigest() if secret else None)
