"""Text operators: guardrails, post parsing, mentions, narratives, claims."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.exprs import hmac_sha256, jaccard, nfkc
from tidewatch.sources.tables import shared_folder

#: Signs of an attempt to steer a reader of the text (fixed values).
INJECTION = [r"(?i)ignore\s+(all\s+)?previous\s+instructions", r"(?i)reveal\s+(the\s+)?(system|developer)\s+prompt", r"(?i)<\s*(system|assistant|tool)\s*>", r"(?i)jailbreak|prompt\s+injection"]
#: Words without content in claims (fixed values).
STOP_WORDS = ["about", "after", "from", "have", "that", "this", "with", "will"]
#: Words that negate a claim (fixed values).
NEGATIONS = ["no", "not", "never", "denies", "denied", "false", "without"]
TOKEN = r"([a-z0-9][a-z0-9_-]+)"
#: Words that name no narrative (fixed values).
NARRATIVE_STOP_WORDS = ["about", "after", "again", "asset", "from", "have", "into", "just", "more", "that", "this", "with", "will"]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def guard_text(rows: DataFrame, text: str = "text", most: int = 20_000) -> DataFrame:
    """Adds reasons (codes of what is wrong with a text) and risk."""
    t = F.coalesce(F.col(text), F.lit(""))
    injected = F.lit(False)
    for p in INJECTION:
        injected = injected | t.rlike(p)
    words = F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")
    repetitive = (F.size("__w") >= 50) & (F.size(F.array_distinct("__w")) / F.size("__w") < 0.08)
    codes = [("TEXT_TOO_LARGE", F.length(t) > most), ("PROMPT_INJECTION_PATTERN", injected), ("CONTROL_CHARACTERS", t.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")), ("REPETITIVE_CONTENT", repetitive)]
    df = rows.withColumn("__w", words)
    df = df.withColumn("reasons", F.array_compact(F.array(*(F.when(test, F.lit(k)) for k, test in codes)))).drop("__w")
    return df.withColumn("risk", F.least(F.lit(1.0), F.size("reasons") * 0.35))


def parse_posts(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds hashtags, cashtags (upper-cased), mentions and urls (without trailing punctuation), of the text in normal form KC."""
    rows = rows.withColumn("__nfkc", nfkc(F.col(text)))
    t = F.col("__nfkc")
    every = lambda p: F.regexp_extract_all(t, F.lit(p), F.lit(1))
    return rows.withColumns({
        "hashtags": F.transform(every(r"(?U)(?<!\w)#([A-Za-z][A-Za-z0-9_]{0,31})"), F.upper), "cashtags": F.transform(every(r"(?U)(?<!\w)\$([A-Za-z][A-Za-z0-9]{0,15})"), F.upper),
        "mentions": every(r"(?U)(?<!\w)@([A-Za-z0-9_]{1,32})"), "urls": F.transform(every(r"(?i)(https?://[^\s<>()]+)"), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")),
    }).drop("__nfkc")


def pseudonyms(rows: DataFrame, key: str, platform: str, author: str) -> DataFrame:
    """Replaces the author by a keyed pseudonym."""
    name = F.concat(F.lit("actor_"), F.substring(hmac_sha256(key, F.concat(F.lit(platform + ":"), F.col(author))), 1, 32))
    return rows.withColumn("actor", name).drop(author)


def mentions(posts: DataFrame, registry: DataFrame, text: str = "text") -> DataFrame:
    """registry: alias (one lower-case word), asset_id, ambiguous. A row for each bare mention: post_id, position of the
    word, alias, status, confidence, candidates. Words are joined with the registry by equality."""
    words = posts.select("post_id", F.posexplode(tokens(F.col(text))).alias("position", "alias"))
    known = registry.groupBy("alias").agg(F.sort_array(F.collect_set("asset_id")).alias("candidates"), F.max("ambiguous").alias("ambiguous"))
    found = words.join(known, "alias")  # broadcast by the size that Spark measures as it runs
    unsure = (F.size("candidates") > 1) | F.col("ambiguous")
    return found.select("post_id", "position", "alias", "candidates", F.when(unsure, "AMBIGUOUS").otherwise("RESOLVED").alias("status"), F.when(unsure, 0.4).otherwise(0.62).alias("confidence"))


def hash_embedding(rows: DataFrame, key: str, text: str = "text", size: int = 128) -> DataFrame:
    """Sparse hashed embedding: (key, index, value), L2-normalised per key."""
    h = F.sha2("token", 256)
    index = (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % size).cast("int")
    sign = F.when(F.conv(F.substring(h, 10, 1), 16, 10).cast("int") % 2 == 1, 1.0).otherwise(-1.0)
    each = rows.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    cells = each.select(key, index.alias("index"), (F.col("n") * sign * (1 + F.least(F.length("token"), F.lit(12)) / 12.0)).alias("v")).groupBy(key, "index").agg(F.sum("v").alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return cells.withColumn("value", F.col("v") / norm).where("abs(v) > 1e-12").select(key, "index", "value")


def labels(rows: DataFrame, group: str, text: str = "text", top: int = 4, shortest: int = 4) -> DataFrame:
    """Per group the most frequent words, ties by the word, joined by ' / '."""
    words = rows.select(group, F.explode(tokens(F.col(text))).alias("w")).where((F.length("w") >= shortest) & ~F.col("w").isin(NARRATIVE_STOP_WORDS))
    counted = words.groupBy(group, "w").agg(F.count(F.lit(1)).alias("n"))
    best = counted.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "w"))).where(F.col("r") <= top)
    return best.groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "w"))), lambda x: x.w), " / ").alias("label"))


def cluster(vectors: DataFrame, group: str, seed_similarity: float = 0.76, member_similarity: float = 0.68) -> DataFrame:
    """Greedy clustering within each group in the order of (epoch, post_id): of the clusters whose centroid and least similar
    member both allow it, a post joins that of the most similar centroid (ties by the seed's id); else it begins one.
    Groups are windows of one asset."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["epoch", "post_id"], kind="stable")
        x = np.array(pdf["vector"].tolist(), float)
        norm, ids = np.linalg.norm(x, axis=1, keepdims=True), pdf["post_id"].to_numpy()
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        groups: list[list[int]] = []
        sums = np.zeros((0, x.shape[1]))
        for i in range(len(x)):
            norms = np.linalg.norm(sums, axis=1)
            near = np.divide(sums @ x[i], norms, out=np.zeros(len(groups)), where=norms > 0)
            # Of the groups that both limits allow, that of the nearest centroid; of equal ones, that of the first seed.
            open_ = [k for k in np.flatnonzero(near >= seed_similarity).tolist() if (x[groups[k]] @ x[i]).min() >= member_similarity]
            if open_:
                k = min(open_, key=lambda k: (-near[k], ids[groups[k][0]]))
                groups[k].append(i)
                sums[k] += x[i]
            else:
                groups.append([i])
                sums = np.concatenate([sums, x[i : i + 1]])
        out = [(ids[i], ids[m[0]], len(m)) for m in groups for i in m]
        return pd.DataFrame(out, columns=["post_id", "seed_id", "members"])

    return vectors.groupBy(group).applyInPandas(run, "post_id long, seed_id long, members int")


def chunks(docs: DataFrame, key: str, text: str = "text", size: int = 1200) -> DataFrame:
    """Documents as chunks of whole non-blank lines, up to `size` characters unless a line is longer: (key, chunk, text,
    tokens). One pass over the lines of a text, kept as an array of chunks of which the last one grows."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, line: Column) -> Column:
        full = (acc["now"] != "") & (F.length(acc["now"]) + 1 + F.length(line) > size)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["now"] == ""), line).otherwise(F.concat(acc["now"], F.lit("\n"), line)).alias("now"),
        )

    folded = F.aggregate(lines, start, step, lambda acc: F.when(acc["now"] != "", F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]))
    out = docs.select(key, F.posexplode(folded).alias("chunk", "text"))
    return out.withColumn("tokens", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))


def claims(rows: DataFrame, key: str, text: str = "text", most: int = 5) -> DataFrame:
    """The first clauses of at least three tokens of each text: (key, n, claim_text, claim_type, polarity, amounts, content)."""
    clause = F.split(F.regexp_replace(F.col(text), r"(?i)(?<=[.!?])\s+|;|\s+(?:and|but|while)\s+", "\u0001"), "\u0001")
    clause = F.filter(F.transform(clause, F.trim), lambda c: F.size(tokens(c)) >= 3)
    parts = F.slice(F.when(F.size(clause) > 0, clause).otherwise(F.array(F.col(text))), 1, most)
    rows = rows.select(key, F.posexplode(parts).alias("n", "claim_text")).groupBy(key, "claim_text").agg(F.min("n").alias("n"))
    return canonical(rows.select(key, "n", "claim_text"), "claim_text")


def canonical(rows: DataFrame, text: str) -> DataFrame:
    """Adds claim_type, polarity, amounts and content tokens of a text."""
    t = F.col("__t")
    has = lambda *w: F.arrays_overlap(t, F.array(*(F.lit(x) for x in w)))
    kind = (
        F.when(has("contract", "award"), "CONTRACT_AWARD").when(has("promoter") & has("buy", "bought", "purchase"), "INSIDER_PURCHASE")
        .when(F.contains(F.array_join(t, " "), F.lit("earning")) | has("results"), "EARNINGS_FORECAST").when(has("listing"), "EXCHANGE_LISTING").when(has("partnership"), "PARTNERSHIP").otherwise("OTHER")
    )
    content = F.sort_array(F.filter(t, lambda w: ~w.isin(STOP_WORDS + NEGATIONS)))
    return rows.withColumn("__t", tokens(F.col(text))).withColumns({
        "claim_type": kind, "polarity": F.when(has(*NEGATIONS), "NEGATIVE").otherwise("POSITIVE"),
        "amounts": F.regexp_extract_all(F.array_join(t, " "), F.lit(r"\b(\d+(?:\.\d+)?)\b"), F.lit(1)), "content": content, "lexical": F.array_distinct(F.filter(t, lambda w: ~w.isin(STOP_WORDS))),
    }).drop("__t")


def similarity(claim: str, evidence: str) -> Column:
    """Of two canonical texts, whose columns have these prefixes."""
    c, e = (lambda n: F.col(f"{claim}{n}")), (lambda n: F.col(f"{evidence}{n}"))
    amount = F.when(F.size(c("amounts")) == 0, 1.0).otherwise(F.arrays_overlap(c("amounts"), e("amounts")).cast("double"))
    return 0.60 * jaccard(c("lexical"), e("lexical")) + 0.20 * (c("claim_type") == e("claim_type")).cast("double") + 0.10 * (c("polarity") == e("polarity")).cast("double") + 0.10 * amount


def compare(pairs: DataFrame, claims: DataFrame, claim: str, documents: DataFrame, document: str, text: str = "text") -> DataFrame:
    """pairs: claim, document and more. Adds similarity and conflicts; each text is brought into its canonical form once."""
    form = lambda rows, key, p: canonical(rows, text).select(key, *(F.col(c).alias(p + c) for c in ("lexical", "claim_type", "polarity", "amounts")))
    both = pairs.join(form(claims, claim, "c_"), claim).join(form(documents, document, "e_"), document)
    return both.select(*pairs.columns, similarity("c_", "e_").alias("similarity"), conflicts("c_", "e_").alias("conflicts"))


def conflicts(claim: str, evidence: str) -> Column:
    """Codes of how evidence contradicts a claim, both canonical texts with these prefixes: by polarity, or by amounts of
    both that have none in common."""
    c, e = (lambda n: F.col(f"{claim}{n}")), (lambda n: F.col(f"{evidence}{n}"))
    apart = (F.size(c("amounts")) > 0) & (F.size(e("amounts")) > 0) & ~F.arrays_overlap(c("amounts"), e("amounts"))
    return F.array_compact(F.array(F.when(c("polarity") != e("polarity"), F.lit("POLARITY_MISMATCH")), F.when(apart, F.lit("AMOUNT_MISMATCH"))))


def verdicts(claims: DataFrame, matches: DataFrame, key: str, coverage: DataFrame | None = None, threshold: float = 0.34) -> DataFrame:
    """claims: a row for each key; matches: key, score (similarity times reliability), reliability, before (available in time) and
    conflict, a row for each candidate; coverage: key and complete, whether all sources that were expected had come in.

    Each claim's result, in this order: contradicted by a match in time; supported in time; supported later; unknown, if the
    sources are incomplete; unsupported, if there were candidates; unknown. A claim is legitimate as far as the most reliable of
    its supports is, where it is supported in time, and not at all otherwise."""
    matching = F.col("score") >= threshold
    count = lambda test: F.count_if(matching & test)
    before, conflict = F.col("before"), F.col("conflict")
    found = matches.groupBy(key).agg(
        F.count(F.lit(1)).alias("candidates"), count(before & conflict).alias("conflicting"), count(before & ~conflict).alias("supporting"), count(~before).alias("after"),
        F.max(F.when(matching & before & ~conflict, F.col("reliability"))).alias("support"),
    )
    rows = claims.join(found, key, "left").na.fill(0, ["candidates", "conflicting", "supporting", "after"])
    complete = F.lit(True)
    if coverage is not None:
        rows, complete = rows.join(coverage.select(key, F.col("complete").alias("__complete")), key, "left"), F.coalesce("__complete", F.lit(True))
    n = lambda c: F.col(c) > 0
    result = F.when(n("conflicting"), "CONFLICTING").when(n("supporting"), "SUPPORTED_BEFORE").when(n("after"), "SUPPORTED_AFTER").when(~complete, "UNKNOWN").when(n("candidates"), "UNSUPPORTED").otherwise("UNKNOWN")
    rows = rows.withColumn("result", result)
    risk = F.element_at(F.create_map(*(F.lit(x) for p in RISKS.items() for x in p)), F.col("result"))
    legitimate = F.when(F.col("result") == "SUPPORTED_BEFORE", F.col("support")).otherwise(0.0)
    return rows.withColumns({"claim_risk": risk, "legitimate": legitimate}).drop("support", "__complete")


#: The risk of a claim by its result (fixed values).
RISKS = {"CONFLICTING": 1.0, "SUPPORTED_BEFORE": 0.15, "SUPPORTED_AFTER": 0.75, "UNKNOWN": 0.50, "UNSUPPORTED": 0.90}
#: Results of claims, the worst first (fixed values).
WORST = ["CONFLICTING", "UNSUPPORTED", "SUPPORTED_AFTER", "UNKNOWN", "SUPPORTED_BEFORE"]


def narrative_verdicts(verdicts: DataFrame, key: str) -> DataFrame:
    """Per narrative: the worst result of its claims, their largest risk and legitimacy, and how many they are."""
    place = F.array_position(F.array(*(F.lit(x) for x in WORST)), F.col("result"))
    return verdicts.groupBy(key).agg(F.min_by("result", place).alias("result"), F.max("claim_risk").alias("claim_risk"), F.max("legitimate").alias("legitimate"), F.count(F.lit(1)).alias("claims"))


#: Kinds of mentions, the surer first; words near a bare name that speak of a market (fixed values).
KINDS = {"CASHTAG": 0.98, "HASHTAG": 0.82, "BARE": 0.62}
MARKET_WORDS = [" STOCK", " TOKEN", " COIN", " CRYPTO", " SHARES"]
AROUND = 24


def alias_table(assets: DataFrame, ambiguous: list[str] = ()) -> DataFrame:
    """assets: asset_id, symbol, name. A row for each alias (the symbol, and the name in normal form KC where it differs, both
    upper-cased) and asset: alias, asset_id, ambiguous."""
    symbol = F.upper("symbol")
    unsure = F.upper("symbol").isin([x.upper() for x in ambiguous]) if ambiguous else F.lit(False)
    rows = assets.select("asset_id", symbol.alias("symbol"), F.upper(F.trim(nfkc(F.col("name")))).alias("name"), unsure.alias("ambiguous"))
    names = rows.where("name <> '' and name <> symbol").select(F.col("name").alias("alias"), "asset_id", "ambiguous")
    return rows.select(F.col("symbol").alias("alias"), "asset_id", "ambiguous").unionByName(names)


def upper_in_place(text: str) -> str:
    """Upper case that keeps every character at its place."""
    up = text.upper()
    return up if len(up) == len(text) else "".join(u if len(u := c.upper()) == 1 else c for c in text)


TAGS = {"CASHTAG": re.compile(r"(?<!\w)\$([A-Za-z][A-Za-z0-9]{0,15})"), "HASHTAG": re.compile(r"(?<!\w)#([A-Za-z][A-Za-z0-9_]{0,31})")}
RUN = re.compile(r"(?<![\w$#])(\w+|[^\w\s$#])")


#: Buckets of first words by their hash: as many numbers, at most, go to each task, whatever the number of aliases.
BUCKETS = 1 << 18
#: Places that a task hands on at once, and their characters.
HELD, HELD_CHARACTERS = 4096, 1 << 22


def pieces(places: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Places, whose text is last, in lists of bounded size."""
    out, n = [], 0
    for place in places:
        out.append(place)
        n += len(place[-1])
        if len(out) == HELD or n >= HELD_CHARACTERS:
            yield out
            out, n = [], 0
    if out:
        yield out


def resolve_mentions(posts: DataFrame, aliases: DataFrame, text: str = "text") -> DataFrame:
    """posts: post_id and a text; aliases: alias_table's. A row for each cashtag, hashtag and bare alias of several words or
    one: post_id, start, stop, mention_text, kind, asset_id, status, confidence, candidates and reason; offsets are
    those of the text in normal form KC. Aliases may be of any length.

    The places where an alias may begin are joined with the aliases by their first word, an equality; a hot word is
    spread by the measured skew of that join. Whether the whole alias is there is then a comparison of strings. Words whose
    bucket has no alias are passed over before the join, and a place takes along no more text than its bucket's longest alias
    needs. A task holds one text and a bounded number of places at a time.
    """

    shared_folder(posts.sparkSession)
    aliases = aliases.checkpoint()  # read three times
    first = F.regexp_extract("alias", r"(?U)^(\w+|\W)", 1)
    buckets = aliases.where("alias is not null").groupBy((F.crc32(first) % BUCKETS).alias("bucket")).agg(F.max(F.length("alias")).alias("n")).collect()
    reach = np.zeros(BUCKETS, np.int32)
    for r in buckets:
        reach[r["bucket"]] = r["n"]
    kinds = (pa.int32(), pa.int32(), *(pa.string(),) * 5)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = ((b.column(0)[i].as_py(), b.column(1)[i].as_py() or "") for i in range(b.num_rows))
            for out in pieces(place for post, t in rows for place in of_text(post, t if t.isascii() else unicodedata.normalize("NFKC", t))):
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (b.schema.field(0).type, *kinds), strict=True)], names=["post_id", "start", "stop", "said", "kind", "word", "plain", "around"])

    def of_text(post: object, t: str) -> Iterator[tuple]:
        up = upper_in_place(t)
        for kind, pattern in TAGS.items():
            for m in pattern.finditer(t):
                yield post, m.start(), m.end(), m[0], kind, m[1].upper(), None, up[max(0, m.start() - AROUND) : m.end() + AROUND]
        for m in RUN.finditer(up):
            if longest := int(reach[zlib.crc32(m[1].encode()) % BUCKETS]):
                s = m.start()
                yield post, s, None, None, "BARE", m[1], t[s : s + longest], up[max(0, s - AROUND) : s + longest + AROUND]

    key = posts.schema["post_id"].dataType.simpleString()
    found = posts.select("post_id", text).mapInArrow(places, f"post_id {key}, start int, stop int, said string, kind string, word string, plain string, around string")
    known = aliases.groupBy("alias").agg(F.sort_array(F.collect_set("asset_id")).alias("candidates"), F.max("ambiguous").alias("unsure"))
    # Tags ask for an alias, other places for its first word: one join, so that the texts are read once.
    asked = known.select(F.lit(True).alias("tag"), F.col("alias").alias("word"), "*").unionByName(known.select(F.lit(False).alias("tag"), first.alias("word"), "*"))
    rows = found.withColumn("tag", F.col("kind") != "BARE").join(asked, ["tag", "word"], "left")
    n, before = F.length("alias"), F.least("start", F.lit(AROUND))
    whole = (F.col("around").substr(before + 1, n) == F.col("alias")) & ~F.col("around").substr(before + n + 1, F.lit(1)).rlike(r"(?U)^\w")
    own = lambda of_tag, of_bare: F.when(F.col("tag"), of_tag).otherwise(of_bare)
    rows = rows.where(F.col("tag") | whole).select(
        "post_id", "start", own(F.col("stop"), (F.col("start") + n).cast("int")).alias("stop"), own(F.col("said"), F.substring(F.col("plain"), F.lit(1), n)).alias("mention_text"), "kind", "candidates", "unsure",
        own(F.col("around"), F.col("around").substr(F.lit(1), before + n + AROUND)).alias("around"),
    )
    market = F.lit(False)
    for w in MARKET_WORDS:
        market = market | F.col("around").contains(w)
    several, tag = F.size("candidates") > 1, F.col("kind") == "CASHTAG"
    rows = rows.withColumns({"market": market, "several": F.coalesce(several, F.lit(False))})
    vague = (F.col("several") | F.col("unsure")) & ~tag & ~(F.col("market") & ~F.col("several"))
    case = F.when(F.col("candidates").isNull(), 0).when(vague, 1).when(F.col("several"), 2).otherwise(3)
    rows = rows.withColumn("case", case)
    sure = F.when(F.col("market") & (F.col("kind") == "BARE"), 0.88).otherwise(F.element_at(F.create_map(*(F.lit(x) for p in KINDS.items() for x in p)), F.col("kind")))
    is_ = lambda k: F.col("case") == k
    return rows.select(
        "post_id", "start", "stop", "mention_text", "kind", F.when(is_(3), F.get("candidates", F.lit(0))).alias("asset_id"),
        F.when(is_(0), "UNRESOLVED").when(is_(3), "RESOLVED").otherwise("AMBIGUOUS").alias("status"),
        F.when(is_(0), 0.0).when(is_(1), F.when(F.col("kind") == "BARE", 0.4).otherwise(0.6)).when(is_(2), 0.7).otherwise(sure).alias("confidence"),
        F.coalesce("candidates", F.expr("cast(array() as array<string>)")).alias("candidates"),
        F.when(is_(0), "ALIAS_NOT_IN_REGISTRY").when(is_(1), "AMBIGUOUS_ALIAS_WITHOUT_MARKET_CONTEXT").when(is_(2), "MULTIPLE_EXACT_CANDIDATES").when(tag, "EXACT_CASHTAG").when(F.col("market"), "MARKET_CONTEXT_ALIAS").otherwise("UNIQUE_REGISTRY_ALIAS").alias("reason"),
    )


def asset_mentions(mentions: DataFrame, posts: DataFrame, asset: str, most: int = 100) -> DataFrame:
    """Resolved mentions of an asset with their posts' times, the newest first."""
    return mentions.where(F.col("asset_id") == asset).join(posts.select("post_id", "event_time"), "post_id").orderBy(F.desc("event_time"), "post_id", "start").limit(most)
