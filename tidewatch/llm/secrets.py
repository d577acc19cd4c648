"""Secret scan with corpus-wide ownership frequency."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._common import attach, cut

#: Kinds in the order in which spans with one start are listed. The last is what the ownership count adds.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that are long enough
#: What may be a credential without any word before it.
BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|your|xxxx|1234567|abcdef", re.IGNORECASE)

SPAN = "struct<start:int,kind:int,stop:int,value_hash:string,live_looking:boolean,covered:boolean>"
FINDING = "struct<start:int,kind:int,stop:int,value_hash:string,live_looking:boolean,n_repos:bigint,n_owners:bigint,verdict:string>"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def live_looking(value: str) -> bool:
    """Random enough, with letters and digits, and no placeholder."""
    return entropy(value) >= 3.0 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and not PLACEHOLDER.search(value)


def find(text: str | None) -> list[dict]:
    """Every candidate of one text: base spans of the three patterns, and bare tokens that look live, and whether a base span touches these."""
    text = text or ""
    found = []

    def add(kind: int, start: int, stop: int, value: str, keep: bool, covered: bool = False) -> None:
        live = live_looking(value)
        if keep or live:
            found.append({"start": start, "kind": kind, "stop": stop, "value_hash": hashlib.sha256(value.encode("utf-8", "replace")).hexdigest(), "live_looking": live, "covered": covered})

    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            add(0, m.start(), m.end(), m[2], True)
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= 20:
            add(1, m.start(), m.end(), m[0], True)
    for m in HEX.finditer(text):
        add(2, m.start(), m.end(), m[0], True)
    base = sorted((x["start"], x["stop"]) for x in found)
    at, reach = 0, 0  # base spans that begin before the token ends, and how far they reach: one sweep of both
    for m in BARE.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            at, reach = at + 1, max(reach, base[at][1])
        add(3, m.start(), m.end(), m[0], False, reach > m.start())
    found.sort(key=lambda x: (x["start"], x["kind"]))
    return found


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = 2, max_repos: int = 4) -> DataFrame:
    """One row for each row of docs: its id and `findings`, an array of FINDING by start, then kind.

    A finding of the three base kinds always stays. The value's SHA-256 is counted over the whole corpus by distinct
    owners (owner_col) and repositories (repo_cols together): more than max_owners or max_repos make it "example", a
    widely copied string; else it is "live" if it looks random, or "weak". Bare tokens (kind "owned") stay only if
    "live", and only where no base finding covers them.

    Defined cases: a null or empty text has no findings; a null owner or repository counts as one unnamed one; repeated
    rows and null ids give a row each (copies of one row add no owner); an empty table gives no rows. Other columns
    of docs, whatever their names, are ignored. Texts are scanned whole.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find(t) for t in b.column(4).to_pylist()]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("value_hash", pa.string()), ("live_looking", pa.bool_()), ("covered", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(found, kind)], names=["row_id", "id", "owner", "repo", "found"])

    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(id_col).alias("id"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols)).alias("repo"),
        F.col(text_col).cast("string").alias("text"),
    )
    id_type = rows.schema["id"].dataType.simpleString()
    scanned = cut(rows.mapInArrow(scan, f"row_id bigint, id {id_type}, owner string, repo string, found array<{SPAN}>"))
    each = scanned.select("row_id", "owner", "repo", F.explode("found").alias("f")).select("row_id", "owner", "repo", "f.*")
    seen = each.groupBy("value_hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(seen.groupBy("value_hash").agg(F.countDistinct("owner").alias("n_owners"), F.countDistinct("repo").alias("n_repos"), F.sum("n").alias("n")))
    judged = attach(each, counts, "value_hash", "n", counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    verdict = F.when((F.col("n_owners") > max_owners) | (F.col("n_repos") > max_repos), "example").when(F.col("live_looking"), "live").otherwise("weak")
    kept = judged.withColumn("verdict", verdict).where("kind < 3 or (verdict = 'live' and not covered)")
    per_row = kept.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "stop", "value_hash", "live_looking", "n_repos", "n_owners", "verdict"))).alias("all"))
    joined = scanned.select("row_id", "id").join(per_row, "row_id", "left")
    return joined.select(F.col("id").alias(id_col), F.coalesce("all", F.expr(f"cast(array() as array<{FINDING}>)")).alias("findings"))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The findings of scan_secrets as counts and strings."""
    name = F.array(*(F.lit(k) for k in KINDS))

    def text(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x.kind), x.start.cast("string"), x.stop.cast("string"))), ",")

    base = F.filter("findings", lambda x: x.kind < 3)

    def count(test: str):
        return F.expr(f"cast(size(filter(findings, x -> {test})) as bigint)")

    return scanned.select(
        id_col,
        *(count(f"x.kind = {k}").alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("findings")).alias("spans"),
        count("x.verdict = 'live'").alias("n_live"),
        count("x.verdict = 'example'").alias("n_example"),
    )
