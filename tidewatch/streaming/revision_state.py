"""Revisions of all features without a stored signal read again: partial aggregates of windows as state."""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators import windows

HISTORY = 20
SERIES = ("MARKET_TRADE", "MARKET_CANDLE")
BOOK = ("spread", "top_n_depth", "imbalance")
#: What a row of the log holds besides its key: the aggregates that windows.finished turns into features.
PARTIALS = (
    "revision int, state string, supersedes int, " + "".join(f"{k}_first double, {k}_last double, {k}_n long, {k}_dev double, {k}_steps long, " for k in SERIES)
    + "spread double, top_n_depth double, orderbook_imbalance double, orderbook_valid int, buys double, sells double, market_last double, market_first double, social_last double, social_first double, "
    "mentions long, posts long, reposts long, tags long, gaps double, source_event_count long, min_event_time double, max_event_time double, authors long, author_share double, new_authors long, url_share double, "
    "volume double, baseline double, earlier int, market_active boolean, market_idle boolean, market_degraded boolean, social_active boolean, social_idle boolean, social_degraded boolean"
)
NAMES = [c.split()[0] for c in PARTIALS.split(", ")]
INPUT = (
    "event_id source_domain kind price quantity side close volume baseline_volume spread top_n_depth imbalance book_valid author_id repost_of reply_to source_gap_count source_active source_idle source_degraded".split()
)


def number(x, default: float = 0.0) -> float:
    return default if x is None or pd.isna(x) else float(x)


def empty() -> dict:
    """A window of no rows: series by kind, sums, bounds, and the last quality row and other row of each domain (own), and what is
    known of them from all windows up to this one (known)."""
    return {
        **{k: [] for k in SERIES}, "traded": 0.0, "candled": 0.0, "given": [0.0, 0], "books": 0, "valid": 0, **{c: 0.0 for c in BOOK}, "buys": 0.0, "sells": 0.0, "market": None, "social": None, "mentions": 0, "posts": 0,
        "reposts": 0, "tags": 0, "gaps": None, "n": 0, "bounds": None, "authors": 0, "authored": 0, "most_author": 0, "new": 0, "urls": 0, "most_url": 0, "own": {}, "known": {}, "revision": 0, "state": None, "seen": None,
    }


def widened(bounds: list | None, t: float) -> list:
    return [t, t] if bounds is None else [min(bounds[0], t), max(bounds[1], t)]


def volume(w: dict) -> float:
    return w["traded"] if w["traded"] != 0 else w["candled"]


def add(w: dict, x: dict, t: float) -> None:
    """One signal more; authors and urls apart, whose counts are states of their own."""
    kind, order = x["kind"], [t, x["event_id"]]
    w["n"] += 1
    w["bounds"] = widened(w["bounds"], t)
    if kind in SERIES:
        bisect.insort(w[kind], [*order, number(x["price"] if kind == "MARKET_TRADE" else x["close"])])
    if kind == "MARKET_TRADE":
        quantity = number(x["quantity"])
        w["traded"] += quantity * number(x["price"], 1.0)
        w["buys"] += quantity if x["side"] == "BUY" else 0.0
        w["sells"] += quantity if x["side"] == "SELL" else 0.0
    if kind == "MARKET_CANDLE":
        w["candled"] += number(x["volume"])
    if number(x["baseline_volume"]) > 0:
        w["given"] = [w["given"][0] + number(x["baseline_volume"]), w["given"][1] + 1]
    if kind == "ORDERBOOK":
        w["books"] += 1
        if x["book_valid"] is None or pd.isna(x["book_valid"]) or x["book_valid"]:
            w["valid"] += 1
            for c in BOOK:
                w[c] += number(x[c])
    if kind in ("MARKET_TRADE", "MARKET_CANDLE", "ORDERBOOK"):
        w["market"] = widened(w["market"], t)
    if kind in ("SOCIAL_POST", "ASSET_MENTION"):
        w["social"] = widened(w["social"], t)
    w["mentions"] += kind == "ASSET_MENTION"
    if kind == "SOCIAL_POST":
        w["posts"] += 1
        w["reposts"] += not (pd.isna(x["repost_of"]) and pd.isna(x["reply_to"]))
        w["tags"] += int(x["n_tags"])
    if kind == "DATA_QUALITY":
        w["gaps"] = max(number(w["gaps"]), number(x["source_gap_count"]))
    if x["source_domain"] in windows.DOMAINS:
        last = w["own"].setdefault(x["source_domain"], [None, None])
        place = 0 if kind == "DATA_QUALITY" else 1
        if last[place] is None or order > last[place][:2]:
            flags = [None if pd.isna(x[c]) else bool(x[c]) for c in ("source_active", "source_idle", "source_degraded")] if place == 0 else []
            last[place] = [*order, *flags]


def carried(before: dict, own: dict) -> dict:
    """What is known at the end of a window: its own last rows, or else those of the windows before."""
    out = {}
    for d in {*before, *own}:
        a, b = before.get(d, [None, None]), own.get(d, [None, None])
        out[d] = [b[i] if b[i] is not None else a[i] for i in (0, 1)]
    return out


def source(known: dict, domain: str) -> tuple[bool, bool, bool]:
    """Whether a domain is active, idle and degraded."""
    quality, other = known.get(domain, [None, None])
    later = other is not None and (quality is None or other[:2] > quality[:2])
    flags = quality[2:] if quality else [None, None, None]
    return True if later else bool(flags[0]), False if later else bool(flags[1]), flags[2] if flags[2] is not None else not later


def partials(w: dict, baseline: float, earlier: int) -> list:
    """The columns of PARTIALS from FEATURES' aggregates on."""
    out = []
    for k in SERIES:
        prices = [p for _, _, p in w[k]]
        steps = [b / a - 1 for a, b in zip(prices, prices[1:], strict=False) if a != 0]
        out += [prices[0], prices[-1], len(prices), float(np.std(steps)) if steps else None, len(steps)] if prices else [None, None, 0, None, 0]
    valid = w["valid"]
    out += [w[c] / valid if valid else None for c in BOOK] + [(1 if valid else 0) if w["books"] else None, w["buys"], w["sells"]]
    for d in windows.DOMAINS:
        out += [w[d][1], w[d][0]] if w[d] else [None, None]
    out += [w["mentions"], w["posts"], w["reposts"], w["tags"], w["gaps"], w["n"], *w["bounds"]]
    out += [w["authors"], w["most_author"] / w["authored"], w["new"]] if w["authored"] else [None, None, None]
    out += [w["most_url"] / w["urls"] if w["urls"] else None, volume(w), baseline, earlier]
    return out + [x for d in windows.DOMAINS for x in source(w["known"], d)]


class FeatureRevisions(StatefulProcessor):
    """The windows of one asset and interval. A row changes the aggregates of its own window; the windows after it are gone through,
    by their small states, as far as their baselines (20 windows) or source states may rest on it. Where an author was first seen, the
    author is new in that window only. Those that changed are put out with their next revision; windows that the asset's own
    watermark has passed become FINAL, and a change after that is CORRECTED.

    State: for each window its aggregates (prices in order, for the volatility, and no other row), counts of its authors and urls,
    and the ids of rows that have come; the list of windows and their volumes."""

    def __init__(self, lateness: int, idle_after: int):
        self.lateness, self.idle_after = lateness, idle_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.windows = handle.getMapState("windows", "window_start long", "body string")
        self.line = handle.getValueState("line", "starts array<long>, volumes array<double>, open array<long>")
        self.ids = handle.getMapState("ids", "event_id string", "there boolean")
        self.authors = handle.getMapState("authors", "window_start long, author string", "n long")
        self.first = handle.getMapState("first", "author string", "t double")
        self.urls = handle.getMapState("urls", "window_start long, url string", "n long")
        self.latest = handle.getMapState("latest", "domain string", "t double, quality_t double, quality_id string, degraded boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        interval = int(key[2])
        self.held: dict[int, dict] = {}
        starts, volumes, open_ = (list(x) for x in self.line.get()) if self.line.exists() else ([], [], [])
        touched, inserted = set(), set()
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["arrival", "event_id"]).drop_duplicates("event_id")
        for x in batch.to_dict("records"):
            if self.ids.containsKey((x["event_id"],)):
                continue
            self.ids.updateValue((x["event_id"],), (True,))
            t, start = float(x["t"]), int(x["window_start"])
            at = bisect.bisect_left(starts, start)
            if at == len(starts) or starts[at] != start:
                starts.insert(at, start), volumes.insert(at, 0.0), bisect.insort(open_, start)
                self.held[start] = empty()
                inserted.add(start)
            w = self.window(start)
            add(w, x, t)
            if x["kind"] == "SOCIAL_POST":
                touched |= self.wrote(w, start, x, t, interval)
            volumes[at] = volume(w)
            touched.add(start)
            self.saw(x, t)
        if not touched:
            return
        mark, out = self.watermark(), []
        at, reach = bisect.bisect_left(starts, min(touched)), bisect.bisect_left(starts, max(touched)) + HISTORY
        known = self.window(starts[at - 1])["known"] if at else {}
        done = set()
        while at < len(starts):
            start = starts[at]
            w, new = self.window(start), carried(known, self.window(start)["own"])
            same = new == w["known"] and start not in touched
            if at > reach and same:
                break  # neither baselines nor states reach on
            w["known"] = known = new
            positive = [v for v in volumes[max(0, at - HISTORY) : at] if v > 0]
            baseline = w["given"][0] / w["given"][1] if w["given"][1] else sum(positive) / len(positive) if positive else volumes[at]
            self.revise(w, start, interval, start in touched, baseline, at, mark, out)
            done.add(start)
            at += 1
        # Windows before, which nothing changed, may have become final.
        for start in [s for s in open_ if s not in done and mark is not None and s + interval <= mark]:
            w, i = self.window(start), bisect.bisect_left(starts, start)
            self.revise(w, start, interval, False, w["seen"][0], i, mark, out)
        open_ = [s for s in open_ if s not in self.held or self.held[s]["state"] == "PROVISIONAL"]
        for start, w in self.held.items():
            self.windows.updateValue((start,), (json.dumps(w),))
        self.line.update((starts, volumes, open_))
        if out:
            frame = pd.DataFrame([(*key, *r) for r in sorted(out)], columns=[*windows.KEY, *NAMES])
            whole = {c.split()[0]: "Int64" if c.endswith("long") else "Int32" for c in PARTIALS.split(", ") if c.endswith((" int", " long"))}
            yield frame.astype(whole)

    def window(self, start: int) -> dict:
        if start not in self.held:
            self.held[start] = json.loads(self.windows.getValue((start,))[0])
        return self.held[start]

    def wrote(self, w: dict, start: int, x: dict, t: float, interval: int) -> set[int]:
        """Authors and urls of a post; returns another window that lost a new author."""
        lost = set()
        author = x["author_id"]
        if not pd.isna(author):
            n = self.counted(self.authors, (start, author))
            w["authors"], w["authored"], w["most_author"] = w["authors"] + (n == 1), w["authored"] + 1, max(w["most_author"], n)
            before = self.first.getValue((author,))[0] if self.first.containsKey((author,)) else None
            if before is None or t < before:
                self.first.updateValue((author,), (t,))
                held = None if before is None else int(before // interval * interval)
                if held != start:
                    w["new"] += 1
                    if held is not None:
                        self.window(held)["new"] -= 1
                        lost.add(held)
        for url in x["urls"] if x["urls"] is not None else []:
            n = self.counted(self.urls, (start, url))
            w["urls"], w["most_url"] = w["urls"] + 1, max(w["most_url"], n)
        return lost

    @staticmethod
    def counted(state, key: tuple) -> int:
        n = (state.getValue(key)[0] if state.containsKey(key) else 0) + 1
        state.updateValue(key, (n,))
        return n

    def saw(self, x: dict, t: float) -> None:
        d = (x["source_domain"],)
        last, qt, qi, bad = self.latest.getValue(d) if self.latest.containsKey(d) else (t, None, None, None)
        if x["kind"] == "DATA_QUALITY" and (qt is None or (t, x["event_id"]) > (qt, qi)):
            qt, qi, bad = t, x["event_id"], None if pd.isna(x["source_degraded"]) else bool(x["source_degraded"])
        self.latest.updateValue(d, (max(last, t), qt, qi, bad))

    def watermark(self) -> float | None:
        """The least of the domains' own watermarks; none while one is unseen or degraded."""
        last = {k[0]: v for k, v in self.latest.iterator()}
        newest, marks = max(v[0] for v in last.values()), []
        for d in windows.DOMAINS:
            if d not in last or last[d][3]:
                return None
            marks.append((newest if newest - last[d][0] >= self.idle_after else last[d][0]) - self.lateness)
        return min(marks)

    def revise(self, w: dict, start: int, interval: int, touched: bool, baseline: float, earlier: int, mark: float | None, out: list) -> None:
        """The window's next revision, if its features differ from those of the last one or it has become final."""
        v = volume(w)
        rests = [baseline, v / baseline if baseline else 0.0, min(earlier, HISTORY), *(x for d in windows.DOMAINS for x in source(w["known"], d))]
        same = not touched and w["seen"] is not None and w["seen"][1:] == rests[1:]
        passed, closed = mark is not None and start + interval <= mark, w["state"] in ("FINAL", "CORRECTED")
        state = (None if same else "CORRECTED") if closed else "FINAL" if passed else None if same else "PROVISIONAL"
        w["seen"] = rests
        if state is None:
            return
        supersedes = w["revision"] or None if state != "PROVISIONAL" else None
        w["revision"], w["state"] = w["revision"] + 1, state
        out.append((start, w["revision"], state, supersedes, *partials(w, baseline, earlier)))

    def close(self) -> None:
        pass


def feature_revisions(stream: DataFrame, intervals: list[int], lateness: int = 120, idle_after: int = 300) -> DataFrame:
    """The revision log of all features of a stream of signals, each batch's late rows included. Needs the RocksDB state store."""
    rows = windows.assign(stream, intervals)
    tags = F.coalesce(F.size("hashtags"), F.lit(0))
    given = rows.select("scope_id", "asset_id", "interval_seconds", "window_start", "t", windows.seconds("ingested_at").alias("arrival"), tags.alias("n_tags"), "urls", *INPUT)
    log = given.groupBy("scope_id", "asset_id", "interval_seconds").transformWithStateInPandas(FeatureRevisions(lateness, idle_after), f"scope_id string, asset_id string, interval_seconds int, window_start long, {PARTIALS}", "Append", "None")
    return finished(log)


def finished(log: DataFrame) -> DataFrame:
    """Rows of the log with the features that their aggregates give."""
    flags = ("active", "idle", "degraded")
    states = log.withColumns({d: F.struct(*(F.col(f"{d}_{c}").alias(c) for c in flags)) for d in windows.DOMAINS})
    whole = [*windows.KEY, "revision", "state", "supersedes"]
    # The features' own function keeps its columns alone: the revision goes along with the count of rows.
    tagged = states.withColumn("source_event_count", F.struct("source_event_count", "revision", "state", "supersedes"))
    out = windows.finished(tagged)
    return out.withColumns({c: F.col(f"source_event_count.{c}") for c in whole[4:]}).withColumn("source_event_count", F.col("source_event_count.source_event_count"))
