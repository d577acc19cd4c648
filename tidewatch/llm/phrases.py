"""Substring dedup by repeated-phrase automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._common import WORD_SQL, written

#: A null document id sorts before all others.
NO_ID = -(1 << 63)
MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Segments, or bytes of them, that one automaton is compiled from and streams at a time; whole groups of one anchor and salt.
CHUNK, CHUNK_BYTES = 4000, 1 << 20
#: Windows in a segment at most.
PIECE = 128


class Hashes(dict):
    """The hash of a word, remembered for up to `most` words."""

    def __init__(self, most: int = 300_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def rolling(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words."""
    out = np.zeros(len(word_hashes) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ word_hashes[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out * MIX


def anchors(words: list[bytes], known: Hashes, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(phrase hash, first window, last window, times) of each anchor of a document. The anchor of a window is the least
    phrase hash in it: windows of equal words have equal anchors. Windows in a row with one anchor are one entry, of
    PIECE windows at most. times is 2 where the phrase is there more than once in the entry: then its windows may be
    repeats of each other."""
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int8)
    h = rolling(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), phrase)
    n = len(words) - window + 1
    least = h[:n].copy()
    for i in range(1, window - phrase + 1):
        np.minimum(least, h[i : i + n], out=least)
    places = np.zeros(n, np.int8)
    for i in range(window - phrase + 1):
        places += h[i : i + n] == least
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    size = np.diff(np.append(first, n))
    times = 1 + ((size > window - phrase + 1) | (np.maximum.reduceat(places, first) > 1)).astype(np.int8)
    if size.max() > PIECE:
        pieces = -(-size // PIECE)
        times = np.repeat(times, pieces)
        first = np.repeat(first, pieces) + PIECE * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    last = np.append(first[1:], n) - 1
    return least[first].view(np.int64), first.astype(np.int32), last.astype(np.int32), times


def runs(starts: list[int]) -> list[tuple[int, int]]:
    """Sorted numbers as (first, count) of their runs."""
    out: list[list[int]] = []
    for s in starts:
        if out and out[-1][0] + out[-1][1] == s:
            out[-1][1] += 1
        else:
            out.append([s, 1])
    return [(a, b) for a, b in out]


def confirmed(keys: list[list[bytes]], times: list[int]) -> set[bytes]:
    """The windows that recur, by their words: keys holds those of each different segment, times how often it is there."""
    count: dict[bytes, int] = {}
    for own, n in zip(keys, times, strict=True):
        for w in own:
            count[w] = count.get(w, 0) + n
    return {w for w, n in count.items() if n > 1}


def compiled(sequences: list[tuple[int, ...]], keys: list[list[bytes]], recurring: set[bytes], window: int) -> tuple[ahocorasick.Automaton, list[list[int]]]:
    """An Aho-Corasick automaton over word numbers of the recurring passages, the longest runs of recurring windows, and for
    each passage the numbers of its windows."""
    automaton, passages, number = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), [], {}
    for q, own in zip(sequences, keys, strict=True):
        for a, n in runs([i for i, w in enumerate(own) if w in recurring]):
            automaton.add_word(q[a : a + n + window - 1], len(passages))
            passages.append([number.setdefault(w, len(number)) for w in own[a : a + n]])
    if len(automaton):
        automaton.make_automaton()
    return automaton, passages


def located(automaton: ahocorasick.Automaton, passages: list[list[int]], q: tuple[int, ...], window: int) -> dict[int, int]:
    """Every occurrence in a segment: the number of the recurring window at each place where the automaton finds one."""
    found: dict[int, int] = {}
    if not len(automaton):
        return found
    before, low, high = -1, 0, 0  # low to high: the last places found in a row
    for stop, p in automaton.iter(q):
        if stop == before:  # a shorter passage, with the same end
            continue
        before, own = stop, passages[p]
        begin, end = stop - len(own) - window + 2, stop - window + 2
        if begin > high:
            low = high = begin
        for i in range(begin, low):
            found[i] = own[i - begin]
        for i in range(high, end):
            found[i] = own[i - begin]
        low, high = min(low, begin), end
    return found


def repeated(segments: list[tuple], window: int, emit_first: bool) -> Iterator[tuple]:
    """segments: (anchor, doc, first window, words as bytes) by anchor, doc and window, whole anchors. Yields for each
    segment (doc, starts of its windows that also start earlier, [(window, start)] of windows that don't, if asked for).

    The recurring windows are confirmed by their words, the passages of them compiled, and all segments streamed through the
    automaton: only what it finds there is an occurrence."""
    number: dict[bytes, int] = {}
    same: dict[bytes, int] = {}
    of, words, sequences, keys, times = [], [], [], [], []
    for s in segments:
        k = same.setdefault(s[3], len(same))
        of.append(k)
        if k < len(times):
            times[k] += 1
            continue
        ws = s[3].split()
        q = tuple([number.setdefault(w, len(number)) for w in ws])
        packed = np.array(q, np.int32).tobytes()
        words.append(ws)
        sequences.append(q)
        keys.append([packed[4 * i : 4 * (i + window)] for i in range(len(q) - window + 1)])
        times.append(1)
    automaton, passages = compiled(sequences, keys, confirmed(keys, times), window)
    places = [located(automaton, passages, q, window) for q in sequences]
    seen: dict[int, tuple] = {}
    for (_, doc, first, _), k in zip(segments, of, strict=True):
        late, new = [], []
        for i in sorted(places[k]):
            here = (doc, first + i)
            if seen.setdefault(places[k][i], here) != here:
                late.append(first + i)
        if emit_first:
            gone = set(late)
            new = [(b" ".join(words[k][i : i + window]), first + i) for i in range(len(sequences[k]) - window + 1) if first + i not in gone]
        yield doc, late, new


def packed_texts(docs: DataFrame) -> DataFrame:
    """(id, tie, packed): the texts compressed, for the shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3)
        for b in batches:
            packed = [small.compress(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(packed, pa.binary())], names=["id", "tie", "packed"])

    return docs.select("id", "text", "tie").mapInArrow(run, "id long, tie long, packed binary")


def repeated_windows(docs: DataFrame, window: int = 20, phrase: int = 6, salt_rows: int = 2000, shard_rows: int = 200_000) -> DataFrame:
    """docs: (id long, text, tie long). (id, tie, runs): the runs (first window, count) of windows whose words also start
    earlier. A document is known by id and tie together.

    1. Anchors: each document names the anchor phrases of its windows (about one word in seven begins one).
    2. Phrases that occur once, in all, can't belong to a repeated window; the others are confirmed by one count.
    3. Only what lies around recurring anchors is cut out of the texts and dealt to the automata's shards by anchor.
       An anchor with the text of over salt_rows segments of the usual length is dealt to several shards, by document and place.
    4. Each shard compiles automata of its recurring passages and streams its segments, ordered by document and place,
       so the first occurrence comes first. For anchors in several shards, each shard's first ones are compared again.
    """
    spark = docs.sparkSession

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for b in batches:
            found = [anchors((t or b"").split(), known, window, phrase) for t in b.column(1).cast(pa.binary()).to_pylist()]
            ids, ties = (np.repeat(b.column(i).to_numpy(), [len(f[0]) for f in found]) for i in (0, 2))
            columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(ids, pa.int64()), pa.array(ties, pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int8())], names=["anchor", "id", "tie", "lo", "hi", "times"])

    named = written(docs.select("id", "text", "tie").mapInArrow(scan, "anchor long, id long, tie long, lo int, hi int, times tinyint"))
    recurring = written(named.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.sum("times").alias("times"), F.sum(F.col("hi") - F.col("lo") + window).alias("words")).where("times > 1").withColumn("salts", F.ceil(F.col("words") / (salt_rows * (window + phrase))).cast("int")).select("anchor", "n", "salts"))
    total = recurring.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    places = named.join(recurring.drop("n"), "anchor").groupBy("id", "tie").agg(F.collect_set(F.struct("anchor", "lo", "hi", "salts")).alias("places"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = zstandard.ZstdDecompressor()
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                lists = part.column(3)
                each, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
                anchor, lo, hi, salts = (flat.field(f).to_numpy() for f in ("anchor", "lo", "hi", "salts"))
                ids, ties = (np.repeat(part.column(i).to_numpy(), each) for i in (0, 1))
                los, stops, k, words, fits = lo.tolist(), (hi + window).tolist(), 0, [], []
                for packed, n in zip(part.column(2).to_pylist(), each.tolist(), strict=True):
                    ws = large.decompress(packed).split()
                    for i in range(k, k + n):
                        fits.append(stops[i] <= len(ws))  # else of another text with this id and hash
                        words.append(b" ".join(ws[los[i] : stops[i]]))
                    k += n
                    if words and (k == len(lo) or len(words) > 20_000):  # not all at once, where texts are long
                        own = slice(k - len(words), k)
                        out = pa.RecordBatch.from_arrays([pa.array(anchor[own], pa.int64()), pa.array(salts[own], pa.int32()), pa.array(ids[own], pa.int64()), pa.array(ties[own], pa.int64()), pa.array(lo[own], pa.int32()), pa.array(words, pa.binary())], names=["anchor", "salts", "id", "tie", "lo", "words"])
                        yield out if all(fits) else out.filter(pa.array(fits, pa.bool_()))
                        words, fits = [], []

    segments = packed_texts(docs).join(places, ["id", "tie"]).mapInArrow(cut_out, "anchor long, salts int, id long, tie long, lo int, words binary")
    segments = segments.withColumn("salt", F.pmod(F.xxhash64("id", "tie", F.floor(F.col("lo") / PIECE)), F.col("salts")).cast("int"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_rows))
    dealt = segments.repartition(parts, "anchor", "salt").sortWithinPartitions("anchor", "salt", "id", "tie", "lo")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        span_kind = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            docs_, late, keys = [], [], []
            rows.sort(key=lambda r: (r[0], r[3], r[4]))  # salts of one anchor may come together
            for salted in (False, True):
                own = [(r[0], r[3], r[4], r[5]) for r in rows if (r[1] > 1) == salted]
                if not own:
                    continue
                for doc, again, new in repeated(own, window, salted):
                    if again:
                        docs_.append(doc)
                        late.append([{"at": a, "n": n} for a, n in runs(again)])
                        keys.append(None)
                    for w, s in new:
                        docs_.append(doc)
                        late.append([{"at": s, "n": 1}])
                        keys.append(hashlib.blake2b(w, digest_size=16).digest())
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs_], pa.int64()), pa.array([d[1] for d in docs_], pa.int64()), pa.array(late, span_kind), pa.array(keys, pa.binary())], names=["id", "tie", "runs", "key"])

        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if (len(held) >= CHUNK or size >= CHUNK_BYTES) and (r[0], r[6]) != (held[-1][0], held[-1][2]):
                    yield flush(held)
                    held, size = [], 0
                held.append((r[0], r[1], r[6], (r[2], r[3]), r[4], r[5]))
                size += len(r[5])
        if held:
            yield flush(held)

    judged = written(dealt.select("anchor", "salts", "id", "tie", "lo", "words", "salt").mapInArrow(shard, "id long, tie long, runs array<struct<at:int,n:int>>, key binary"))
    sure = judged.where("key is null").select("id", "tie", F.explode("runs").alias("r"))
    open_ = judged.where("key is not null").select("id", "tie", F.col("runs")[0].alias("r"), "key")
    first = open_.groupBy("key").agg(F.min(F.struct("id", "tie", F.col("r.at").alias("at"))).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
    later = open_.join(first, "key").where(~F.struct("id", "tie", F.col("r.at").alias("at")).eqNullSafe(F.col("first"))).select("id", "tie", "r")
    return sure.unionAll(later).groupBy("id", "tie").agg(F.collect_list("r").alias("runs"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, phrase: int = 6) -> DataFrame:
    """One row for each row of docs: id, n_words, n_removed and kept (the words that stay, joined by spaces).

    A word goes if a window of `window` words that covers it also starts earlier: in a document of smaller id, or
    earlier in its own. Windows are judged on the texts as they come in.

    Defined cases: null, blank and short texts keep all their words; a null id counts as the smallest; repeated rows
    (one id, one text) give equal rows, and count as one document; rows of one id, or of none, and different texts are
    documents of their own, in the order of a hash of the text; an empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))
    # Where each id has one text, the tie is a constant, which costs the shuffles nothing.
    own = F.xxhash64("text")
    clash = not rows.groupBy("id").agg(F.min(own).alias("a"), F.max(own).alias("b")).where("a <> b").isEmpty()
    rows = rows.withColumn("tie", own if clash else F.lit(0).cast("long"))
    found = repeated_windows(rows, window, phrase)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = zstandard.ZstdDecompressor()
        for b in batches:
            n_words, removed, kept = [], [], []
            for packed, late in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                ws = large.decompress(packed).split()
                n_words.append(len(ws))
                if not late.is_valid:
                    removed.append(0)
                    kept.append(b" ".join(ws))
                    continue
                at, n = (late.values.field(f).to_numpy() for f in ("at", "n"))
                gone = np.zeros(len(ws) + 1, np.int32)
                np.add.at(gone, at, 1)
                np.add.at(gone, np.minimum(len(ws), at + n + window - 1), -1)
                stays = np.cumsum(gone[:-1]) == 0
                removed.append(int(len(ws) - stays.sum()))
                kept.append(b" ".join([w for w, s in zip(ws, stays.tolist(), strict=True) if s]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept"])

    out = packed_texts(rows).join(found, ["id", "tie"], "left").select("id", "packed", "runs").mapInArrow(keep, "id long, n_words long, n_removed long, kept string")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "n_words", "n_removed", "kept")


def digest(kept: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return kept.select(id_col, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The digest in SQL: a window is its twenty words joined by spaces, which words don't hold.
ORACLE_SQL = f"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD_SQL}') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
s AS (SELECT doc_id, i, {" || ' ' || ".join(["word", *(f"lead(word, {k}) OVER d" for k in range(1, 20))])} AS k FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT k, min(struct_pack(d := doc_id, i := i)) AS first FROM s WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1),
l AS (SELECT s.doc_id, s.i FROM s JOIN f USING (k) WHERE s.doc_id <> first.d OR s.i <> first.i),
g AS (SELECT DISTINCT doc_id, i + o AS i, true AS gone FROM l, range(20) AS r(o)),
k AS (SELECT p.doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p.i) FILTER (gone IS NULL) AS kept FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k ON t.doc_id = k.doc_id"""
