"""Fill-in-middle: documents cut at two of their word boundaries, which a learned rank index finds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = ("<P>", "<S>", "<M>")
#: The largest error of a line: what it misses by, rounding included, fits one signed byte.
ERROR = 126


def boundaries(text: str, step: int = 1 << 20) -> np.ndarray:
    """Offsets in code points at which units end, after a 0. A unit is a word with the white space before it; white space that
    ends the text is one too. Read `step` code points at a time."""
    ends, white_before = [np.zeros(1, np.int64)], True
    for a in range(0, len(text), step):
        c = np.frombuffer(text[a : a + step].encode("utf-32-le"), "<u4")
        white = (c == 32) | ((c >= 9) & (c <= 13))
        before = np.concatenate([[white_before], white[:-1]])
        ends.append(np.flatnonzero(white & ~before) + a)
        white_before = white[-1]
    if text:
        ends.append(np.array([len(text)]))
    return np.concatenate(ends)


@dataclass
class RankIndex:
    """Rank to offset: each line starts at a rank, and predicts within ERROR; a byte for each rank says what it misses by."""

    first: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    missed: np.ndarray

    def offset(self, rank: int) -> int:
        line = np.searchsorted(self.first, rank, "right") - 1
        return predicted(self.base[line], self.slope[line], rank - self.first[line]) + int(self.missed[rank])


def predicted(base, slope, steps):
    return base + np.floor(slope * steps).astype(np.int64)


def fit(offsets: np.ndarray, error: int = ERROR) -> RankIndex:
    """As few lines as a greedy pass needs: a line starts at a boundary, and goes on while one slope passes within `error` of
    every boundary since (the interval of such slopes only shrinks)."""
    first, slope, a, n = [], [], 0, len(offsets)
    while a < n:
        low, high, end, step = -np.inf, np.inf, a + 1, 256
        while end < n:
            k = np.arange(end, min(n, end + step)) - a
            rise = offsets[a + k] - offsets[a]
            lows = np.maximum.accumulate(np.maximum((rise - error) / k, low))
            highs = np.minimum.accumulate(np.minimum((rise + error) / k, high))
            out = np.flatnonzero(lows > highs)
            fits = int(out[0]) if len(out) else len(k)
            if fits:
                low, high = lows[fits - 1], highs[fits - 1]
            end, step = end + fits, 2 * step
            if len(out):
                break
        first.append(a)
        slope.append((low + high) / 2 if end > a + 1 else 0.0)
        a = end
    starts, slopes = np.array(first, np.int64), np.array(slope)
    line = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    missed = offsets - predicted(offsets[starts[line]], slopes[line], np.arange(n) - starts[line])
    return RankIndex(starts, offsets[starts], slopes, missed.astype(np.int8 if error <= ERROR else np.int64))


def told_apart(marks: tuple[str, str, str]) -> None:
    """The first place of a mark is its own whatever the texts around it, if no mark begins with what another (or itself) ends with."""
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            if not a or any(a[:k] == b[-k:] for k in range(1, len(a) + (i != j))) or (i != j and a in b):
                raise ValueError(f"marks {marks} can't be told apart")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """One row for each row of docs: id, n (units), form, prefix_chars, middle_chars, lines (of the rank index), output.

    sha256 of `seed:id` gives four numbers: two cut ranks, whether the document is rearranged (in `rate` of 100) and how (spm in
    `spm` of 100 of these, else psm). Ranks become offsets through the document's rank index: its boundaries are fitted by lines of
    bounded error, the line of a rank predicts the offset and the stored residual corrects it. A row is worked on by
    itself: no shuffle, and no more memory than a few times its text.

    Defined cases: null and empty texts, texts that hold a mark, and those the rate leaves out, are plain: output is the text, chars
    and lines are null. A null id hashes as no digits. Equal ids are cut at the same ranks; repeated rows are rows; an empty table gives
    none. Other columns are ignored.
    """
    told_apart(marks)
    p, s, m = marks
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    plain = (text == "") | text.contains(p) | text.contains(s) | text.contains(m) | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), h[0].alias("h1"), h[1].alias("h2"), form.alias("form"))
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                n, prefix, middle, lines, out = [], [], [], [], []
                for t, h1, h2, f in zip(*(b.column(c).to_pylist() for c in (1, 2, 3, 4)), strict=True):
                    ends = boundaries(t)
                    units = len(ends) - 1
                    n.append(units)
                    if f == "plain":
                        prefix.append(None), middle.append(None), lines.append(None), out.append(t)
                        continue
                    index = fit(ends)
                    i, j = (index.offset(r) for r in sorted((h1 % (units + 1), h2 % (units + 1))))
                    prefix.append(i), middle.append(j - i), lines.append(len(index.first))
                    out.append(f"{s}{t[j:]}{p}{t[:i]}{m}{t[i:j]}" if f == "spm" else f"{p}{t[:i]}{s}{t[j:]}{m}{t[i:j]}")
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), b.column(4), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(lines, pa.int32()), pa.array(out, pa.string())], names=["id", "n", "form", "prefix_chars", "middle_chars", "lines", "output"])

    done = rows.mapInArrow(run, f"id {kind.simpleString()}, n long, form string, prefix_chars long, middle_chars long, lines int, output string")
    return done.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of that form was made of, exactly."""
    p, s, m = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        """What stands between the first and second mark, between the second and the last, and after it."""
        body = F.substr(output, F.lit(len(first) + 1))
        at = F.instr(body, F.lit(second))
        rest = F.substr(body, at + len(second))
        last = F.instr(rest, F.lit(m))
        return F.substr(body, F.lit(1), at - 1), F.substr(rest, F.lit(1), last - 1), F.substr(rest, last + len(m))

    prefix, suffix, middle = parts(p, s)
    suffix2, prefix2, middle2 = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def digest(done: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(c, 256)
    return done.withColumns({"output_sha256": sha(F.col("output")), "restored_sha256": sha(restored(F.col("output"), F.col("form")))}).drop("output", "lines")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
    CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2, CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4
  FROM d),
c AS (
  SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n, CAST(least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS BIGINT) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(w[1:a], ''), '') AS prefix, coalesce(array_to_string(w[a + 1:b], ''), '') AS middle, coalesce(array_to_string(w[b + 1:n], ''), '') AS suffix
  FROM c)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
  sha256(CASE WHEN form = 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""
