"""Column expressions that several operators share. All stay on the JVM."""

from __future__ import annotations

import html.entities
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Name space for URLs of RFC 4122, as text in ISO 8859-1 is no choice for bytes: kept in hexadecimal (a fixed value).
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
SEVERITIES = ("NORMAL", "WATCH", "HIGH", "CRITICAL")


def clamp(x: Column | float, low: float = 0.0, high: float = 1.0) -> Column:
    x = x if isinstance(x, Column) else F.lit(x)
    return F.when(x.isNull(), None).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), x)))


def number(name: str) -> Column:
    """A feature as a number, 0 where it is missing."""
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def uuid5(name: Column) -> Column:
    """The name-based identifier (version 5) of a URL-like name."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def hmac_sha256(key: str, message: Column) -> Column:
    """Lower-case hexadecimal HMAC; a key of up to 64 bytes."""
    block = key.encode().ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in block).hex()))
    inner = F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def hmac_pads(key: Column) -> Column:
    """The two blocks that a key of up to 64 bytes gives (inner, outer): to be worked out once for each key, not for each message."""
    block = F.rpad(F.hex(F.encode(key, "UTF-8")), 128, "0")
    byte = lambda i: F.conv(F.substr(block, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    pad = lambda x: F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex(byte(i).bitwiseXOR(F.lit(x))), 2, "0")), ""))
    return F.struct(pad(0x36).alias("inner"), pad(0x5C).alias("outer"))


def hmac_sha256_by(pads: Column, message: Column) -> Column:
    """As hmac_sha256, with a key of its own for each row, given as hmac_pads."""
    return F.sha2(F.concat(pads["outer"], F.unhex(F.sha2(F.concat(pads["inner"], F.encode(message, "UTF-8")), 256))), 256)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, within 0..1; 0 where a norm is."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(clamp(dot(a, b) / norm))


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def severity(score: Column, watch: float = 0.35, high: float = 0.60, critical: float = 0.80) -> Column:
    return F.when(score >= critical, "CRITICAL").when(score >= high, "HIGH").when(score >= watch, "WATCH").otherwise("NORMAL")


def rank_of(level: Column) -> Column:
    """0..3 for a severity."""
    return F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), level).cast("int") - 1


def level_of(rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(s) for s in SEVERITIES)), rank.cast("int") + 1)


def share_of_most(counts: Column) -> Column:
    """max / sum of an array of counts, 0 where it is empty."""
    return F.coalesce(F.array_max(counts) / F.aggregate(counts, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))


def settled(df: DataFrame) -> DataFrame:
    """The same rows, with their columns worked out here: a one-element array of the row, unnested. Long chains of
    conditional columns else are put into each other by the optimizer (a filter on the last one is pushed down through
    all), and the expression grows exponentially with the chain."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode's normal form KC, for which the JVM has no function; ASCII passes as it is."""
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


def unescaped(text: Column) -> Column:
    """Character references decoded: numbers, and the names that the standard ends with a semicolon."""
    names = F.create_map(*(F.lit(x) for k, v in html.entities.html5.items() if k.endswith(";") for x in (k[:-1], v)))

    def decoded(piece: Column) -> Column:
        """A piece after an ampersand."""
        part = lambda p: F.regexp_extract(piece, p, 1)
        number = F.coalesce(F.when(part("^#([0-9]{1,7});") != "", part("^#([0-9]{1,7});").cast("long")), F.when(part("^#[xX]([0-9a-fA-F]{1,6});") != "", F.conv(part("^#[xX]([0-9a-fA-F]{1,6});"), 16, 10).cast("long")))
        known = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        sign = F.coalesce(F.when(known, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")), F.when(number.isNotNull(), "\ufffd"), F.try_element_at(names, part("^([A-Za-z][A-Za-z0-9]*);")))
        return F.when(sign.isNotNull(), F.concat(sign, F.regexp_replace(piece, "^[^;]*;", ""))).otherwise(F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&", -1)
    rest = F.array_join(F.transform(F.slice(pieces, 2, 1 << 30), decoded), "")
    return F.when(text.contains("&"), F.concat(F.get(pieces, F.lit(0)), rest)).otherwise(text)


def canonical_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of a canonical JSON object: fields by name, no white space, nulls written out."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}), 256)
