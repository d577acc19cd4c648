import hashlib
import hmac
import uuid

from pyspark.sql import functions as F

from tidewatch.functions import exprs


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


def test_identifiers_equal_the_standard(spark):
    for name in ("window:LIVE:A1:60", "é", ""):
        r = one(spark, u=exprs.uuid5(F.lit(name)), h=exprs.hmac_sha256("pepper", F.lit(name)))
        assert r["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
        assert r["h"] == hmac.new(b"pepper", name.encode(), hashlib.sha256).hexdigest()


def test_vectors_sets_and_levels(spark):
    arr = lambda *x: F.array(*(F.lit(v) for v in x))
    r = one(spark, c=exprs.cosine(arr(1.0, 0.0), arr(1.0, 1.0)), z=exprs.cosine(arr(0.0, 0.0), arr(1.0, 1.0)), n=exprs.cosine(arr(1.0, 0.0), arr(-1.0, 0.0)), j=exprs.jaccard(arr("a", "b"), arr("b", "c")), s=exprs.severity(F.lit(0.6)), k=exprs.rank_of(F.lit("HIGH")), l=exprs.level_of(F.lit(3)), m=exprs.clamp(F.lit(None).cast("double")), o=exprs.clamp(F.lit(1.5)))
    assert abs(r["c"] - 0.5**0.5) < 1e-12 and r["z"] == 0 and r["n"] == 0 and abs(r["j"] - 1 / 3) < 1e-12
    assert (r["s"], r["k"], r["l"], r["m"], r["o"]) == ("HIGH", 2, "CRITICAL", None, 1.0)
