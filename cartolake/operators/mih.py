"""Near duplicates of 64-bit fingerprints by multi-index hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fingerprint64

#: The three keys' bits, from the highest.
KEYS = ((22, 42), (21, 21), (21, 0))


def mih_pairs(left: DataFrame, right: DataFrame, ident: str, fingerprint: str, radius: int = 5) -> DataFrame:
    """a, b, distance of fingerprints within `radius` bits, up to 5: two such agree, but for one bit at most, in one of three keys. The
    left side is filed under each key and its one-bit neighbours; the lookup is an equi-join."""
    if radius > 5:
        raise ValueError("three keys with one-bit neighbours find pairs within 5 bits")
    fp = F.col(fingerprint)
    own, near = [], []
    for k, (bits, low) in enumerate(KEYS):
        v = F.shiftrightunsigned(fp, low).bitwiseAND((1 << bits) - 1)
        own.append(F.struct(F.lit(k).alias("k"), v.alias("v")))
        near += [F.struct(F.lit(k).alias("k"), v.bitwiseXOR(m).alias("v")) for m in (0, *(1 << b for b in range(bits)))]
    a = left.select(F.col(ident).alias("a"), fp.alias("fa"), F.explode(F.array(*near)).alias("x")).select("a", "fa", "x.k", "x.v")
    b = right.select(F.col(ident).alias("b"), fp.alias("fb"), F.explode(F.array(*own)).alias("x")).select("b", "fb", "x.k", "x.v")
    d = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb")))
    return a.join(b, ["k", "v"]).where(d <= radius).select("a", "b", d.cast("int").alias("distance")).distinct()


def simhash(df: DataFrame, ident: str, text: str) -> DataFrame:
    """ident and fp, the SimHash of all different words of a text in lower case: a bit is set where more than half of the words' fingerprints
    have it. Words count once, as else the commonest words of a language make unrelated texts alike. Null texts are left out; a text without words has 0."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.col(text)), r"[ \t\r\n]+"), lambda w: w != ""))
    hashed = df.where(F.col(text).isNotNull()).select(ident, F.explode_outer(words).alias("w")).select(ident, fingerprint64(F.col("w")).alias("h"))
    # Bits b and b + 32 are counted in the halves of one sum.
    both = (1 << 32) + 1
    sums = hashed.groupBy(ident).agg(F.count("h").alias("n"), *[F.coalesce(F.sum(F.shiftrightunsigned("h", b).bitwiseAND(both)), F.lit(0)).alias(f"s{b}") for b in range(32)])
    fp = F.lit(0).cast("long")
    for b in range(32):
        for at, ones in ((b, F.col(f"s{b}").bitwiseAND((1 << 32) - 1)), (b + 32, F.shiftrightunsigned(f"s{b}", 32))):
            fp = fp.bitwiseOR(F.when(ones * 2 > F.col("n"), F.lit((1 << at) - (1 << 64 if at == 63 else 0))).otherwise(F.lit(0)).cast("long"))
    return sums.select(ident, fp.alias("fp"))


def near_pairs(prints: DataFrame, ident: str, fingerprint: str, radius: int = 5) -> DataFrame:
    """a < b and the distance: each class of equal fingerprints once, as its least ident with each other one at distance 0, and the least
    idents of classes within `radius` bits."""
    classes = prints.groupBy(fingerprint).agg(F.min(ident).alias("first"))
    equal = prints.join(classes, fingerprint).where(~F.col(ident).eqNullSafe(F.col("first"))).select(F.col("first").alias("a"), F.col(ident).alias("b"), F.lit(0).alias("distance"))
    return equal.unionByName(mih_pairs(classes, classes, "first", fingerprint, radius).where("a < b"))
