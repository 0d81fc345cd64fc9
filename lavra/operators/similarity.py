"""Word shingles, signatures and exact similarity search.

similar() finds, for a set of query documents, every document whose shingle sets have a Jaccard
similarity of at least the threshold. It is exact: of a query with k shingles such a document holds at
least t k, so it holds one of any k - ceil(t k) + 1 of them. The rarest ones meet the whole sets in the
join, of which a bit filter lets only shingles of the queries through; the candidates are verified.
Identical texts are represented once and mapped back at the end, so copies cause no pairs.

Edge cases: null and blank texts have no shingles and match nothing; texts of fewer words than a
shingle are one shingle; ties in rarity are broken by the shingle's hash.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.operators.orphans import bloom_words, filter_bits, might_contain
from lavra.session import checkpoint


def _accents() -> tuple[str, str]:
    """Latin letters that are a plain letter with marks, and that letter."""
    pairs = [(c, d[0]) for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def normalise(c: Column) -> Column:
    """Without accents, lower case, anything but letters and digits to one blank."""
    return F.trim(F.regexp_replace(F.lower(F.translate(c, *_accents())), r"[^a-z0-9]+", " "))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once per row: a lambda's variable is bound, an expression would be repeated in every step."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct word n-grams of a normalised text."""

    def grams(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < n, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(many))

    return _let(F.filter(F.split(text, " "), lambda x: x != ""), grams)


def hashed_shingles(text: Column, n: int = 5) -> Column:
    return F.array_distinct(F.transform(shingles(normalise(text), n), lambda x: F.xxhash64(x)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - both
    return F.when(whole > 0, both / whole).otherwise(0.0)


def containment(part: Column, whole: Column) -> Column:
    return F.when(F.size(part) > 0, F.size(F.array_intersect(part, whole)) / F.size(part)).otherwise(0.0)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def representatives(df: DataFrame, key: str, text: str) -> DataFrame:
    """<key>, classe: the least id among the texts that are equal when normalised. Blank texts are left out."""
    t = df.select(key, F.sha2(normalise(F.col(text)), 256).alias("h"), (normalise(F.col(text)) != "").alias("some")).where("some")
    least = t.groupBy("h").agg(F.min(key).alias("classe"))
    return t.join(least, "h").select(key, "classe")


def similar(df: DataFrame, key: str, text: str, is_query: Column, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """consulta, classe, jaccard: pairs of representatives, the first of them with a member for which is_query holds."""
    # one pass over the texts; what comes of it is used for classes, queries, what meets them, and the check
    made = _let(normalise(F.col(text)), lambda t: F.when(t != "", F.struct(F.sha2(t, 256).alias("h"), F.array_distinct(F.transform(shingles(t, n), lambda x: F.xxhash64(x))).alias("s"))))
    base = checkpoint(df.select(F.col(key).alias("id"), is_query.alias("q"), made.alias("x")).where("id is not null").select("id", "q", "x.h", "x.s"))
    classes = base.where("h is not null").groupBy("h").agg(F.min("id").alias("id"), F.bool_or(F.coalesce("q", F.lit(False))).alias("q"))
    sets = checkpoint(base.select("id", "s").join(classes.select("id", "q"), "id").dropDuplicates(["id"]).withColumn("n", F.size("s")))
    mine = sets.where("q").select(F.col("id").alias("a"), F.col("n").alias("na"), F.explode("s").alias("g"))
    wanted = mine.select("g").distinct()
    # of all shingles only those of the queries go on: a bit filter first, so that nearly nothing else is shuffled
    bits = filter_bits(wanted.count())
    held = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.explode("s").alias("g"))
    held = held.where(might_contain(bloom_words(wanted.withColumnRenamed("g", "k"), bits).scalar(), F.col("g"), bits))
    rarity = held.join(wanted, "g").groupBy("g").agg(F.count("*").alias("df"))
    order = Window.partitionBy("a").orderBy("df", "g")
    rare = mine.join(rarity, "g").withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= F.col("na") - F.ceil(F.col("na") * threshold - 1e-9) + 1)
    near = rare.join(held, "g").where((F.col("a") != F.col("b")) & (F.col("nb") >= F.col("na") * threshold - 1e-9) & (F.col("na") >= F.col("nb") * threshold - 1e-9)).select("a", "b").distinct()
    sa, sb = sets.select(F.col("id").alias("a"), F.col("s").alias("x")), sets.select(F.col("id").alias("b"), F.col("s").alias("y"))
    out = near.join(sa, "a").join(sb, "b").withColumn("j", jaccard(F.col("x"), F.col("y"))).where(F.col("j") >= threshold - 1e-9)
    return out.select(F.col("a").alias("consulta"), F.col("b").alias("classe"), F.round("j", 4).alias("jaccard"))


_PRIME = (1 << 61) - 1


def _mod(x: np.ndarray) -> np.ndarray:
    """x mod 2^61 - 1, for any 64 bits."""
    x = (x & np.uint64(_PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(_PRIME), x - np.uint64(_PRIME), x)


def _permute(a: np.ndarray, b: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(a h + b) mod 2^61 - 1 for numbers below that, in 64 bits: by halves of 31 bits, where 2^62 counts 2 and a shift by 31 is a rotation."""
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    a1, a0, h1, h0 = a >> half, a & low, h >> half, h & low
    mid = _mod(a1 * h0 + a0 * h1)
    return _mod(np.uint64(2) * a1 * h1 + ((mid & np.uint64((1 << 30) - 1)) << half) + (mid >> np.uint64(30)) + a0 * h0 + b)


#: The permutations are drawn from the digits of pi; any other seed would do, as long as all signatures share it.
SEED = 31_415_926


def minhash(shingle_hashes: Column, permutations: int = 128, seed: int = SEED) -> Column:
    """array<bigint>: the least value of each permutation (a h + b) mod 2^61 - 1 over the set, h the hashes modulo the same prime; empty for an empty set."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(1, _PRIME, permutations, dtype=np.uint64), rng.integers(0, _PRIME, permutations, dtype=np.uint64)

    @F.pandas_udf("array<bigint>")
    def sign(sets: pd.Series) -> pd.Series:
        out = []
        for s in sets:
            if s is None or len(s) == 0:
                out.append([])
                continue
            h = _mod(np.asarray(s, dtype=np.int64).view(np.uint64))
            # by 1,024 hashes, so that a long text takes no more memory than a short one
            least = [_permute(a[:, None], b[:, None], h[None, k : k + 1024]).min(axis=1) for k in range(0, len(h), 1024)]
            out.append(np.min(least, axis=0).astype(np.int64).tolist())
        return pd.Series(out)

    return sign(shingle_hashes)


def agreement(a: Column, b: Column) -> Column:
    """Share of equal positions of two signatures; 0 for different lengths or empty ones."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), same / F.size(a)).otherwise(0.0)


def simhash(shingle_hashes: Column) -> Column:
    """64 bits: the sign of the sum of +1 and -1 by each bit of the hashes."""

    @F.pandas_udf("bigint")
    def sign(sets: pd.Series) -> pd.Series:
        bit = np.arange(64, dtype=np.uint64)
        out = []
        for s in sets:
            if s is None or len(s) == 0:
                out.append(0)
                continue
            h = np.asarray(s, dtype=np.int64).view(np.uint64)
            ones = ((h[:, None] >> bit) & np.uint64(1)).sum(axis=0)
            word = int(sum(1 << i for i in range(64) if 2 * int(ones[i]) > len(h)))
            out.append(word - (1 << 64) if word >> 63 else word)
        return pd.Series(out, dtype="int64")

    return sign(shingle_hashes)
