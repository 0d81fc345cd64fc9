"""References to records that do not exist.

A Bloom filter of all parent keys, folded into a bit array inside Spark and handed to every task as
one scalar, proves most orphans at once: a key the filter has never seen has no parent. Only the
references that pass it go into the exact join, which also looks at the validity spans. The filter's
size is bounded (max_bits, 8 MB, made for seven million parents); with more of them it lets more
references through, and the exact join still decides rightly. A parent's row has as many spans as its
table has distinct rows for that id.

Edge cases: null or blank references are no references; a reference without an instant of reception
can't be judged and is left out; identical repeated rows of events or parents change nothing; an
empty parent table makes every reference an orphan; a parent row without bounds is always valid;
a span that ends before it begins holds never. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.functions.text import key


@dataclass(frozen=True)
class Reference:
    """A field of the child table and the table of its parents."""

    field: str
    parents: DataFrame
    parent_id: str = "id"
    begins: str = "incluido_em"
    ends: str = "excluido_em"


#: Hash functions of the filter, as seeds mixed into the key.
_HASHES = 5


def _position(i: int, k: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(i), k), F.lit(bits))


def bloom_words(keys: DataFrame, bits: int) -> DataFrame:
    """One row, one column `words`: the filter of the column `k` as an array of bits / 64 longs."""
    spark = keys.sparkSession
    set_bits = keys.select(F.explode(F.array(*[_position(i, F.col("k"), bits) for i in range(_HASHES)])).alias("p")).select(
        F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("b")
    )
    empty = spark.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("b"))
    dense = set_bits.unionByName(empty).groupBy("w").agg(F.bit_or("b").alias("b"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words"))


def might_contain(words: Column, k: Column, bits: int) -> Column:
    """False only for keys that are not in the filter. A subquery given as `words` is computed once, whatever the number of hashes."""
    out = F.lit(True)
    for i in range(_HASHES):
        p = _position(i, k, bits)
        out = out & (F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return out


def filter_bits(n: int, per_key: int = 10, most: int = 1 << 26) -> int:
    """A power of two of about per_key bits for each of n keys, 8 MB at most."""
    bits = 1 << 12
    while bits < min(n * per_key, most):
        bits *= 2
    return bits


def orphans(
    children: DataFrame, references: list[Reference], child_id: str = "id", at: str = "recebido_em", max_bits: int = 1 << 26, small: int = 50_000
) -> DataFrame:
    """campo, mes, registro, chave, motivo (nunca_existiu, fora_do_periodo), one row per orphan reference.

    `mes` is the UTC month of `at`, yyyy-mm; distinct rows only. The children are read once: a reference
    that the filter has proved an orphan goes on under a key of its own that no parent has, so that hot
    ones are spread; the others meet their parents. Up to `small` parents (counted) are broadcast, more
    are joined by shuffle, where adaptive execution splits hot keys.
    """
    parents = None
    for r in references:
        one = r.parents.select(
            F.lit(r.field).alias("campo"), key(F.col(r.parent_id)).alias("chave"), F.col(r.begins).alias("b"), F.col(r.ends).alias("e")
        ).where("chave is not null")
        parents = one if parents is None else parents.unionByName(one)
    # several rows per id become one, with its distinct spans
    spans = parents.groupBy(F.concat_ws("\u0001", "campo", "chave").alias("k")).agg(F.collect_set(F.struct("b", "e")).alias("spans"))
    keys = spans.select("k")
    n = keys.count()
    bits = filter_bits(n, most=max_bits)
    fields = [F.struct(F.lit(r.field).alias("campo"), key(F.col(r.field).cast("string")).alias("chave")) for r in references]
    refs = (
        children.select(F.col(child_id).cast("string").alias("registro"), F.col(at).alias("at"), F.explode(F.array(*fields)).alias("x"))
        .select("registro", "at", "x.campo", "x.chave", F.concat_ws("\u0001", "x.campo", "x.chave").alias("k"))
        .where("chave is not null and at is not null")
    )
    proved = ~might_contain(bloom_words(keys, bits).scalar(), F.col("k"), bits)
    refs = refs.withColumn("k", F.when(proved, F.concat(F.lit("\u0000"), F.coalesce("registro", F.lit("")))).otherwise(F.col("k")))
    valid = F.exists(
        "spans", lambda s: (s["b"].isNull() | (s["b"] <= F.col("at"))) & (s["e"].isNull() | (F.col("at") < s["e"]))
    )
    checked = refs.join(F.broadcast(spans) if n <= small else spans, "k", "left").where(F.col("spans").isNull() | ~valid)
    reason = F.when(F.col("spans").isNull(), "nunca_existiu").otherwise("fora_do_periodo").alias("motivo")
    return checked.select("campo", F.date_format(F.col("at"), "yyyy-MM").alias("mes"), "registro", "chave", reason).distinct()


def orphan_report(children: DataFrame, references: list[Reference], child_id: str = "id", at: str = "recebido_em") -> DataFrame:
    """campo, mes, motivo, n (orphan references), n_chaves (distinct keys) per field and month."""
    return (
        orphans(children, references, child_id, at)
        .groupBy("campo", "mes", "motivo")
        .agg(F.count("*").alias("n"), F.countDistinct("chave").alias("n_chaves"))
    )
