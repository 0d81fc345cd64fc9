"""Filling containers of fixed capacity with items, by the sum-of-squares rule.

Items come one by one and each goes to the fill level where the sum of the squared counts of partially
filled containers becomes least (a new container counts as the level 0). A level array holds those
counts. An item beyond the capacity is cut: full containers of its own, and the rest is an item.

Items are hashed into groups of about `group_items`, so that memory and time of a task stay bounded. A
group leaves full containers and a few open ones; the items of the open ones of all groups are packed
again together, in as many groups as their number asks for, and so on until one group is left or the
open items no longer become half as many. What stays unused is thus what one group would leave.

Edge cases: items without id are left out; null sizes count as 0; an item of size 0 takes a place in an
open container; repeated ids are items of their own; capacities that are null or below 1 are left out;
a capacity of more than `levels` tokens is packed in units of capacity / levels, sizes rounded up, so
that the level array stays bounded; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.session import checkpoint


def sum_of_squares(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """Container, place (from 1) and begin of each item (0 <= size <= capacity), and the fill of each container, by the sum-of-squares rule."""
    counts = np.zeros(capacity + 1, np.int64)  # counts[h]: open containers filled to h, 0 < h < capacity
    at_level: list[list[int]] = [[] for _ in range(capacity + 1)]
    place, position, begin, fill, held = [], [], [], [], []
    for s in sizes:
        if s == 0:
            if not fill:
                fill.append(0)
                held.append(0)
                at_level[0].append(0)
            c, h = len(fill) - 1, fill[-1]
        else:
            # change of the sum when a container goes from level h to h + s
            top = capacity - s
            cost = np.empty(top + 1, np.int64)
            cost[:top] = 2 * counts[s:capacity] + 1
            cost[top] = 0
            cost[1:] -= 2 * counts[1 : top + 1] - 1
            shut = counts[: top + 1] == 0
            shut[0] = False
            cost[shut] = np.iinfo(np.int64).max
            h = top - int(np.argmin(cost[::-1]))  # the fullest of the best
            if h == 0:
                c = at_level[0].pop() if at_level[0] else len(fill)
                if c == len(fill):
                    fill.append(0)
                    held.append(0)
            else:
                c = at_level[h].pop()
                counts[h] -= 1
            fill[c] = h + s
            if h + s < capacity:
                counts[h + s] += 1
                at_level[h + s].append(c)
        held[c] += 1
        place.append(c)
        position.append(held[c])
        begin.append(h)
    return place, position, begin, fill


def _packer(levels: int):
    def pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf["capacidade_tokens"].iloc[0])
        unit = -(-capacity // levels)
        pdf = pdf.sort_values(["id", "parte"], kind="stable")
        # what fills all whole units is alone in its container, even if it also needs the rest
        units = [min(-(-int(n) // unit), capacity // unit) for n in pdf["tokens"]]
        place, position, begin, fill = sum_of_squares(units, capacity // unit)
        if unit > 1:  # places in tokens: the items of a container one after the other
            begin = pdf.groupby(np.array(place), sort=False)["tokens"].cumsum().to_numpy() - pdf["tokens"].to_numpy()
        return pdf.assign(caixa=place, posicao=position, inicio=begin, cheia=[fill[c] * unit + capacity % unit for c in place])

    return pack_group


def _for_each(df: DataFrame, caps: DataFrame) -> DataFrame:
    """Each row once for every capacity: the capacities' table as one array, which tasks hold, and no join."""
    every = caps.agg(F.collect_list(F.struct("capacidade_id", "capacidade_tokens")).alias("c")).scalar()
    had = df.columns
    return df.withColumn("_c", every).select(*had, F.explode("_c").alias("_c")).select(*had, "_c.capacidade_id", "_c.capacidade_tokens")


_ITEM = "capacidade_id bigint, capacidade_tokens bigint, grupo bigint, id bigint, parte bigint, tokens bigint"


def pack(sizes: DataFrame, capacities: DataFrame, key: str = "doc_id", size: str = "tokens", group_items: int = 25_000, levels: int = 1 << 16) -> DataFrame:
    """capacidade_id, recipiente, posicao, <key>, parte (from 1), inicio (where the item begins in the container), tokens.

    sizes is read more than once; give it checkpointed if it is costly.
    """
    items = sizes.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n"))
    caps = capacities.where("capacidade_tokens >= 1").select(F.col("capacidade_id").cast("bigint"), F.col("capacidade_tokens").cast("bigint")).distinct()
    each = _for_each(items, caps)
    # whole containers of long items, then the rest
    full = F.expr("n div capacidade_tokens")
    cut = each.withColumn("full", F.when(F.col("n") > F.col("capacidade_tokens"), full).otherwise(0).cast("bigint"))
    rest = F.col("n") - F.col("full") * F.col("capacidade_tokens")
    whole = cut.where("full > 0").select("capacidade_id", "id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("full"))).alias("parte"), F.col("capacidade_tokens").alias("tokens"))
    done = whole.select("capacidade_id", F.concat_ws("-", F.lit("i"), "id", "parte").alias("recipiente"), F.lit(1).alias("posicao"), "id", "parte", F.lit(0).cast("bigint").alias("inicio"), "tokens")
    loose = cut.where((rest > 0) | (F.col("full") == 0)).select("capacidade_id", "capacidade_tokens", "id", (F.col("full") + 1).alias("parte"), rest.alias("tokens"))
    n, before, level = items.count(), None, 0
    while n:
        groups = -(-n // group_items)
        hashed = F.pmod(F.xxhash64("id", "parte", F.lit(level)), F.lit(groups))
        packed = loose.withColumn("grupo", hashed).groupBy("capacidade_id", "grupo").applyInPandas(_packer(levels), f"{_ITEM}, caixa bigint, posicao int, inicio bigint, cheia bigint")
        last = groups == 1 or (before is not None and 2 * n > before)
        if not last:
            packed = checkpoint(packed)
        placed = packed if last else packed.where("cheia = capacidade_tokens")
        done = done.unionByName(placed.select("capacidade_id", F.concat_ws("-", F.lit(f"g{level}"), "grupo", "caixa").alias("recipiente"), "posicao", "id", "parte", "inicio", "tokens"))
        if last:
            break
        loose = packed.where("cheia < capacidade_tokens").select("capacidade_id", "capacidade_tokens", "id", "parte", "tokens")
        before, level = n, level + 1
        # the capacity with the most open items decides
        n = loose.groupBy("capacidade_id").count().agg(F.max("count")).first()[0]
    return done.withColumnRenamed("id", key)


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """capacidade_id, capacidade_tokens, n_recipientes, n_minimo (least possible), tokens, sobra (unused share)."""
    boxes = packed.groupBy("capacidade_id", "recipiente").agg(F.sum("tokens").alias("tokens"))
    per = boxes.groupBy("capacidade_id").agg(F.count("*").alias("n_recipientes"), F.sum("tokens").alias("tokens"))
    caps = capacities.select(F.col("capacidade_id").cast("bigint"), F.col("capacidade_tokens").cast("bigint")).distinct()
    space = F.col("n_recipientes") * F.col("capacidade_tokens")
    return per.join(caps, "capacidade_id").select(
        "capacidade_id", "capacidade_tokens", "n_recipientes", F.ceil(F.col("tokens") / F.col("capacidade_tokens")).alias("n_minimo"), "tokens", ((space - F.col("tokens")) / space).alias("sobra")
    )


def violations(packed: DataFrame, sizes: DataFrame, capacities: DataFrame, key: str = "doc_id") -> DataFrame:
    """capacidade_id, regra, onde, n: what must not be. Containers beyond their capacity, with gaps or overlaps, or with positions that are not 1, 2, ...; texts not placed whole, or cut though they fit."""
    caps = capacities.where("capacidade_tokens >= 1").select(F.col("capacidade_id").cast("bigint"), F.col("capacidade_tokens").cast("bigint")).distinct()
    boxes = packed.groupBy("capacidade_id", "recipiente").agg(
        F.sum("tokens").alias("t"), F.count("*").alias("k"), F.max("posicao").alias("p"), F.max(F.col("inicio") + F.col("tokens")).alias("end"), F.countDistinct("posicao").alias("d")
    ).join(caps, "capacidade_id")
    row = lambda rule, where, n: (F.col("capacidade_id"), F.lit(rule).alias("regra"), where.cast("string").alias("onde"), n.cast("bigint").alias("n"))
    over = boxes.where("t > capacidade_tokens").select(*row("acima da capacidade", F.col("recipiente"), F.col("t")))
    gaps = boxes.where("`end` <> t or p <> k or d <> k").select(*row("lacuna ou sobreposição", F.col("recipiente"), F.col("t")))
    asked = sizes.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.sum(F.coalesce("tokens", F.lit(0))).alias("n"), F.count("*").alias("rows"))
    got = packed.groupBy("capacidade_id", F.col(key).alias("id")).agg(F.sum("tokens").alias("t"), F.count("*").alias("parts"))
    both = _for_each(asked, caps).join(got, ["capacidade_id", "id"], "left")
    lost = both.where("t is null or t <> n").select(*row("não colocado inteiro", F.col("id"), F.col("n")))
    least = F.greatest(F.col("rows"), F.ceil(F.col("n") / F.col("capacidade_tokens")))
    cut = both.where("rows = 1").where(F.col("parts") != least).select(*row("cortado sem necessidade", F.col("id"), F.col("n")))
    return over.unionByName(gaps).unionByName(lost).unionByName(cut)
