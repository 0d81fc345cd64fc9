"""Mixing sources to target weights by Pfair scheduling.

Each source is a stream of blocks of tokens. Block k of a source with weight w may not start before
k / w and is due by (k + 1) / w, in slots of one block; of the released blocks the one with the
earliest deadline comes next. At any time a source is less than one block from its share. Weights are
never rounded: release and deadline are whole numbers made from the quotas. The schedule is cut into
stretches of STRETCH slots. How many blocks each source has had at their ends follows from the same
rule, on the driver; the stretches themselves are scheduled by the tasks, and every text finds the slot
of its first block by a join. A text longer than a block holds the slots of all blocks it covers, so
its source pauses until the others have caught up.

The size of a mix is the largest at which every capped source suffices: the least of tokens x cap /
weight. Without any cap it is the tokens of all its sources. A text is used whole; uses of a source go
round by round over all its texts in a fixed hashed order, so no text is used twice before all were
used once, and none beyond the cap. The text that would pass the quota is left out, and what is missing
is filled with the texts of up to one block that come after it: a source ends less than one block below
its quota, unless too few of its texts are that short, and never above it.

Edge cases: source names are compared without case and surrounding white space; sources without a
positive weight are left out; sources without any token (or absent from the documents) are left out and
reported with share 0, their weight goes to the others in proportion; a source listed twice in a mix
has the sum of its weights and its lowest cap; texts without tokens, without source or in no mix are not used; a
cap of 0 or less leaves the source out; the mixes' table may have up to 10,000 rows, of which the plan
is made on the driver; empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lavra.functions.text import key

STRETCH = 100_000
_BUCKETS = 1024


def ends(blocks: dict[str, int], stretch: int = STRETCH) -> list[dict[str, int]]:
    """Blocks that each source has had at slots 0, stretch, 2 stretch, ... and at the end: those that are due, then the earliest deadlines."""
    total = sum(blocks.values())
    out = [dict.fromkeys(blocks, 0)]
    for t in [*range(stretch, total, stretch), total] if total else []:
        had = {s: max(out[-1][s], t * k // total) for s, k in blocks.items()}
        later = sorted((-(-(had[s] + 1) * total // k), s) for s, k in blocks.items() if had[s] < k)
        for _, s in later[: max(0, t - sum(had.values()))]:
            had[s] += 1
        out.append(had)
    return out


def schedule(blocks: dict[str, int], begin: dict[str, int], end: dict[str, int]) -> list[tuple[int, str, int]]:
    """(slot, source, block) of the stretch between two ends: earliest deadline first among the released."""
    total, at = sum(blocks.values()), sum(begin.values())
    jobs = sorted((k * total // n, -(-(k + 1) * total // n), s, k) for s, n in blocks.items() for k in range(begin[s], end[s]))
    ready: list[tuple[int, str, int]] = []
    out, i = [], 0
    for t in range(at, at + len(jobs)):
        while i < len(jobs) and (jobs[i][0] <= t or not ready):
            heapq.heappush(ready, jobs[i][1:])
            i += 1
        _, s, k = heapq.heappop(ready)
        out.append((t, s, k))
    return out


def slots(spark: SparkSession, mixes: dict[int, dict[str, int]]) -> DataFrame:
    """mistura_id, source, bloco, vaga for all blocks of all mixes (mix -> source -> number of blocks); each stretch is one task's row."""
    rows = []
    for m, blocks in mixes.items():
        names = sorted(blocks)
        at = ends(blocks)
        rows += [(m, names, [blocks[s] for s in names], [a[s] for s in names], [b[s] for s in names]) for a, b in zip(at, at[1:])]
    plan = spark.createDataFrame(rows, "m int, names array<string>, blocks array<bigint>, a array<bigint>, b array<bigint>")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                of = lambda x: dict(zip(r.names, map(int, x)))
                got = schedule(of(r.blocks), of(r.a), of(r.b))
                yield pd.DataFrame({"mistura_id": r.m, "source": [g[1] for g in got], "bloco": [g[2] for g in got], "vaga": [g[0] for g in got]})

    return plan.repartition(max(1, min(len(rows), 1000))).mapInPandas(run, "mistura_id int, source string, bloco bigint, vaga bigint")


@dataclass(frozen=True)
class Share:
    mix: int
    source: str
    weight: float  # after leaving out what can't be had, sums to 1
    target: float  # as asked for, sums to 1
    cap: int | None
    tokens: int
    quota: int


def plan(mixes: list[tuple], available: dict[str, int]) -> list[Share]:
    """mixes: rows of (mix, source, weight, cap)."""
    out = []
    for mix in sorted({m[0] for m in mixes if m[0] is not None}):
        weight: dict[str, float] = {}
        cap: dict[str, int | None] = {}
        for _, s, w, c in (m for m in mixes if m[0] == mix):
            if s is None or w is None or not w > 0:
                continue
            weight[s] = weight.get(s, 0.0) + w
            caps = [x for x in (cap.get(s), c) if x is not None]
            cap[s] = min(caps) if caps else None
        asked = sum(weight.values())
        real = {s: w for s, w in weight.items() if available.get(s, 0) > 0 and (cap[s] is None or cap[s] > 0)}
        total = sum(real.values())
        limits = [available[s] * cap[s] / (w / total) for s, w in real.items() if cap[s] is not None]
        size = min(limits) if limits else sum(available[s] for s in real)
        for s, w in sorted(weight.items()):
            r = w / total if s in real else 0.0
            quota = int(size * r + 1e-6)
            out.append(Share(mix, s, r, w / asked, cap[s], available.get(s, 0), quota))
    return out


def mix(sizes: DataFrame, mixes: DataFrame, doc: str = "doc_id", block: int = 2048) -> tuple[DataFrame, DataFrame]:
    """(uses, shares). sizes: <doc>, source, tokens; it is read several times, give it checkpointed.

    uses: mistura_id, source, <doc>, repeticao (from 1), bloco, vaga (slot in the mix), inicio (token offset
    in its source), tokens. shares: mistura_id, source, alvo, obtido, tokens, cota, n_textos, n_usos,
    maior_repeticao, limite, desvio_maximo (see deviation), maior_texto.
    """
    spark = sizes.sparkSession
    asked = mixes.select("mistura_id", key(F.col("source")).alias("s"), "peso_alvo", "max_repeticoes").limit(10_001).collect()
    if len(asked) > 10_000:
        raise ValueError("more than 10,000 rows of mixes")
    wanted = sorted({r[1] for r in asked if r[1] is not None})
    texts = sizes.select(F.col(doc).alias("doc"), key(F.col("source")).alias("source"), F.col("tokens").cast("bigint").alias("tokens"))
    texts = texts.where(F.col("source").isin(wanted) & (F.col("tokens") > 0) & F.col("doc").isNotNull())
    texts = texts.withColumns({"h": F.xxhash64("doc"), "short": F.when(F.col("tokens") <= block, F.col("tokens")).otherwise(0)}).withColumn("bucket", F.pmod("h", F.lit(_BUCKETS)))
    # running sums in two steps: within a bucket of a source, and over the source's buckets
    sums = texts.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"), F.sum("short").alias("ns"))
    available = {r["source"]: r["n"] for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    shares = plan([tuple(r) for r in asked], available)
    own = [s for s in shares if s.weight > 0 and s.quota > 0]
    chosen = spark.createDataFrame([(s.mix, s.source, s.quota // s.tokens, s.quota % s.tokens, s.tokens) for s in own], "mistura_id int, source string, rounds bigint, q bigint, avail bigint")
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.coalesce(F.sum("ns").over(earlier), F.lit(0)).alias("before_short"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = texts.withColumns({"upto": F.sum("tokens").over(inside), "upto_short": F.sum("short").over(inside)}).join(offsets, ["source", "bucket"])
    placed = placed.select("doc", "source", "tokens", "short", (F.col("before") + F.col("upto")).alias("stop"), (F.col("before_short") + F.col("upto_short")).alias("stop_short"))
    each = placed.join(chosen, "source")
    # the last round goes as far as texts fit; the gap behind is filled with short ones after the text that did not
    fits = F.col("stop") <= F.col("q")
    gap = each.groupBy("mistura_id", "source").agg(
        F.coalesce(F.max(F.when(fits, F.col("stop"))), F.lit(0)).alias("full"), F.coalesce(F.max(F.when(F.col("stop") - F.col("tokens") < F.col("q"), F.col("stop_short"))), F.lit(0)).alias("s0")
    )
    each = each.join(gap, ["mistura_id", "source"])
    behind = F.col("stop_short") - F.col("s0")
    filler = (F.col("stop") - F.col("tokens") >= F.col("q")) & (F.col("short") > 0) & (behind <= F.col("q") - F.col("full"))
    used = each.withColumn("uses", F.col("rounds") + F.when(fits | filler, 1).otherwise(0)).where("uses > 0")
    start = F.when((F.col("r") < F.col("rounds")) | fits, F.col("stop") - F.col("tokens")).otherwise(F.col("full") + behind - F.col("tokens")) + F.col("r") * F.col("avail")
    one = used.select("*", F.explode(F.sequence(F.lit(0), (F.col("uses") - 1).cast("int"))).alias("r")).withColumn("inicio", start).withColumn("bloco", F.expr(f"inicio div {block}"))
    blocks: dict[int, dict[str, int]] = {}
    for s in own:
        blocks.setdefault(s.mix, {})[s.source] = -(-s.quota // block)
    uses = one.join(slots(spark, blocks), ["mistura_id", "source", "bloco"]).select(
        "mistura_id", "source", F.col("doc").alias(doc), (F.col("r") + 1).alias("repeticao"), "bloco", "vaga", "inicio", "tokens"
    )
    got = used.groupBy("mistura_id", "source").agg(
        F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("n_textos"), F.sum("uses").alias("n_usos"), F.max("uses").alias("maior_repeticao"), F.max("tokens").alias("maior_texto")
    )
    targets = spark.createDataFrame([(s.mix, s.source, s.target, s.weight, s.cap, s.quota) for s in shares], "mistura_id int, source string, alvo double, peso double, limite int, cota bigint")
    report = targets.join(got, ["mistura_id", "source"], "left").join(deviation(uses, targets), ["mistura_id", "source"], "left")
    report = report.na.fill(0, ["tokens", "n_textos", "n_usos", "maior_repeticao", "maior_texto"]).na.fill(0.0, ["desvio_maximo"])
    all_of = F.sum("tokens").over(Window.partitionBy("mistura_id"))
    report = report.withColumn("obtido", F.when(all_of > 0, F.col("tokens") / all_of).otherwise(0.0))
    return uses, report.select("mistura_id", "source", "alvo", "obtido", "tokens", "cota", "n_textos", "n_usos", "maior_repeticao", "limite", "desvio_maximo", "maior_texto")


def deviation(uses: DataFrame, weights: DataFrame, slots_a_chunk: int = 2_000) -> DataFrame:
    """mistura_id, source, desvio_maximo: by how many tokens a source is at most ahead of or behind its share of all tokens so far, before or after any of its texts.

    Running sums in two steps, within chunks of slots and over chunks. weights: mistura_id, source, peso.
    """
    u = uses.withColumn("chunk", F.expr(f"vaga div {slots_a_chunk}"))
    sums = u.groupBy("mistura_id", "chunk", "source").agg(F.sum("tokens").alias("n"))
    whole = sums.groupBy("mistura_id", "chunk").agg(F.sum("n").alias("n"))
    prior = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums, whole = sums.withColumn("x0", prior("mistura_id", "source")).drop("n"), whole.withColumn("t0", prior("mistura_id")).drop("n")
    order = ("vaga", "source", "inicio")
    run = lambda *by: F.sum("tokens").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    u = u.withColumns({"x": run("mistura_id", "chunk", "source"), "t": run("mistura_id", "chunk")})
    u = u.join(sums, ["mistura_id", "chunk", "source"]).join(whole, ["mistura_id", "chunk"]).join(weights.select("mistura_id", "source", "peso"), ["mistura_id", "source"])
    x, t = F.col("x") + F.col("x0"), F.col("t") + F.col("t0")
    off = lambda back: F.abs(x - back - F.col("peso") * (t - back))
    return u.groupBy("mistura_id", "source").agg(F.max(F.greatest(off(F.lit(0)), off(F.col("tokens")))).alias("desvio_maximo"))


def violations(uses: DataFrame, shares: DataFrame, doc: str = "doc_id", block: int = 2048) -> DataFrame:
    """mistura_id, source, regra, n: what must not be. A text used beyond the cap or twice before all were used; a source above its quota, or a block and more from its share in the running mix beside the rest of one text of each source."""
    row = lambda rule, n: ("mistura_id", "source", F.lit(rule).alias("regra"), n.cast("bigint").alias("n"))
    per = uses.groupBy("mistura_id", "source", doc).agg(F.count("*").alias("k"), F.max("repeticao").alias("last"))
    caps = shares.select("mistura_id", "source", "limite", "maior_repeticao")
    over = per.join(caps, ["mistura_id", "source"]).where("k > limite or k <> last").select(*row("acima do limite", F.col("k")))
    early = per.groupBy("mistura_id", "source").agg(F.max("k").alias("most"), F.min("k").alias("least")).where("most - least > 1 and least >= 1").select(*row("repetido antes de todos", F.col("most")))
    above = shares.where("tokens > cota").select(*row("acima da cota", F.col("tokens")))
    rest = F.sum("maior_texto").over(Window.partitionBy("mistura_id"))
    far = shares.withColumn("resto", rest).where(F.col("desvio_maximo") >= block + F.col("resto")).select(*row("longe da parte", F.col("desvio_maximo")))
    return over.unionByName(early).unionByName(above).unionByName(far)
