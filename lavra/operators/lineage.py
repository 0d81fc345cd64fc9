"""Lineage, exposure, alerts, indicators and discovery over usage events.

All take DataFrames. Identical events are expected once (see once); references are compared by key().
Dimension rows are those of current(): one per id. Joins with dimensions leave broadcasting to the
optimiser, which knows their sizes.

Edge cases: events without id and differing events of one id all count, identical ones once, and only
an event with an id has an alert that joins; at one instant, events without id come last; null references join nothing; events of unknown users or tools leave the inner joins (they
stay with include_unresolved=True); ties are broken by id; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.functions.text import key

LEVELS = ("Baixo", "Médio", "Alto", "Crítico", "REVISAR")
SEVERE = ("Alto", "Crítico", "REVISAR")
SENSITIVE = ("Confidencial", "Crítica")


def once(events: DataFrame) -> DataFrame:
    """Rows that are identical in every column once, with or without id (select the columns that matter first); references as keys; quando = reception."""
    return events.withColumns({c: key(F.col(c)) for c in ("usuario_id", "ferramenta_id", "informacao_id")}).withColumnRenamed("recebido_em", "quando").dropDuplicates()


def current(dim: DataFrame) -> DataFrame:
    """One row per id: the last one included."""
    rest = [F.col(c).desc_nulls_last() for c in dim.columns if c not in ("id", "incluido_em", "excluido_em")]
    w = Window.partitionBy("id").orderBy(F.col("incluido_em").desc_nulls_last(), F.col("excluido_em").desc_nulls_first(), *rest)
    return dim.withColumn("id", key(F.col("id"))).where("id is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ascii_like(columns: list[str], term: str, strict_ascii: bool = False) -> Column:
    """Whether any column contains the term. strict_ascii folds the case of ASCII letters only."""
    low = (lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) if strict_ascii else F.lower
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(low(F.col(c)).contains(low(F.lit(term))), F.lit(False))
    return out


def lineage(events: DataFrame, users: DataFrame, tools: DataFrame, alerts: DataFrame, term: str, include_unresolved: bool = False) -> DataFrame:
    how = "left" if include_unresolved else "inner"
    u = users.select(F.col("id").alias("usuario_id"), F.col("nome").alias("usuario"), F.col("cargo"))
    t = tools.select(F.col("id").alias("ferramenta_id"), F.col("nome").alias("nome_ferramenta"), F.col("tipo").alias("tipo_ferramenta"))
    a = alerts.select(F.col("evento_id").alias("id"), F.col("alerta_id")).distinct()
    found = events.where(ascii_like(["informacao", "informacao_id", "ferramenta", "finalidade"], term))
    return found.join(u, "usuario_id", how).join(t, "ferramenta_id", how).join(a, "id", "left")


def alerts_of(events: DataFrame) -> DataFrame:
    """One alert per event of a severe level."""
    return events.where(F.col("risco_espia").isin(*SEVERE)).select(
        F.concat(F.lit("ALR-"), F.col("id")).alias("alerta_id"), F.col("id").alias("evento_id"), "quando", "usuario_id", "area", "informacao", "risco_espia", "regra_espia"
    )


def exposure(events: DataFrame, tools: DataFrame) -> DataFrame:
    """Per information type: events, people, tools, sensitive and severe events, last use; name and sensitivity of the last event."""
    t = tools.select(F.col("id").alias("ferramenta_id"))
    last = F.struct("quando", "id")
    return events.join(t, "ferramenta_id").groupBy("informacao_id").agg(
        F.count("*").alias("eventos"), F.countDistinct("usuario_id").alias("pessoas"), F.countDistinct("ferramenta_id").alias("ferramentas"),
        F.count_if(F.col("sensibilidade").isin(*SENSITIVE)).alias("sensiveis"), F.count_if(F.col("risco_espia").isin(*SEVERE)).alias("em_risco"),
        F.date_format(F.max("quando"), "yyyy-MM-dd HH:mm:ss").alias("ultimo"), F.max_by("informacao", last).alias("nome"), F.max_by("sensibilidade", last).alias("sensibilidade"),
    )


def panorama(events: DataFrame) -> DataFrame:
    """Counters of the whole base in one pass."""
    e = F.col
    return events.agg(
        F.count("*").alias("eventos"), F.countDistinct("usuario_id").alias("usuarios"), F.countDistinct("ferramenta_id").alias("ferramentas"),
        F.countDistinct("informacao_id").alias("informacoes"), F.count_if(e("risco_espia").isin(*SEVERE)).alias("severos"), F.count_if(e("divergente") == 1).alias("divergentes"),
        F.count_if(e("lacuna") != "").alias("lacunas"), F.count_if(e("fora_horario") == 1).alias("fora_horario"), F.count_if(e("sensibilidade").isin(*SENSITIVE)).alias("sensiveis"),
        F.count_if(e("usuario_id").isNull() | e("ferramenta_id").isNull()).alias("nao_rastreaveis"), F.sum(F.col("qtd_itens").cast("bigint")).alias("itens"),
    )


def daily_series(events: DataFrame) -> DataFrame:
    out = events.groupBy(F.date_format("quando", "yyyy-MM-dd").alias("dia")).pivot("risco_espia", list(LEVELS)).count().na.fill(0)
    return out.select("dia", *[F.col(x).alias(f"n{i}") for i, x in enumerate(LEVELS)], sum((F.col(x) for x in LEVELS[1:]), F.col(LEVELS[0])).alias("total"))


def most_common(df: DataFrame, group: list[str], value: str, top: int = 3) -> DataFrame:
    """<group>, texto: "R09 (29x), R08 (3x)"; ties by value."""
    n = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*group).orderBy(F.desc("n"), value)
    best = n.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= top)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", value, "n"))), lambda x: F.concat(x[value], F.lit(" ("), x["n"].cast("string"), F.lit("x)")))
    return best.groupBy(*group).agg(F.array_join(parts, ", ").alias("texto"))


def percent(numerator: Column, denominator: Column) -> Column:
    """One decimal with a comma, half up; a dash without a denominator."""
    tenths = F.floor((numerator * 2000 + denominator) / (denominator * 2)).cast("bigint")
    return F.when(denominator == 0, "—").otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.lit(","), (tenths % 10).cast("string"), F.lit("%")))


def same_measure(a: Column, b: Column, tolerance: float = 0.1) -> Column:
    """Whether two written measures agree: numbers within the tolerance, else the same text."""
    number = lambda c: F.replace(F.regexp_replace(c, r"[%\s]", ""), F.lit(","), F.lit(".")).try_cast("double")
    x, y = number(a), number(b)
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= tolerance + 1e-9).otherwise(F.trim(a) == F.trim(b))


def recurrence(events: DataFrame, days: int = 7) -> DataFrame:
    """id, anteriores: earlier events of the same user and tool within the days before. Same instant: those with a lower id are earlier; one without id has none."""
    us = F.unix_micros("quando")
    by = Window.partitionBy("usuario_id", "ferramenta_id")
    span = by.orderBy("us").rangeBetween(-days * 86_400_000_000, 0)
    at = Window.partitionBy("usuario_id", "ferramenta_id", "us")
    e = events.where("usuario_id is not null and ferramenta_id is not null and quando is not null").withColumn("us", us)
    lower = F.when(F.col("id").isNull(), 0).otherwise(F.rank().over(at.orderBy(F.col("id").asc_nulls_last())) - 1)
    return e.select("id", (F.count("*").over(span) - F.count("*").over(at) + lower).alias("anteriores"))


def dedup_since_last(events: DataFrame, hours: int = 8) -> DataFrame:
    """The events that are emitted if an event is suppressed within the hours after the last *emitted* one of its user and tool.

    Rows are hashed by key and read in order, so a task keeps one instant per key at a time and never a group.
    """
    gap = hours * 3_600_000_000

    def run(batches):
        last_key, last = None, 0
        for pdf in batches:
            keep = []
            for k, us in zip(pdf["k"], pdf["us"]):
                ok = k != last_key or us - last >= gap
                keep.append(ok)
                if ok:
                    last_key, last = k, us
            yield pdf.loc[keep]

    e = events.where("usuario_id is not null and ferramenta_id is not null and quando is not null")
    src = e.select("id", F.concat_ws("\u0001", "usuario_id", "ferramenta_id").alias("k"), F.unix_micros("quando").alias("us"))
    out = src.repartition("k").sortWithinPartitions("k", "us", F.col("id").asc_nulls_last()).mapInPandas(run, "id string, k string, us bigint")
    parts = F.split("k", "\u0001")
    return out.select("id", parts[0].alias("usuario_id"), parts[1].alias("ferramenta_id"))


def canonical_domain(df: DataFrame, column: str, inventory: DataFrame) -> DataFrame:
    """Adds ferramenta_dominio: the first inventory entry (by ordem) whose domain is the host or a suffix of it at a dot.

    The host is exploded into its suffixes, which makes the suffix test an equi-join.
    """
    host = F.lower(F.regexp_replace(F.regexp_replace(F.trim(F.col(column)), r"^[a-zA-Z]+://", ""), r"[/:?].*$", ""))
    labels = F.split("_h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = df.select(host.alias("_h")).where("_h is not null and _h <> ''").distinct().select("_h", F.explode(suffixes).alias("dominio"))
    best = hosts.join(inventory.select("dominio", "nome", "ordem"), "dominio").groupBy("_h").agg(F.min_by("nome", "ordem").alias("ferramenta_dominio"))
    return df.withColumn("_h", host).join(best, "_h", "left").drop("_h")


def discovery(captures: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Per domain whose tool is not in the catalogue: captures, people, machines, items, first and last use, sources."""
    known = catalogue.select(F.lower("nome").alias("n")).distinct()
    c = captures.withColumn("n", F.lower("ferramenta")).join(known, "n", "left_anti")
    return c.groupBy("dominio").agg(
        F.count("*").alias("capturas"), F.countDistinct("usuario").alias("pessoas"), F.countDistinct("maquina").alias("maquinas"), F.sum(F.col("qtd").cast("bigint")).alias("itens"),
        F.min("recebido_em").alias("primeiro"), F.max("recebido_em").alias("ultimo"), F.array_join(F.array_sort(F.collect_set("fonte_captura")), ",").alias("fontes"),
    )


def stations(captures: DataFrame, as_of: str, fresh_s: int = 180, stale_s: int = 900) -> DataFrame:
    """Per machine: the last capture of each source, age in seconds at as_of (-1: none), and a light by the youngest."""
    at = F.try_to_timestamp(F.coalesce("recebido_em", "ts"))
    per = captures.where("maquina is not null").groupBy("maquina").agg(
        *[F.max(F.when(F.col("fonte_captura") == s, at)).alias(s) for s in ("agente", "extensao", "mitm")], F.max(at).alias("ultimo"), F.count("*").alias("n")
    )
    age = lambda c: F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(c)
    return per.select(
        "maquina", "n", *[F.coalesce(age(F.col(s)), F.lit(-1)).alias(f"idade_{s}") for s in ("agente", "extensao", "mitm")],
        F.when(F.col("ultimo").isNull(), "cinza").when(age(F.col("ultimo")) <= fresh_s, "verde").when(age(F.col("ultimo")) <= stale_s, "amarelo").otherwise("vermelho").alias("farol"),
    )


def as_of(events: DataFrame, versions: DataFrame, at: str = "quando", most: int = 10_000) -> DataFrame:
    """Adds versao: the version in force at each event's instant, the last whose vigente_desde is not later; null before the first.

    versions: versao, vigente_desde; at most `most` rows, else an error. They become one sorted array that
    every task holds, and an event finds its version by a search in it: no join, no shuffle.
    """
    rows = versions.select("vigente_desde", "versao").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("more versions than the bound")
    rows = sorted(r for r in rows if r[0] is not None)
    table = F.array(*[F.struct(F.lit(r[0]).cast("timestamp").alias("d"), F.lit(r[1]).alias("v")) for r in rows]) if rows else F.lit(None).cast("array<struct<d:timestamp,v:string>>")
    return events.withColumn("versao", F.try_element_at(F.filter(table, lambda x: x["d"] <= F.col(at)), F.lit(-1))["v"] if rows else F.lit(None).cast("string"))


def drift(df: DataFrame, value: str, is_new: Column) -> DataFrame:
    """Population stability index of a categorical column between the old and the new rows, by category and in all."""
    n = df.groupBy(F.coalesce(F.col(value), F.lit("-")).alias("categoria")).agg(F.count_if(~is_new).alias("antes"), F.count_if(is_new).alias("depois"))
    whole = Window.partitionBy()
    a = (F.col("antes") + 0.5) / (F.sum("antes").over(whole) + 0.5 * F.count("*").over(whole))
    b = (F.col("depois") + 0.5) / (F.sum("depois").over(whole) + 0.5 * F.count("*").over(whole))
    return n.select("categoria", "antes", "depois", F.round((b - a) * F.log(b / a), 6).alias("psi"))


def anomalies(events: DataFrame) -> DataFrame:
    """Per user and day: events, items, ratio to the user's median day, days since the previous one (-1: none), number of new tools."""
    e = events.where("usuario_id is not null and quando is not null")
    day = e.groupBy("usuario_id", F.to_date("quando").alias("d")).agg(F.count("*").alias("eventos"), F.sum(F.col("qtd_itens").cast("bigint")).alias("itens"))
    first = e.where("ferramenta_id is not null").groupBy("usuario_id", "ferramenta_id").agg(F.to_date(F.min("quando")).alias("d")).groupBy("usuario_id", "d").agg(F.count("*").alias("novas"))
    med = day.groupBy("usuario_id").agg(F.median("eventos").alias("mediana"))
    order = Window.partitionBy("usuario_id").orderBy("d")
    out = day.join(first, ["usuario_id", "d"], "left").join(med, "usuario_id").withColumn("intervalo", F.datediff("d", F.lag("d").over(order)))
    return out.select("usuario_id", F.date_format("d", "yyyy-MM-dd").alias("dia"), "eventos", "itens", F.round(F.col("eventos") / F.col("mediana"), 4).alias("razao"), F.coalesce(F.col("intervalo").cast("bigint"), F.lit(-1)).alias("intervalo"), F.coalesce("novas", F.lit(0)).alias("novas"))
