"""Ingestion of captures into dimensions, findings as data, discovery over two sources, station reports.

Rules are given as data (conditions in SQL, weights of points), so that which ones hold is the caller's matter.

Edge cases: null and blank names match nothing and give the id of the unknown; of several dimension rows
with one name the least id counts; captures without a domain take the tool's name for it; a null
condition does not hold; findings without rows are reported with 0; empty tables give no rows (findings:
one row each).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.functions import scalars
from lavra.functions.text import key

# ---- ingestion


def _ids(dim: DataFrame, columns: list[str], name: str) -> DataFrame:
    """n, <name>: the least id of each name (and, if asked, each id itself)."""
    each = dim.where("id is not null").select("id", F.explode(F.array(*[key(F.col(c)) for c in columns])).alias("n")).where("n is not null")
    return each.groupBy("n").agg(F.min("id").alias(name))


def ingest(captures: DataFrame, users: DataFrame, tools: DataFrame, kinds: DataFrame) -> DataFrame:
    """Adds usuario_id, ferramenta_id, informacao_id by the first step that answers: the dimension's name (users: or id), else an id made from the name (tools: from the domain)."""
    ext = lambda prefix, c: F.concat(F.lit(prefix), scalars.slug(F.coalesce(c, F.lit(""))))
    domain = F.coalesce(F.nullif(F.trim("dominio"), F.lit("")), F.col("ferramenta"))
    out = captures
    for name, column, ids, other in (
        ("usuario_id", "usuario", _ids(users, ["nome", "id"], "usuario_id"), ext("USR-EXT-", F.col("usuario"))),
        ("ferramenta_id", "ferramenta", _ids(tools, ["nome"], "ferramenta_id"), ext("IA-EXT-", domain)),
        ("informacao_id", "tipo", _ids(kinds, ["nome"], "informacao_id"), ext("INF-EXT-", F.col("tipo"))),
    ):
        out = out.withColumn("_n", key(F.col(column))).join(ids.withColumnRenamed("n", "_n"), "_n", "left").drop("_n").withColumn(name, F.coalesce(name, other))
    return out


def synthesised_tools(ingested: DataFrame, inventory: DataFrame) -> DataFrame:
    """id, nome, status, tipo, n: the tools that captures brought. The inventory (dominio, nome, status) says name and status, else the first capture of the tool (by seq), else not approved."""
    made = ingested.where(F.startswith("ferramenta_id", F.lit("IA-EXT-")))
    first = made.groupBy(F.col("ferramenta_id").alias("id")).agg(F.min_by(F.struct("ferramenta", "status_fer", "dominio"), "seq").alias("x"), F.count("*").alias("n"))
    inv = inventory.groupBy(key(F.col("dominio")).alias("d")).agg(F.max(F.struct("nome", "status")).alias("inv"))
    out = first.withColumn("d", key(F.col("x.dominio"))).join(inv, "d", "left")
    filled = lambda *cs: F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs])
    status = F.coalesce(filled(F.col("inv.status"), F.col("x.status_fer")), F.lit("Não aprovada"))
    return out.select("id", filled(F.col("inv.nome"), F.col("x.ferramenta"), F.col("x.dominio")).alias("nome"), status.alias("status"), F.when(F.startswith(F.lower(status), F.lit("aprovada")), "Corporativa").otherwise("Pública").alias("tipo"), "n")


# ---- findings


@dataclass(frozen=True)
class Finding:
    id: str
    family: str
    gravity: str  # alta, media, baixa
    when: str  # a SQL condition on the rows


GRAVITIES = ("alta", "media", "baixa")


def findings(rows: DataFrame, rules: list[Finding], by: str, key: str = "id", detail: int = 40, buckets: int = 256) -> DataFrame:
    """id, familia, gravidade, n, ids (the `detail` least, in order), resumo ("R09 (29x), R08 (3x)": the rows by the column `by`), in order of gravity and id.

    The least ids are taken within hashed buckets first, so that a finding with most of the rows is not gathered in one task.
    """
    matched = F.array_compact(F.array(*[F.when(F.coalesce(F.expr(r.when), F.lit(False)), F.lit(r.id)) for r in rules]))
    hit = rows.select(F.col(key).alias("k"), F.col(by).alias("by"), F.explode(matched).alias("id"))
    least = Window.partitionBy("id", "b").orderBy("k")
    few = hit.where("k is not null").withColumn("b", F.pmod(F.xxhash64("k"), F.lit(buckets))).withColumn("p", F.row_number().over(least)).where(F.col("p") <= detail)
    ids = few.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("k")), 1, detail).alias("ids"))
    counts = hit.groupBy("id", "by").agg(F.count("*").alias("c"))
    text = F.concat(F.coalesce("by", F.lit("-")), F.lit(" ("), F.col("c").cast("string"), F.lit("x)"))
    sums = counts.groupBy("id").agg(F.sum("c").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("m"), F.coalesce("by", F.lit("-")).alias("b"), text.alias("t")))), lambda x: x["t"]).alias("parts"))
    spark = rows.sparkSession
    asked = spark.createDataFrame([(r.id, r.family, r.gravity, GRAVITIES.index(r.gravity)) for r in rules], "id string, familia string, gravidade string, g int")
    out = asked.join(sums, "id", "left").join(ids, "id", "left").orderBy("g", "id")
    return out.select("id", "familia", "gravidade", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("ids"), F.coalesce(F.array_join("parts", ", "), F.lit("")).alias("resumo"))


# ---- discovery


@dataclass(frozen=True)
class Points:
    reason: str
    points: int
    when: str  # a SQL condition on the folded columns


def discover(traffic: DataFrame, grants: DataFrame, catalogue: DataFrame, people: DataFrame, rules: list[Points], levels: dict[str, int]) -> DataFrame:
    """dominio, catalogado, pessoas, areas, fontes, escopos, requisicoes, volume, primeiro, ultimo, pontos, motivos, gravidade.

    traffic: dominio, pessoa, fonte, em, requisicoes, volume. grants: dominio, pessoa, em, escopo (their source is oauth).
    catalogue: dominio. people: pessoa, area. levels: name and least points, of which the highest that is reached counts.
    """
    both = traffic.unionByName(grants.withColumn("fonte", F.lit("oauth")), allowMissingColumns=True).where("dominio is not null")
    areas = people.where("pessoa is not null").groupBy("pessoa").agg(F.min("area").alias("area"))
    known = catalogue.select(F.col("dominio"), F.lit(True).alias("catalogado")).where("dominio is not null").distinct()
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    folded = both.join(areas, "pessoa", "left").groupBy("dominio").agg(
        F.countDistinct("pessoa").alias("pessoas"), F.countDistinct("area").alias("areas"), joined("fonte").alias("fontes"), joined("escopo").alias("escopos"),
        F.coalesce(F.sum("requisicoes"), F.lit(0)).cast("bigint").alias("requisicoes"), F.coalesce(F.sum("volume"), F.lit(0)).cast("bigint").alias("volume"), F.min("em").alias("primeiro"), F.max("em").alias("ultimo"),
    )
    out = folded.join(known, "dominio", "left").withColumn("catalogado", F.coalesce("catalogado", F.lit(False)))
    hits = F.array_compact(F.array(*[F.when(F.coalesce(F.expr(r.when), F.lit(False)), F.struct(F.lit(r.points).alias("p"), F.lit(r.reason).alias("r"))) for r in rules]))
    out = out.withColumn("_h", hits).withColumn("pontos", F.aggregate("_h", F.lit(0), lambda a, x: a + x["p"]))
    return out.withColumns({"motivos": F.array_join(F.transform("_h", lambda x: x["r"]), "; "), "gravidade": scalars.level(F.col("pontos"), levels)}).drop("_h")


# ---- stations


def light(age: Column, fresh_s: int, stale_s: int) -> Column:
    return F.when(age.isNull(), "ausente").when(age <= fresh_s, "online").when(age <= stale_s, "instavel").otherwise("offline")


def station_report(beats: DataFrame, uses: DataFrame, now: str, agent: tuple[int, int] = (180, 900), extension: tuple[int, int] = (600, 1800)) -> DataFrame:
    """maquina, farol_agente, farol_extensao, desabilitada, ultimo_agente, ultimo_extensao; machines with heartbeats or uses, or both.

    beats: maquina, fonte, em (timestamp). uses: maquina, fonte, em. An extension without a signal on a machine whose agent lives, or has just seen a tool used, is disabled.
    """
    last = lambda df, prefix: df.groupBy(F.coalesce("maquina", F.lit("desconhecida")).alias("maquina")).agg(*[F.max(F.when(F.col("fonte") == s, F.col("em"))).alias(f"{prefix}_{s}") for s in ("agente", "extensao")])
    m = last(beats, "hb").join(last(uses, "uso"), "maquina", "full")
    age = lambda c: F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(c)
    fa, fe = light(age(F.col("hb_agente")), *agent), light(age(F.col("hb_extensao")), *extension)
    lives = fa.isin("online", "instavel") | F.coalesce(age(F.col("uso_agente")) < agent[1], F.lit(False))
    m = m.withColumns({"farol_agente": fa, "_fe": fe, "desabilitada": lives & fe.isin("offline", "ausente")})
    shown = lambda a, b: F.date_format(F.coalesce(a, b), "yyyy-MM-dd HH:mm:ss")
    return m.select("maquina", "farol_agente", F.when(F.col("desabilitada"), "desabilitada").otherwise(F.col("_fe")).alias("farol_extensao"), "desabilitada", shown("hb_agente", "uso_agente").alias("ultimo_agente"), shown("hb_extensao", "uso_extensao").alias("ultimo_extensao"))
