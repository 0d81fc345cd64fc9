"""The queries on the general problems (p1, p3, p4) over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.operators import late_events, orphans, timestamps
from lavra.session import table

# ---- p1: late captures


def _arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """First arrivals of the captures. The collector's clock is UTC-3 all year, written without zone."""
    t = table(spark, folder, "capturas")
    event = F.unix_micros(F.try_to_timestamp(F.col("ts")))
    arrival = F.unix_micros(F.try_to_timestamp(F.col("recebido_em"))) + 3 * 3600 * 1_000_000
    return late_events.first_arrivals(t, "cap_id", event, arrival, F.coalesce(F.col("qtd"), F.lit(0)))


def _day(p):
    return F.date_format(F.date_from_unix_date(p.cast("int")), "yyyy-MM-dd")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return late_events.late_records(_arrivals(spark, folder)).select(_day(F.col("p")).alias("dia"), F.col("k").alias("cap_id"))


def p1_daily_figures(spark: SparkSession, folder: str) -> DataFrame:
    return late_events.corrected_figures(_arrivals(spark, folder)).select(
        _day(F.col("p")).alias("dia"), F.col("first").alias("n_publicado"), F.col("n").alias("n_corrigido"),
        F.col("amount").alias("qtd"), F.col("late").alias("n_atrasadas"), F.col("dropped").alias("n_fora_do_corte"),
    )


def p1_corrections(spark: SparkSession, folder: str) -> DataFrame:
    """Each day as published at its end, and by how much it was corrected at the end of each later day."""
    return late_events.changes(_arrivals(spark, folder)).select(
        _day(F.col("p")).alias("dia"), _day(F.col("em")).alias("publicado"), "n", F.col("amount").alias("qtd"), F.col("late").alias("n_atrasadas"), F.col("dropped").alias("n_fora_do_corte")
    )


_P1 = """
WITH a AS (
  SELECT cap_id, MIN(CAST(recebido_em AS TIMESTAMP)) + INTERVAL 3 HOUR AS ar, ARG_MIN(COALESCE(qtd, 0), CAST(recebido_em AS TIMESTAMP)) AS qtd,
         MIN(CAST(ts AS TIMESTAMPTZ)) AT TIME ZONE 'UTC' AS ev
  FROM capturas WHERE cap_id IS NOT NULL AND TRY_CAST(ts AS TIMESTAMPTZ) IS NOT NULL AND TRY_CAST(recebido_em AS TIMESTAMP) IS NOT NULL GROUP BY cap_id),
d AS (SELECT *, CAST(ev AS DATE) AS dia, CAST(CAST(ev AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY AS fim FROM a)
"""

# ---- p3: references without a record


def _references(spark: SparkSession, folder: str) -> list[orphans.Reference]:
    return [
        orphans.Reference("usuario_id", table(spark, folder, "usuarios")),
        orphans.Reference("ferramenta_id", table(spark, folder, "ferramentas")),
        orphans.Reference("informacao_id", table(spark, folder, "tipos_informacao")),
    ]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    out = orphans.orphans(table(spark, folder, "eventos"), _references(spark, folder))
    return out.select("campo", "mes", F.col("registro").alias("evento_id"))


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_report(table(spark, folder, "eventos"), _references(spark, folder))


_BLANK = r"'^[\s\p{Z}\p{Cf}\p{Cc}]+|[\s\p{Z}\p{Cf}\p{Cc}]+$'"
_P3 = f"""
WITH pais AS (
  SELECT 'usuario_id' AS campo, id, incluido_em AS b, excluido_em AS e FROM usuarios
  UNION ALL SELECT 'ferramenta_id', id, incluido_em, excluido_em FROM ferramentas
  UNION ALL SELECT 'informacao_id', id, incluido_em, excluido_em FROM tipos_informacao),
p AS (SELECT DISTINCT campo, LOWER(REGEXP_REPLACE(id, {_BLANK}, '', 'g')) AS chave, b, e FROM pais),
refs AS (
  SELECT id, recebido_em, 'usuario_id' AS campo, usuario_id AS v FROM eventos
  UNION ALL SELECT id, recebido_em, 'ferramenta_id', ferramenta_id FROM eventos
  UNION ALL SELECT id, recebido_em, 'informacao_id', informacao_id FROM eventos),
r AS (SELECT DISTINCT id, recebido_em, campo, LOWER(REGEXP_REPLACE(v, {_BLANK}, '', 'g')) AS chave FROM refs WHERE recebido_em IS NOT NULL),
o AS (
  SELECT r.campo, STRFTIME(r.recebido_em AT TIME ZONE 'UTC', '%Y-%m') AS mes, r.id AS evento_id, r.chave,
         CASE WHEN r.chave IN (SELECT chave FROM p WHERE p.campo = r.campo) THEN 'fora_do_periodo' ELSE 'nunca_existiu' END AS motivo
  FROM r WHERE r.chave <> '' AND NOT EXISTS (
    SELECT 1 FROM p WHERE p.campo = r.campo AND p.chave = r.chave AND (p.b IS NULL OR p.b <= r.recebido_em) AND (p.e IS NULL OR r.recebido_em < p.e)))
"""

# ---- p4: timestamps


def _zones(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "unidades").groupBy(F.col("id").alias("unidade_id")).agg(F.max(timestamps.known_zone(F.col("fuso"), timestamps.zone_names(spark))).alias("fuso"))


def _p4(spark: SparkSession, folder: str) -> DataFrame:
    """campo, registro, valor, formato, ambiguo, fonte. Each table is read once; the three fields go through one mixture step, each with sources of its own."""
    zones = _zones(spark, folder)
    ev = table(spark, folder, "eventos").select("id", "ts", "data", "unidade_id", "recebido_em").join(zones, "unidade_id", "left")
    ev = timestamps.date_candidates(timestamps.instant_candidates(ev, "ts", "data", "fuso"), "data", names=("_forma_d", "_cand_d"))
    one = lambda campo, seen, forma, cand: F.struct(F.lit(campo).alias("campo"), seen.alias("visto"), F.col(forma).alias("_forma"), F.col(cand).alias("_cand"))
    both = F.array(one("eventos.ts", F.col("recebido_em"), "_forma", "_cand"), one("eventos.data", F.lit(None).cast("timestamp"), "_forma_d", "_cand_d"))
    ev = ev.select(F.col("id").cast("string").alias("registro"), "unidade_id", F.lit(None).cast("timestamp").alias("testemunha"), F.explode(both).alias("x")).select("registro", "unidade_id", "testemunha", "x.*")
    au = table(spark, folder, "auditoria").select("id", "ts", "data", "hora", "unidade_id").join(zones, "unidade_id", "left")
    au = timestamps.instant_candidates(au, "hora", "data", "fuso").select(
        F.col("id").cast("string").alias("registro"), "unidade_id", F.try_to_timestamp(F.col("ts")).alias("testemunha"), F.lit("auditoria.hora").alias("campo"), F.lit(None).cast("timestamp").alias("visto"), "_forma", "_cand"
    )
    source = F.concat_ws(" ", "campo", F.coalesce("unidade_id", F.lit("-")))
    out = timestamps.settle(timestamps.choose(ev.unionByName(au), source, F.col("visto")), F.col("testemunha"))
    valor = F.when(F.col("campo") == "eventos.data", timestamps.date_text(F.col("s"))).otherwise(timestamps.instant_text(F.col("s")))
    return out.select("campo", "registro", valor.alias("valor"), "formato", "ambiguo", F.coalesce("unidade_id", F.lit("-")).alias("fonte"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _p4(spark, folder).where("registro is not null").select("campo", "registro", "valor").distinct()


def p4_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """How each source writes: readings by format and how many stay ambiguous."""
    return _p4(spark, folder).groupBy("campo", "fonte", "formato").agg(F.count("*").alias("n"), F.sum(F.col("ambiguo").cast("bigint")).alias("n_ambiguos"))


def queries() -> dict:
    return {
        "p1_found": p1_found, "p1_daily_figures": p1_daily_figures, "p1_corrections": p1_corrections, "p3_found": p3_found, "p3_report": p3_report,
        "p4_found": p4_found, "p4_mixture": p4_mixture,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1 + "SELECT STRFTIME(dia, '%Y-%m-%d') AS dia, cap_id FROM d WHERE ar >= fim AND ar <= fim + INTERVAL 72 HOUR",
        "p1_daily_figures": _P1 + """SELECT STRFTIME(dia, '%Y-%m-%d') AS dia,
            COUNT(*) FILTER (WHERE ar < fim) AS n_publicado, COUNT(*) FILTER (WHERE ar <= fim + INTERVAL 72 HOUR) AS n_corrigido,
            CAST(COALESCE(SUM(qtd) FILTER (WHERE ar <= fim + INTERVAL 72 HOUR), 0) AS BIGINT) AS qtd,
            COUNT(*) FILTER (WHERE ar >= fim AND ar <= fim + INTERVAL 72 HOUR) AS n_atrasadas, COUNT(*) FILTER (WHERE ar > fim + INTERVAL 72 HOUR) AS n_fora_do_corte
            FROM d GROUP BY dia""",
        "p1_corrections": _P1 + """SELECT STRFTIME(dia, '%Y-%m-%d') AS dia, STRFTIME(GREATEST(dia, CAST(ar AS DATE)), '%Y-%m-%d') AS publicado,
            COUNT(*) FILTER (WHERE ar <= fim + INTERVAL 72 HOUR) AS n, CAST(COALESCE(SUM(qtd) FILTER (WHERE ar <= fim + INTERVAL 72 HOUR), 0) AS BIGINT) AS qtd,
            COUNT(*) FILTER (WHERE ar >= fim AND ar <= fim + INTERVAL 72 HOUR) AS n_atrasadas, COUNT(*) FILTER (WHERE ar > fim + INTERVAL 72 HOUR) AS n_fora_do_corte
            FROM d GROUP BY 1, 2""",
        "p3_found": _P3 + "SELECT DISTINCT campo, mes, evento_id FROM o",
        "p3_report": _P3 + "SELECT campo, mes, motivo, COUNT(*) AS n, COUNT(DISTINCT chave) AS n_chaves FROM (SELECT DISTINCT campo, mes, evento_id, chave, motivo FROM o) GROUP BY ALL",
    }
