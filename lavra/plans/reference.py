"""Queries on lineage, discovery, validation, similarity and general joins over the whole test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lavra.functions import detect, scalars, validators
from lavra.functions.text import key
from lavra.operators import lineage as L
from lavra.operators import policy as P
from lavra.operators import similarity as S
from lavra.session import table
from lavra.sources import sinks
from lavra.streaming import streams

QUERIES: dict = {}
SQL: dict[str, str] = {}

_BLANK = r"'^[\s\p{Z}\p{Cf}\p{Cc}]+|[\s\p{Z}\p{Cf}\p{Cc}]+$'"


def _key(c: str) -> str:
    return f"NULLIF(LOWER(REGEXP_REPLACE({c}, {_BLANK}, '', 'g')), '')"


_E = f"""e AS (SELECT DISTINCT id, {_key("usuario_id")} AS usuario_id, {_key("ferramenta_id")} AS ferramenta_id, {_key("informacao_id")} AS informacao_id, informacao, ferramenta, finalidade,
  area, sensibilidade, qtd_itens, fora_horario, forma_uso, origem, risco_base, regra_base, risco_espia, regra_espia, divergente, lacuna, recebido_em AT TIME ZONE 'UTC' AS quando FROM eventos)"""


#: The columns of e.
_EVENT = (
    "id usuario_id ferramenta_id informacao_id informacao ferramenta finalidade area sensibilidade qtd_itens fora_horario forma_uso origem"
    " risco_base regra_base risco_espia regra_espia divergente lacuna recebido_em"
).split()


def _dim(name: str, cols: list[str]) -> str:
    order = ", ".join(f"{c} DESC NULLS LAST" for c in cols)
    return f"{name}_a AS (SELECT * REPLACE ({_key('id')} AS id) FROM {name} WHERE {_key('id')} IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY {_key('id')} ORDER BY incluido_em DESC NULLS LAST, excluido_em DESC NULLS FIRST, {order}) = 1)"


_U = _dim("usuarios", ["nome", "area", "cargo", "modelo", "perfil", "status"])
_T = _dim("ferramentas", ["nome", "tipo", "status", "aprovada", "publica", "logs", "controles", "finalidade"])
_SEV = "('Alto', 'Crítico', 'REVISAR')"
_SENS = "('Confidencial', 'Crítica')"
_DAY = "STRFTIME(quando, '%Y-%m-%d')"
_TIME = "'%Y-%m-%d %H:%M:%S'"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _events(spark: SparkSession, d: str) -> DataFrame:
    return L.once(table(spark, d, "eventos").select(*_EVENT))


def _dims(spark: SparkSession, d: str, name: str) -> DataFrame:
    return L.current(table(spark, d, name))


def _time(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# ---- lineage and aggregates


@query("exposure_by_information", f"""WITH {_E}, {_T} SELECT informacao_id, COUNT(*) AS eventos, COUNT(DISTINCT usuario_id) AS pessoas, COUNT(DISTINCT ferramenta_id) AS ferramentas,
  COUNT(*) FILTER (WHERE sensibilidade IN {_SENS}) AS sensiveis, COUNT(*) FILTER (WHERE risco_espia IN {_SEV}) AS em_risco, STRFTIME(MAX(quando), {_TIME}) AS ultimo,
  (ARRAY_AGG(informacao ORDER BY quando DESC, e.id DESC))[1] AS nome, (ARRAY_AGG(sensibilidade ORDER BY quando DESC, e.id DESC))[1] AS sensibilidade
  FROM e JOIN ferramentas_a t ON e.ferramenta_id = t.id GROUP BY informacao_id ORDER BY em_risco DESC, eventos DESC""")
def exposure(spark, d):
    return L.exposure(_events(spark, d), _dims(spark, d, "ferramentas")).orderBy(F.desc("em_risco"), F.desc("eventos"))


@query("lineage_search", f"""WITH {_E}, {_U}, {_T} SELECT e.id, STRFTIME(quando, {_TIME}) AS quando, e.usuario_id, u.nome AS usuario, t.nome AS nome_ferramenta, e.informacao, e.risco_espia,
  CASE WHEN e.risco_espia IN {_SEV} THEN 'ALR-' || e.id END AS alerta_id FROM e JOIN usuarios_a u ON e.usuario_id = u.id JOIN ferramentas_a t ON e.ferramenta_id = t.id
  WHERE CONTAINS(LOWER(COALESCE(e.informacao, '')), 'dados') OR CONTAINS(COALESCE(e.informacao_id, ''), 'dados') OR CONTAINS(LOWER(COALESCE(e.ferramenta, '')), 'dados') OR CONTAINS(LOWER(COALESCE(e.finalidade, '')), 'dados')""")
def lineage_search(spark, d):
    e = _events(spark, d)
    out = L.lineage(e, _dims(spark, d, "usuarios"), _dims(spark, d, "ferramentas"), L.alerts_of(e), "Dados")
    return out.orderBy(F.desc("quando"), "id").select("id", _time("quando").alias("quando"), "usuario_id", "usuario", "nome_ferramenta", "informacao", "risco_espia", "alerta_id")


@query("alerts_topk", f"""WITH {_E}, {_U} SELECT 'ALR-' || e.id AS alerta_id, STRFTIME(quando, {_TIME}) AS quando, u.nome AS usuario, e.area, e.risco_espia FROM e JOIN usuarios_a u ON e.usuario_id = u.id
  WHERE e.risco_espia = 'Crítico' ORDER BY e.quando DESC, e.id LIMIT 20""")
def alerts_topk(spark, d):
    u = _dims(spark, d, "usuarios").select(F.col("id").alias("usuario_id"), F.col("nome").alias("usuario"))
    a = L.alerts_of(_events(spark, d)).where("risco_espia = 'Crítico'").join(u, "usuario_id")
    return a.orderBy(F.desc("quando"), "evento_id").limit(20).select("alerta_id", _time("quando").alias("quando"), "usuario", "area", "risco_espia")


@query("panorama", f"""WITH {_E} SELECT COUNT(*) AS eventos, COUNT(DISTINCT usuario_id) AS usuarios, COUNT(DISTINCT ferramenta_id) AS ferramentas, COUNT(DISTINCT informacao_id) AS informacoes,
  COUNT(*) FILTER (WHERE risco_espia IN {_SEV}) AS severos, COUNT(*) FILTER (WHERE divergente = 1) AS divergentes, COUNT(*) FILTER (WHERE lacuna <> '') AS lacunas, COUNT(*) FILTER (WHERE fora_horario = 1) AS fora_horario,
  COUNT(*) FILTER (WHERE sensibilidade IN {_SENS}) AS sensiveis, COUNT(*) FILTER (WHERE usuario_id IS NULL OR ferramenta_id IS NULL) AS nao_rastreaveis, CAST(SUM(qtd_itens) AS BIGINT) AS itens FROM e""")
def panorama(spark, d):
    return L.panorama(_events(spark, d))


@query("risk_counts", f"WITH {_E} SELECT 'apurado' AS medida, risco_espia AS nivel, COUNT(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'declarado', risco_base, COUNT(*) FROM e GROUP BY 2")
def risk_counts(spark, d):
    both = F.explode(F.array(F.struct(F.lit("apurado").alias("medida"), F.col("risco_espia").alias("nivel")), F.struct(F.lit("declarado").alias("medida"), F.col("risco_base").alias("nivel"))))
    return _events(spark, d).select(both.alias("x")).groupBy("x.medida", "x.nivel").agg(F.count("*").alias("n"))


@query("daily_series", f"WITH {_E} SELECT {_DAY} AS dia, " + ", ".join(f"COUNT(*) FILTER (WHERE risco_espia = '{x}') AS n{i}" for i, x in enumerate(L.LEVELS)) + ", COUNT(*) FILTER (WHERE risco_espia IN ('Baixo', 'Médio', 'Alto', 'Crítico', 'REVISAR')) AS total FROM e GROUP BY 1")
def daily_series(spark, d):
    return L.daily_series(_events(spark, d))


@query("rule_usage", f"""WITH {_E}, r AS (SELECT 'R' || LPAD(CAST(i AS VARCHAR), 2, '0') AS regra FROM RANGE(1, 17) t(i)) SELECT r.regra, (SELECT COUNT(*) FROM e WHERE regra_base = r.regra) AS declarada, (SELECT COUNT(*) FROM e WHERE regra_espia = r.regra) AS apurada FROM r""")
def rule_usage(spark, d):
    rules = spark.range(1, 17).select(F.concat(F.lit("R"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("regra"))
    both = F.explode(F.array(F.struct(F.col("regra_base").alias("regra"), F.lit(1).alias("d"), F.lit(0).alias("a")), F.struct(F.col("regra_espia").alias("regra"), F.lit(0).alias("d"), F.lit(1).alias("a"))))
    used = _events(spark, d).select(both.alias("x")).groupBy("x.regra").agg(F.sum("x.d").alias("declarada"), F.sum("x.a").alias("apurada"))
    return rules.join(used, "regra", "left").na.fill(0)


@query("dead_rules", f"WITH {_E} SELECT 'R' || LPAD(CAST(i AS VARCHAR), 2, '0') AS regra FROM RANGE(1, 17) t(i) EXCEPT SELECT regra_espia FROM e")
def dead_rules(spark, d):
    rules = spark.range(1, 17).select(F.concat(F.lit("R"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("regra"))
    return rules.exceptAll(_events(spark, d).select(F.col("regra_espia").alias("regra")).distinct())


@query("indicators", f"""WITH {_E}, a AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE risco_espia IN {_SEV}) AS s, COUNT(*) FILTER (WHERE divergente = 1) AS v, COUNT(*) FILTER (WHERE fora_horario = 1) AS f, COUNT(DISTINCT usuario_id) AS u FROM e)
  SELECT UNNEST(['eventos', 'usuarios', 'severos por mil', 'divergentes por mil', 'fora do horario por mil']) AS nome, UNNEST([n, u, s * 1000 // n, v * 1000 // n, f * 1000 // n]) AS apurado FROM a""")
def indicators(spark, d):
    p = L.panorama(_events(spark, d))
    per = lambda c: f"{c} * 1000 div eventos"
    return p.selectExpr(f"stack(5, 'eventos', eventos, 'usuarios', usuarios, 'severos por mil', {per('severos')}, 'divergentes por mil', {per('divergentes')}, 'fora do horario por mil', {per('fora_horario')}) as (nome, apurado)")


@query("indicator_audit", f"""WITH {_E}, a AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE risco_espia IN {_SEV}) AS s FROM e)
  SELECT UNNEST(['taxa severa', 'cem por cento']) AS nome, UNNEST([(s * 2000 + n) // (n * 2) // 10 || ',' || (s * 2000 + n) // (n * 2) % 10 || '%', '100,0%']) AS texto, UNNEST([ABS(ROUND(s * 100.0 / n, 1) - 47.4) <= 0.1 + 1e-9, TRUE]) AS confere FROM a""")
def indicator_audit(spark, d):
    p = L.panorama(_events(spark, d)).select(F.explode(F.array(
        F.struct(F.lit("taxa severa").alias("nome"), L.percent(F.col("severos"), F.col("eventos")).alias("texto"), F.lit("47.4").alias("declarado")),
        F.struct(F.lit("cem por cento").alias("nome"), L.percent(F.col("eventos"), F.col("eventos")).alias("texto"), F.lit("100 %").alias("declarado")),
    )).alias("x")).select("x.*")
    return p.select("nome", "texto", L.same_measure(F.col("texto"), F.col("declarado")).alias("confere"))


@query("period_and_areas", f"WITH {_E} SELECT STRFTIME(MIN(quando), '%Y-%m-%d') AS de, STRFTIME(MAX(quando), '%Y-%m-%d') AS ate, ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT area) FILTER (WHERE area IS NOT NULL)), '|') AS areas FROM e")
def period_and_areas(spark, d):
    return _events(spark, d).agg(F.date_format(F.min("quando"), "yyyy-MM-dd").alias("de"), F.date_format(F.max("quando"), "yyyy-MM-dd").alias("ate"), F.array_join(F.array_sort(F.collect_set("area")), "|").alias("areas"))


@query("concordance", f"WITH {_E} SELECT origem, COUNT(*) AS n, COUNT(*) FILTER (WHERE risco_base = risco_espia) AS nivel, COUNT(*) FILTER (WHERE regra_base = regra_espia) AS regra FROM e GROUP BY origem")
def concordance(spark, d):
    return _events(spark, d).groupBy("origem").agg(F.count("*").alias("n"), F.count_if(F.col("risco_base") == F.col("risco_espia")).alias("nivel"), F.count_if(F.col("regra_base") == F.col("regra_espia")).alias("regra"))


@query("most_common_rules", f"""WITH {_E}, c AS (SELECT area, regra_espia, COUNT(*) AS n FROM e WHERE regra_espia IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY area ORDER BY n DESC, regra_espia) AS p FROM c)
  SELECT area, STRING_AGG(regra_espia || ' (' || n || 'x)', ', ' ORDER BY p) AS texto FROM r WHERE p <= 3 GROUP BY area""")
def most_common_rules(spark, d):
    return L.most_common(_events(spark, d), ["area"], "regra_espia")


@query("user_tool_worst", f"""WITH {_E} SELECT usuario_id, ferramenta_id, COUNT(*) AS n, MAX(CASE risco_espia WHEN 'Baixo' THEN 1 WHEN 'Médio' THEN 2 WHEN 'Alto' THEN 3 WHEN 'Crítico' THEN 4 WHEN 'REVISAR' THEN 5 ELSE 0 END) AS pior FROM e GROUP BY 1, 2""")
def user_tool_worst(spark, d):
    level = F.create_map(*[F.lit(x) for kv in P.SEVERITY.items() for x in kv])
    return _events(spark, d).groupBy("usuario_id", "ferramenta_id").agg(F.count("*").alias("n"), F.max(F.coalesce(F.try_element_at(level, F.col("risco_espia")), F.lit(0))).alias("pior"))


@query("area_sensitivity_rollup", f"WITH {_E} SELECT area, sensibilidade, GROUPING(area) AS ga, GROUPING(sensibilidade) AS gs, COUNT(*) AS n FROM e GROUP BY ROLLUP (area, sensibilidade)")
def area_sensitivity_rollup(spark, d):
    return _events(spark, d).rollup("area", "sensibilidade").agg(F.grouping("area").cast("bigint").alias("ga"), F.grouping("sensibilidade").cast("bigint").alias("gs"), F.count("*").alias("n"))


@query("area_sensitivity_crosstab", f"WITH {_E} SELECT COALESCE(area, '-') AS area, " + ", ".join(f"COUNT(*) FILTER (WHERE sensibilidade = '{x}') AS s{i}" for i, x in enumerate(("Pública", "Interna", "Confidencial", "Crítica"))) + " FROM e GROUP BY 1")
def area_sensitivity_crosstab(spark, d):
    kinds = ["Pública", "Interna", "Confidencial", "Crítica"]
    out = _events(spark, d).groupBy(F.coalesce("area", F.lit("-")).alias("area")).pivot("sensibilidade", kinds).count().na.fill(0)
    return out.select("area", *[F.col(k).alias(f"s{i}") for i, k in enumerate(kinds)])


@query("recurrence_7d", f"""WITH {_E} SELECT id, (SELECT COUNT(*) FROM e b WHERE b.usuario_id = a.usuario_id AND b.ferramenta_id = a.ferramenta_id AND b.quando >= a.quando - INTERVAL 7 DAY AND (b.quando < a.quando OR (b.quando = a.quando AND b.id < a.id))) AS anteriores
  FROM e a WHERE usuario_id IS NOT NULL AND ferramenta_id IS NOT NULL AND quando IS NOT NULL""")
def recurrence(spark, d):
    return L.recurrence(_events(spark, d))


@query("dedup_since_last", f"""WITH RECURSIVE {_E}, o AS (SELECT id, usuario_id, ferramenta_id, quando, ROW_NUMBER() OVER (PARTITION BY usuario_id, ferramenta_id ORDER BY quando, id) AS n FROM e WHERE usuario_id IS NOT NULL AND ferramenta_id IS NOT NULL AND quando IS NOT NULL),
  w AS (SELECT id, usuario_id, ferramenta_id, n, quando AS ultimo, TRUE AS fica FROM o WHERE n = 1 UNION ALL
        SELECT o.id, o.usuario_id, o.ferramenta_id, o.n, CASE WHEN o.quando - w.ultimo >= INTERVAL 8 HOUR THEN o.quando ELSE w.ultimo END, o.quando - w.ultimo >= INTERVAL 8 HOUR
        FROM w JOIN o ON o.usuario_id = w.usuario_id AND o.ferramenta_id = w.ferramenta_id AND o.n = w.n + 1)
  SELECT id, usuario_id, ferramenta_id FROM w WHERE fica""")
def dedup_since_last(spark, d):
    return L.dedup_since_last(_events(spark, d))


@query("off_hours", f"WITH {_E} SELECT id, (EXTRACT(HOUR FROM quando) >= 22 OR EXTRACT(HOUR FROM quando) < 6 OR ISODOW(quando) >= 6) AS fora FROM e WHERE quando IS NOT NULL")
def off_hours(spark, d):
    return _events(spark, d).where("quando is not null").select("id", ((F.hour("quando") >= 22) | (F.hour("quando") < 6) | (F.weekday("quando") >= 5)).alias("fora"))


@query("tool_flags", """SELECT DISTINCT id, nome, NOT STARTS_WITH(LOWER(status), 'não aprovada') AS aprovada, LOWER(TRIM(tipo)) = 'pública' AS publica, CONTAINS(LOWER(status), 'conteúdo público') AS so_publico, logs = 'Sim' AS tem_logs FROM ferramentas""")
def tool_flags(spark, d):
    t = table(spark, d, "ferramentas")
    return t.select("id", "nome", (~F.startswith(F.lower("status"), F.lit("não aprovada"))).alias("aprovada"), (F.lower(F.trim("tipo")) == "pública").alias("publica"), F.contains(F.lower("status"), F.lit("conteúdo público")).alias("so_publico"), (F.col("logs") == "Sim").alias("tem_logs")).distinct()


@query("weekday_hours_by_unit", "SELECT unidade_id, hora, COUNT(*) AS n, CAST(SUM(COALESCE(qtd_itens, 0)) AS BIGINT) AS itens FROM eventos GROUP BY ALL HAVING COUNT(*) >= 2")
def by_unit(spark, d):
    return table(spark, d, "eventos").groupBy("unidade_id", "hora").agg(F.count("*").alias("n"), F.sum(F.coalesce("qtd_itens", F.lit(0)).cast("bigint")).alias("itens")).where("n >= 2")


@query("exposure_approximate")
def exposure_approximate(spark, d):
    """Extension: the same exposure with approximate distinct counts."""
    return _events(spark, d).groupBy("informacao_id").agg(F.approx_count_distinct("usuario_id", 0.02).alias("pessoas"), F.percentile_approx("qtd_itens", 0.95).alias("p95"))


@query("area_view", f"WITH {_E} SELECT area, usuario_id, COUNT(*) AS n, STRFTIME(MAX(quando), {_TIME}) AS ultimo FROM e WHERE LIST_CONTAINS(STRING_SPLIT('Jurídico,Segurança', ','), area) GROUP BY 1, 2")
def area_view(spark, d):
    """Row-level view: only the areas in the viewer's list."""
    allowed = F.split(F.lit("Jurídico,Segurança"), ",")
    return _events(spark, d).where(F.array_contains(allowed, F.col("area"))).groupBy("area", "usuario_id").agg(F.count("*").alias("n"), _time(F.max("quando")).alias("ultimo"))


@query("monthly_partitions", f"WITH {_E} SELECT STRFTIME(quando, '%Y-%m') AS mes, COUNT(*) AS n, COUNT(DISTINCT usuario_id) AS usuarios FROM e GROUP BY 1")
def monthly_partitions(spark, d):
    return _events(spark, d).groupBy(F.date_format("quando", "yyyy-MM").alias("mes")).agg(F.count("*").alias("n"), F.countDistinct("usuario_id").alias("usuarios"))


_VERSIONS = [("v1", "2024-01-01 00:00:00"), ("v2", "2024-06-15 12:00:00"), ("v3", "2025-02-01 00:00:00")]


@query("policy_as_of", f"WITH {_E}, v(versao, desde) AS (VALUES ('v1', TIMESTAMP '2024-01-01'), ('v2', TIMESTAMP '2024-06-15 12:00:00'), ('v3', TIMESTAMP '2025-02-01')) SELECT versao, COUNT(*) AS n FROM e ASOF LEFT JOIN v ON e.quando >= v.desde GROUP BY versao")
def policy_as_of(spark, d):
    v = spark.createDataFrame(_VERSIONS, "versao string, t string").select("versao", F.col("t").cast("timestamp").alias("vigente_desde"))
    return L.as_of(_events(spark, d), v).groupBy("versao").agg(F.count("*").alias("n"))


@query("drift", f"""WITH {_E}, n AS (SELECT COALESCE(forma_uso, '-') AS categoria, COUNT(*) FILTER (WHERE NOT (quando >= TIMESTAMP '2024-10-01')) AS antes, COUNT(*) FILTER (WHERE quando >= TIMESTAMP '2024-10-01') AS depois FROM e WHERE quando IS NOT NULL GROUP BY 1),
  p AS (SELECT *, (antes + 0.5) / (SUM(antes) OVER () + 0.5 * COUNT(*) OVER ()) AS a, (depois + 0.5) / (SUM(depois) OVER () + 0.5 * COUNT(*) OVER ()) AS b FROM n) SELECT categoria, antes, depois, ROUND((b - a) * LN(b / a), 6) AS psi FROM p""")
def drift(spark, d):
    return L.drift(_events(spark, d).where("quando is not null"), "forma_uso", F.col("quando") >= F.lit("2024-10-01").cast("timestamp"))


@query("anomaly_features", f"""WITH {_E}, d AS (SELECT usuario_id, CAST(quando AS DATE) AS d, COUNT(*) AS eventos, CAST(SUM(qtd_itens) AS BIGINT) AS itens FROM e WHERE usuario_id IS NOT NULL AND quando IS NOT NULL GROUP BY 1, 2),
  f AS (SELECT usuario_id, ferramenta_id, CAST(MIN(quando) AS DATE) AS d FROM e WHERE usuario_id IS NOT NULL AND ferramenta_id IS NOT NULL AND quando IS NOT NULL GROUP BY 1, 2), g AS (SELECT usuario_id, d, COUNT(*) AS novas FROM f GROUP BY 1, 2),
  m AS (SELECT usuario_id, MEDIAN(eventos) AS mediana FROM d GROUP BY 1)
  SELECT d.usuario_id, STRFTIME(d.d, '%Y-%m-%d') AS dia, eventos, itens, ROUND(eventos / mediana, 4) AS razao, COALESCE(CAST(DATEDIFF('day', LAG(d.d) OVER (PARTITION BY d.usuario_id ORDER BY d.d), d.d) AS BIGINT), -1) AS intervalo, COALESCE(novas, 0) AS novas
  FROM d JOIN m USING (usuario_id) LEFT JOIN g ON g.usuario_id = d.usuario_id AND g.d = d.d""")
def anomaly_features(spark, d):
    return L.anomalies(_events(spark, d))


@query("volume_drop", f"""WITH {_E}, c AS (SELECT origem, CAST(quando AS DATE) AS d, COUNT(*) AS n FROM e WHERE quando IS NOT NULL GROUP BY 1, 2), w AS (SELECT origem, d, n, SUM(n) OVER (PARTITION BY origem ORDER BY d RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS antes FROM c)
  SELECT origem, STRFTIME(d, '%Y-%m-%d') AS dia, n, CAST(antes AS BIGINT) AS antes FROM w WHERE n * 14 * 2 < antes""")
def volume_drop(spark, d):
    """Days on which a source gave less than half of its daily mean of the 14 days before."""
    c = _events(spark, d).where("quando is not null").groupBy("origem", F.unix_date(F.to_date("quando")).alias("d")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("origem").orderBy("d").rangeBetween(-14, -1)
    return c.withColumn("antes", F.sum("n").over(w)).where("n * 28 < antes").select("origem", F.date_format(F.date_from_unix_date("d"), "yyyy-MM-dd").alias("dia"), "n", "antes")


# ---- policy as data

RULES = [
    P.Rule("P-IDENT", "usuario_id is null or ferramenta_id is null", "REVISAR"),
    P.Rule("P-CLASS", "informacao_id is null or sensibilidade not in ('Pública', 'Interna', 'Confidencial', 'Crítica')", "REVISAR"),
    P.Rule("P-CRIT", "sensibilidade = 'Crítica'", "Crítico"),
    P.Rule("P-VOL", "qtd_itens >= 20 and sensibilidade = 'Confidencial'", "Alto"),
    P.Rule("P-CONF", "sensibilidade = 'Confidencial'", "Médio"),
    P.Rule("P-BASE", "sensibilidade in ('Pública', 'Interna')", "Baixo"),
    P.Rule("P-HORA", "fora_horario = 1", "Baixo", contextual=True),
]
_COND = {r.id: r.when for r in RULES}
_LEVELSQL = f"CASE WHEN {_COND['P-IDENT']} OR {_COND['P-CLASS']} THEN 'REVISAR' WHEN sensibilidade = 'Crítica' THEN 'Crítico' WHEN {_COND['P-VOL']} THEN 'Alto' WHEN sensibilidade = 'Confidencial' THEN 'Médio' ELSE 'Baixo' END"
_PRINCIPAL = f"CASE WHEN {_COND['P-IDENT']} THEN 'P-IDENT' WHEN {_COND['P-CLASS']} THEN 'P-CLASS' WHEN sensibilidade = 'Crítica' THEN 'P-CRIT' WHEN {_COND['P-VOL']} THEN 'P-VOL' WHEN sensibilidade = 'Confidencial' THEN 'P-CONF' WHEN {_COND['P-BASE']} THEN 'P-BASE' ELSE '—' END"


@query("policy_levels", f"WITH {_E} SELECT id, {_LEVELSQL} AS nivel, {_PRINCIPAL} AS principal FROM e")
def policy_levels(spark, d):
    return P.evaluate(_events(spark, d), RULES).select("id", "nivel", "principal")


@query("evidence_chain", f"WITH {_E}, a AS (" + " UNION ALL ".join(f"SELECT id, {i} AS ordem, '{r.id}' AS regra, '{r.level}' AS nivel, {r.contextual} AS contextual, {P.SEVERITY[r.level]} AS s FROM e WHERE {r.when}" for i, r in enumerate(RULES)) + ") SELECT id, ROW_NUMBER() OVER (PARTITION BY id ORDER BY contextual, s DESC, ordem) AS posicao, regra, nivel, contextual FROM a")
def evidence_chain(spark, d):
    return P.chain(P.evaluate(_events(spark, d), RULES)).withColumn("posicao", F.col("posicao").cast("bigint"))


@query("whatif_transitions", f"WITH {_E}, a AS (SELECT {_LEVELSQL} AS de, CASE WHEN {_COND['P-IDENT']} OR {_COND['P-CLASS']} THEN 'REVISAR' WHEN sensibilidade IN ('Crítica', 'Confidencial') AND (sensibilidade = 'Crítica' OR qtd_itens >= 20) THEN 'Crítico' ELSE 'Baixo' END AS para FROM e) SELECT de, para, COUNT(*) AS n FROM a GROUP BY 1, 2")
def whatif(spark, d):
    return P.transitions(_events(spark, d), RULES, P.overlay(RULES, {"P-VOL": {"level": "Crítico"}, "P-CONF": {"active": False}}))


# ---- captures

_C = "c AS (SELECT * FROM capturas QUALIFY ROW_NUMBER() OVER (PARTITION BY cap_id ORDER BY seq) = 1)"


def _captures(spark, d, *cols):
    """Each capture once, by its first delivery."""
    t = table(spark, d, "capturas").select("cap_id", "seq", *cols)
    return t.groupBy("cap_id").agg(F.min_by(F.struct(*cols), "seq").alias("x")).select("cap_id", "x.*")


@query("discovery", f"""WITH {_C} SELECT dominio, COUNT(*) AS capturas, COUNT(DISTINCT usuario) AS pessoas, COUNT(DISTINCT maquina) AS maquinas, CAST(SUM(qtd) AS BIGINT) AS itens, MIN(recebido_em) AS primeiro, MAX(recebido_em) AS ultimo,
  ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT fonte_captura) FILTER (WHERE fonte_captura IS NOT NULL)), ',') AS fontes FROM c WHERE NOT EXISTS (SELECT 1 FROM ferramentas f WHERE f.status <> 'Não aprovada' AND LOWER(f.nome) = LOWER(c.ferramenta)) GROUP BY dominio""")
def discovery(spark, d):
    catalogue = table(spark, d, "ferramentas").where("status <> 'Não aprovada'")
    return L.discovery(_captures(spark, d, "dominio", "ferramenta", "usuario", "maquina", "qtd", "recebido_em", "fonte_captura"), catalogue)


@query("discovery_by_form", f"WITH {_C} SELECT COALESCE(forma, '-') AS forma, COUNT(DISTINCT dominio) AS dominios, COUNT(DISTINCT usuario) AS pessoas FROM c GROUP BY 1")
def discovery_by_form(spark, d):
    return _captures(spark, d, "forma", "dominio", "usuario").groupBy(F.coalesce("forma", F.lit("-")).alias("forma")).agg(F.countDistinct("dominio").alias("dominios"), F.countDistinct("usuario").alias("pessoas"))


@query("station_status", """WITH p AS (SELECT maquina, COUNT(*) AS n, MAX(TRY_CAST(COALESCE(recebido_em, ts) AS TIMESTAMP)) AS u, MAX(TRY_CAST(COALESCE(recebido_em, ts) AS TIMESTAMP)) FILTER (WHERE fonte_captura = 'agente') AS a,
  MAX(TRY_CAST(COALESCE(recebido_em, ts) AS TIMESTAMP)) FILTER (WHERE fonte_captura = 'extensao') AS x, MAX(TRY_CAST(COALESCE(recebido_em, ts) AS TIMESTAMP)) FILTER (WHERE fonte_captura = 'mitm') AS m FROM capturas WHERE maquina IS NOT NULL GROUP BY maquina)
  SELECT maquina, n, COALESCE(CAST(EPOCH(TIMESTAMP '2025-07-01') - FLOOR(EPOCH(a)) AS BIGINT), -1) AS idade_agente, COALESCE(CAST(EPOCH(TIMESTAMP '2025-07-01') - FLOOR(EPOCH(x)) AS BIGINT), -1) AS idade_extensao, COALESCE(CAST(EPOCH(TIMESTAMP '2025-07-01') - FLOOR(EPOCH(m)) AS BIGINT), -1) AS idade_mitm,
  CASE WHEN u IS NULL THEN 'cinza' WHEN EPOCH(TIMESTAMP '2025-07-01') - FLOOR(EPOCH(u)) <= 86400 THEN 'verde' WHEN EPOCH(TIMESTAMP '2025-07-01') - FLOOR(EPOCH(u)) <= 864000 THEN 'amarelo' ELSE 'vermelho' END AS farol FROM p""")
def station_status(spark, d):
    return L.stations(table(spark, d, "capturas"), "2025-07-01 00:00:00", 86_400, 864_000)


@query("classification_mix", f"WITH {_C} SELECT classificado_por, fonte_captura, COUNT(*) AS n FROM c GROUP BY ALL")
def classification_mix(spark, d):
    return _captures(spark, d, "classificado_por", "fonte_captura").groupBy("classificado_por", "fonte_captura").agg(F.count("*").alias("n"))


@query("learned_cases", f"WITH {_C}, s AS (SELECT CONCAT_WS(' | ', ferramenta, forma, tipo) AS assinatura, sens, recebido_em, cap_id FROM c) SELECT assinatura, COUNT(*) AS contagem, ARG_MAX(sens, (recebido_em, cap_id)) AS sens FROM s GROUP BY 1")
def learned_cases(spark, d):
    c = _captures(spark, d, "ferramenta", "forma", "tipo", "sens", "recebido_em")
    return c.groupBy(F.concat_ws(" | ", "ferramenta", "forma", "tipo").alias("assinatura")).agg(F.count("*").alias("contagem"), F.max_by("sens", F.struct("recebido_em", "cap_id")).alias("sens"))


@query("domain_canonical", """WITH i AS (SELECT DISTINCT REPLACE(LOWER(STRIP_ACCENTS(nome)), ' ', '') || '.example' AS dominio, nome FROM ferramentas), h AS (SELECT DISTINCT dominio, LOWER(dominio) AS h FROM capturas WHERE dominio IS NOT NULL AND dominio <> '')
  SELECT c.dominio, MIN(i.nome) AS ferramenta_dominio, COUNT(DISTINCT c.seq) AS n FROM capturas c JOIN h ON h.dominio = c.dominio LEFT JOIN i ON h.h = i.dominio OR ENDS_WITH(h.h, '.' || i.dominio) GROUP BY c.dominio""")
def domain_canonical(spark, d):
    tools = table(spark, d, "ferramentas").select("nome").distinct()
    inv = tools.select(F.concat(F.replace(S.normalise(F.col("nome")), F.lit(" "), F.lit("")), F.lit(".example")).alias("dominio"), "nome", F.col("nome").alias("ordem"))
    c = table(spark, d, "capturas").select("dominio").where("dominio is not null and dominio <> ''")
    per = c.groupBy("dominio").agg(F.count("*").alias("n"))
    return L.canonical_domain(per, "dominio", inv)


@query("prompt_reply_pairs", """WITH r AS (SELECT par_id, seq, prompt, resposta FROM capturas WHERE TRIM(COALESCE(par_id, '')) <> '') SELECT par_id, ARG_MIN(prompt, seq) FILTER (WHERE prompt <> '') AS prompt, ARG_MIN(resposta, seq) FILTER (WHERE resposta <> '') AS resposta FROM r GROUP BY par_id
  HAVING COUNT(*) FILTER (WHERE prompt <> '') > 0 AND COUNT(*) FILTER (WHERE resposta <> '') > 0""")
def prompt_reply_pairs(spark, d):
    first = lambda c: F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("seq"))).alias(c)
    t = table(spark, d, "capturas").where(F.trim("par_id") != "")
    return t.groupBy("par_id").agg(first("prompt"), first("resposta")).where("prompt is not null and resposta is not null")


@query("dimension_enrichment", f"""WITH {_C}, u AS (SELECT LOWER(nome) AS n, MIN(id) AS id FROM usuarios WHERE nome IS NOT NULL GROUP BY 1), f AS (SELECT LOWER(nome) AS n, MIN(id) AS id FROM ferramentas WHERE nome IS NOT NULL GROUP BY 1), t AS (SELECT LOWER(nome) AS n, MIN(id) AS id FROM tipos_informacao WHERE nome IS NOT NULL GROUP BY 1)
  SELECT c.cap_id, COALESCE(u.id, 'USR-EXT') AS usuario_id, COALESCE(f.id, 'IA-EXT') AS ferramenta_id, COALESCE(t.id, 'INF-EXT') AS informacao_id FROM c LEFT JOIN u ON u.n = LOWER(c.usuario) LEFT JOIN f ON f.n = LOWER(c.ferramenta) LEFT JOIN t ON t.n = LOWER(c.tipo)""")
def dimension_enrichment(spark, d):
    """Captures with the dimension ids of their names, first id wins; unknown names get the synthesised id."""
    out = _captures(spark, d, "usuario", "ferramenta", "tipo")
    for name, col, dim, ext in (("usuario_id", "usuario", "usuarios", "USR-EXT"), ("ferramenta_id", "ferramenta", "ferramentas", "IA-EXT"), ("informacao_id", "tipo", "tipos_informacao", "INF-EXT")):
        ids = table(spark, d, dim).where("nome is not null").groupBy(F.lower("nome").alias("n")).agg(F.min("id").alias(name))
        out = out.withColumn("n", F.lower(col)).join(ids, "n", "left").drop("n").withColumn(name, F.coalesce(name, F.lit(ext)))
    return out.select("cap_id", "usuario_id", "ferramenta_id", "informacao_id")


@query("events_and_captures", f"""WITH {_E}, {_C} SELECT STRFTIME(quando, '%Y-%m') AS mes, 'evento' AS origem, COUNT(*) AS n FROM e GROUP BY 1 UNION ALL SELECT SUBSTR(recebido_em, 1, 7), 'captura', COUNT(*) FROM c GROUP BY 1""")
def events_and_captures(spark, d):
    a = _events(spark, d).select(F.date_format("quando", "yyyy-MM").alias("mes"), F.lit("evento").alias("origem"))
    b = _captures(spark, d, "recebido_em").select(F.substring("recebido_em", 1, 7).alias("mes"), F.lit("captura").alias("origem"))
    return a.unionByName(b).groupBy("mes", "origem").agg(F.count("*").alias("n"))


@query("detection_json", """SELECT x.tipo AS tipo, COUNT(*) AS n, CAST(SUM(x.contagem) AS BIGINT) AS total FROM (SELECT UNNEST(FROM_JSON(deteccoes, '[{"tipo":"VARCHAR","contagem":"INTEGER"}]')) AS x FROM capturas WHERE JSON_VALID(deteccoes) AND STARTS_WITH(deteccoes, '[')) GROUP BY 1""")
def detection_json(spark, d):
    """Findings stored as JSON; broken JSON gives none."""
    x = F.from_json("deteccoes", "array<struct<tipo:string,contagem:int,validado:boolean>>", {"mode": "PERMISSIVE"})
    ok = table(spark, d, "capturas").where(F.try_parse_json("deteccoes").isNotNull() & F.startswith("deteccoes", F.lit("[")))
    return ok.select(F.explode(x).alias("x")).groupBy("x.tipo").agg(F.count("*").alias("n"), F.sum(F.col("x.contagem").cast("bigint")).alias("total"))


# ---- text

_NORM = "TRIM(REGEXP_REPLACE(LOWER(STRIP_ACCENTS(REPLACE(text, 'ß', '~'))), '[^a-z0-9]+', ' ', 'g'))"
_SH = f"""w AS (SELECT doc_id, LIST_FILTER(STRING_SPLIT({_NORM}, ' '), lambda x: x <> '') AS w FROM documents),
  sh AS (SELECT doc_id, w, CASE WHEN LEN(w) = 0 THEN [] WHEN LEN(w) < 5 THEN [ARRAY_TO_STRING(w, ' ')] ELSE LIST_DISTINCT([ARRAY_TO_STRING(w[i:i + 4], ' ') FOR i IN RANGE(1, LEN(w) - 3)]) END AS s FROM w)"""


@query("shingle_counts", f"WITH {_SH} SELECT doc_id, CAST(LEN(w) AS BIGINT) AS palavras, CAST(LEN(s) AS BIGINT) AS shingles FROM sh")
def shingle_counts(spark, d):
    n = S.normalise(F.col("text"))
    words = F.size(F.filter(F.split(n, " "), lambda x: x != ""))
    return table(spark, d, "documents").select("doc_id", words.cast("bigint").alias("palavras"), F.size(S.shingles(n)).cast("bigint").alias("shingles"))


@query("similar_documents", f"""WITH {_SH}, m AS (SELECT doc_id, s, ARRAY_TO_STRING(w, ' ') AS t FROM sh WHERE LEN(s) > 0), k AS (SELECT doc_id, s, MIN(doc_id) OVER (PARTITION BY t) AS classe FROM m), r AS (SELECT * FROM k WHERE doc_id = classe),
  q AS (SELECT DISTINCT classe FROM k WHERE doc_id % 50 = 0), p AS (SELECT a.classe AS consulta, b.classe AS classe, LEN(LIST_INTERSECT(a.s, b.s)) AS i, LEN(a.s) AS x, LEN(b.s) AS y FROM r a JOIN q ON q.classe = a.classe JOIN r b ON a.classe <> b.classe AND LEN(b.s) * 1.0 BETWEEN LEN(a.s) * 0.8 - 1e-9 AND LEN(a.s) / 0.8 + 1e-9)
  SELECT consulta, classe, ROUND(i * 1.0 / (x + y - i), 4) AS jaccard FROM p WHERE i * 1.0 / (x + y - i) >= 0.8 - 1e-9""")
def similar_documents(spark, d):
    return S.similar(table(spark, d, "documents"), "doc_id", "text", F.col("doc_id") % 50 == 0)


@query("copy_classes", f"WITH {_SH} SELECT doc_id, MIN(doc_id) OVER (PARTITION BY ARRAY_TO_STRING(w, ' ')) AS classe FROM w WHERE LEN(w) > 0")
def copy_classes(spark, d):
    return S.representatives(table(spark, d, "documents"), "doc_id", "text")


@query("signatures")
def signatures(spark, d):
    s = table(spark, d, "documents").select("doc_id", S.hashed_shingles(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.lower(F.hex(S.simhash(F.col("s")))).alias("simhash"), F.array_join(S.minhash(F.col("s")), "-").alias("minhash"))


_RUN = "[0-9]+(?:[ ./-][0-9]+)*"
# the same without going back: Java's stack does not hold long runs
_RUN_JAVA = "[0-9]++(?:[ ./-][0-9]++)*+"


def _sum(d: str, weights: list[int]) -> str:
    return f"LIST_SUM(LIST_TRANSFORM(RANGE(1, {len(weights) + 1}), LAMBDA i: TRY_CAST(({d})[i] AS INTEGER) * {weights}[i])) * 10 % 11 % 10"


def _checked(d: str, n: int, first: list[int], second: list[int]) -> str:
    return f"COALESCE(LENGTH({d}) = {n} AND {d} <> REPEAT(({d})[1], {n}) AND {_sum(d, first)} = TRY_CAST(({d})[{n - 1}] AS INTEGER) AND {_sum(d, second)} = TRY_CAST(({d})[{n}] AS INTEGER), FALSE)"


def _cpf(d: str) -> str:
    return _checked(d, 11, list(range(10, 1, -1)), list(range(11, 1, -1)))


def _cnpj(d: str) -> str:
    first = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    return _checked(d, 14, first, [6, *first])


def _luhn(d: str) -> str:
    one = f"TRY_CAST(REVERSE({d})[i] AS INTEGER)"
    return f"(LENGTH({d}) BETWEEN 13 AND 19 AND LIST_SUM(LIST_TRANSFORM(RANGE(1, LENGTH({d}) + 1), LAMBDA i: CASE WHEN i % 2 = 1 THEN {one} WHEN {one} > 4 THEN {one} * 2 - 9 ELSE {one} * 2 END)) % 10 = 0)"


def _found(text: str) -> dict[str, str]:
    """The number of values of each kind in a text, in SQL of its own: nothing of it is taken from the detectors."""
    d = "REGEXP_REPLACE(x, '[^0-9]', '', 'g')"
    count = lambda rx, ok=None: f"CAST(COALESCE(LEN({f'LIST_FILTER(REGEXP_EXTRACT_ALL({text}, {rx}), LAMBDA x: {ok})' if ok else f'REGEXP_EXTRACT_ALL({text}, {rx})'}), 0) AS BIGINT)"
    tax, card = "'[0-9]+(?:[./-][0-9]+)*'", "'[0-9]+(?:[ -][0-9]+)*'"
    is_card = f"{_luhn(d)} AND NOT {_cpf(d)} AND NOT {_cnpj(d)}"
    part = "[A-Za-z0-9_%+-]+"
    host = "[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
    secret = "sk-[A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9]{30,}|A[KS]IA[A-Z0-9]{16}|-----BEGIN [A-Z ]*PRIVATE KEY-----|(?i:passphrase|password|passwd|pwd|senha|segredo|secret|token|api[ _-]?key) ?[:=] ?[^ \n]{8,}"
    return {
        "cpf": count(tax, f"NOT CONTAINS(x, '/') AND {_cpf(d)}"), "cnpj": count(tax, _cnpj(d)), "cartao": f"CAST(COALESCE(LEN(FLATTEN(LIST_TRANSFORM(REGEXP_EXTRACT_ALL({text}, {card}), LAMBDA y: CASE WHEN {is_card.replace('(x,', '(y,')} THEN [y] ELSE LIST_FILTER(STRING_SPLIT(y, ' '), LAMBDA x: {is_card}) END))), 0) AS BIGINT)",
        "email": count(f"'{part}(?:\\.{part})*@{host}(?:\\.{host})+'"),
        "telefone": count(r"'(?:(?:\B\+|\b)55[ .-]?(?:\([1-9][0-9]\)|[1-9][0-9])|\B\([1-9][0-9]\)|\b[1-9][0-9])[ .-]?(?:9[ .-]?[0-9]{4}|[2-5][0-9]{3})[ .-]?[0-9]{4}\b'"),
        "chave_pix_aleatoria": count("'[0-9A-Za-z]+(?:-[0-9A-Za-z]+)*'", "REGEXP_FULL_MATCH(x, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}')"),
        "credencial": count(f"'{secret}'"),
        "conta_bancaria": count("'(?i:ag(?:ência|encia|\\.)?[ :]{1,2}[0-9]{3,5}(?:-[0-9X])?[ ,;/-]{1,3}(?:conta(?: corrente)?|c/?c|cta\\.?)[ :]{1,2}[0-9.]{4,12}-?[0-9X])'"),
        "iban_swift": f"CASE WHEN REGEXP_MATCHES({text}, '(?i)(?:^|[^a-z])(?:swift|bic|iban)(?:[^a-z]|$)') THEN {count(chr(39) + '[A-Z0-9]+' + chr(39), 'REGEXP_FULL_MATCH(x, ' + chr(39) + '[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?' + chr(39) + ')')} ELSE 0 END",
    }


_COUNTS = ", ".join(f"{sql} AS {kind}" for kind, sql in _found("text").items())


@query("detector_counts", f"SELECT doc_id, {_COUNTS} FROM documents")
def detector_counts(spark, d):
    """All kinds of detectors on documents; those with check digits count what is valid."""
    return table(spark, d, "documents").select("doc_id", *[F.size(detect.matches(F.col("text"), k)).cast("bigint").alias(k) for k in detect.KINDS])


@query("detections_by_kind", f"""WITH t AS (SELECT CONCAT_WS(' ', previa, titulo) AS text FROM capturas), c AS (SELECT {_COUNTS} FROM t), u AS (UNPIVOT c ON COLUMNS(*) INTO NAME tipo VALUE n)
  SELECT tipo, COUNT(*) AS textos, CAST(SUM(n) AS BIGINT) AS total FROM u WHERE n > 0 GROUP BY 1""")
def detections_by_kind(spark, d):
    x = table(spark, d, "capturas").select(detect.detect(F.concat_ws(" ", "previa", "titulo")).alias("f"))
    return x.select(F.explode("f").alias("x")).groupBy("x.tipo").agg(F.count("*").alias("textos"), F.sum("x.contagem").alias("total"))


@query("edge_classes", f"""WITH t AS (SELECT CONCAT_WS(' ', previa, titulo) AS text FROM capturas), c AS (SELECT {_COUNTS} FROM t),
  k AS (SELECT CASE WHEN credencial > 0 THEN 'Chave/API secret' WHEN cartao > 0 THEN 'Dado financeiro (cartão)' WHEN cpf > 0 THEN 'Dado pessoal (CPF)' WHEN conta_bancaria > 0 THEN 'Dado bancário' WHEN cnpj > 0 THEN 'Dado cadastral (CNPJ)'
    WHEN chave_pix_aleatoria > 0 THEN 'Chave Pix' WHEN email > 0 OR telefone > 0 THEN 'Dado de contato' ELSE 'Conteúdo não classificado' END AS tipo, cpf + cartao + email + telefone + conta_bancaria AS p FROM c)
  SELECT tipo, COUNT(*) AS n, CAST(SUM(p) AS BIGINT) AS pessoais FROM k GROUP BY 1""")
def edge_classes(spark, d):
    """Captures by the class that their detections give, with their personal values."""
    f = table(spark, d, "capturas").select(detect.detect(F.concat_ws(" ", "previa", "titulo")).alias("f"))
    return f.select(detect.classify(F.col("f"))["tipo"].alias("tipo"), detect.personal_total(F.col("f")).alias("p")).groupBy("tipo").agg(F.count("*").alias("n"), F.sum("p").alias("pessoais"))


def _masked_runs(text: str, run: str, case: str) -> str:
    pieces = f"LIST_TRANSFORM(REGEXP_EXTRACT_ALL({text}, '{run}|[^0-9]+'), LAMBDA x: CASE WHEN NOT REGEXP_MATCHES(x, '^[0-9]') THEN x {case} ELSE x END)"
    return f"ARRAY_TO_STRING({pieces}, '')"


_DIG = "LENGTH(REGEXP_REPLACE(x, '[^0-9]', '', 'g'))"
_PUBLISH = lambda c: _masked_runs(
    _masked_runs(c, "[0-9]+(?:[./-][0-9]+)*", f"WHEN {_DIG} = 11 AND NOT CONTAINS(x, '/') THEN '[CPF]' WHEN {_DIG} = 14 THEN '[CNPJ]' WHEN {_DIG} BETWEEN 13 AND 16 THEN '[cartão]' WHEN TRUE THEN REGEXP_REPLACE(x, '[0-9]{{6,}}', '[número]', 'g')"),
    "[0-9]+(?:[ -][0-9]+)*", f"WHEN {_DIG} BETWEEN 13 AND 16 THEN '[cartão]'",
)


@query("published_previews", f"SELECT seq, {_PUBLISH('previa')} AS previa, {_PUBLISH('titulo')} AS titulo FROM capturas")
def published_previews(spark, d):
    return table(spark, d, "capturas").select("seq", *[detect.publish(F.col(c)).alias(c) for c in ("previa", "titulo")])


@query("masked_counts")
def masked_counts(spark, d):
    """Documents with how many values the validated mask replaces."""
    m = table(spark, d, "documents").select("doc_id", detect.mask(F.col("text")).alias("m"))
    return m.select("doc_id", F.length("m.texto").alias("caracteres"), F.col("m.n").alias("n"))


@query("check_digits_of_runs", f"""WITH t AS (SELECT 'previa' AS campo, previa AS x FROM capturas UNION ALL SELECT 'titulo', titulo FROM capturas UNION ALL SELECT 'text', text FROM documents),
  r AS (SELECT campo, UNNEST(REGEXP_EXTRACT_ALL(x, '{_RUN}')) AS r FROM t), n AS (SELECT campo, REGEXP_REPLACE(r, '[^0-9]', '', 'g') AS d, COUNT(*) AS n FROM r GROUP BY 1, 2)
  SELECT campo, d, n, {_cpf("d")} AS cpf, {_cnpj("d")} AS cnpj, {_luhn("d")} AS luhn FROM n""")
def check_digits_of_runs(spark, d):
    """Every run of digits (single blanks, dots, slashes and dashes inside) of captures and documents, with the validators' answers."""
    texts = table(spark, d, "capturas").select(F.explode(F.array(*[F.struct(F.lit(c).alias("campo"), F.col(c).alias("x")) for c in ("previa", "titulo")])).alias("t")).select("t.*")
    texts = texts.unionByName(table(spark, d, "documents").select(F.lit("text").alias("campo"), F.col("text").alias("x")))
    runs = texts.select("campo", F.explode(F.regexp_extract_all("x", F.lit(_RUN_JAVA), F.lit(0))).alias("r"))
    n = runs.groupBy("campo", validators.digits(F.col("r")).alias("d")).agg(F.count("*").alias("n"))
    return n.select("campo", "d", "n", validators.cpf(F.col("d")).alias("cpf"), validators.cnpj(F.col("d")).alias("cnpj"), validators.luhn(F.col("d")).alias("luhn"))


@query("composite_keys", """SELECT DISTINCT CONCAT_WS(' | ', ferramenta, forma_uso, sensibilidade) AS assinatura, SHA256(CONCAT_WS(' | ', ferramenta, forma_uso, sensibilidade)) AS resumo, SPLIT_PART(regra_base, 'R', 2) AS numero FROM eventos""")
def composite_keys(spark, d):
    k = F.concat_ws(" | ", "ferramenta", "forma_uso", "sensibilidade")
    return table(spark, d, "eventos").select(k.alias("assinatura"), F.sha2(k, 256).alias("resumo"), F.split_part("regra_base", F.lit("R"), F.lit(2)).alias("numero")).distinct()


@query("parity_diff", f"WITH {_E}, a AS (SELECT id, risco_base AS n FROM e WHERE origem <> 'Proxy'), b AS (SELECT id, risco_espia AS n FROM e WHERE origem <> 'DLP') SELECT COALESCE(a.id, b.id) AS id, a.n AS antes, b.n AS depois FROM a FULL JOIN b ON a.id = b.id WHERE a.n IS DISTINCT FROM b.n")
def parity_diff(spark, d):
    """Full outer difference of two evaluations."""
    e = _events(spark, d)
    a, b = e.where("origem <> 'Proxy'").select("id", F.col("risco_base").alias("antes")), e.where("origem <> 'DLP'").select("id", F.col("risco_espia").alias("depois"))
    return a.join(b, "id", "full").where(~F.col("antes").eqNullSafe(F.col("depois")))


@query("reference_validity", f"""WITH {_E}, u AS (SELECT DISTINCT {_key('id')} AS id FROM usuarios) SELECT e.id, CASE WHEN u.id IS NOT NULL THEN e.usuario_id END AS usuario_id, u.id IS NOT NULL AS valido FROM e LEFT JOIN u ON u.id = e.usuario_id""")
def reference_validity(spark, d):
    """References to unknown users become null, with a flag."""
    u = table(spark, d, "usuarios").select(key(F.col("id")).alias("u")).where("u is not null").distinct()
    e = _events(spark, d).select("id", "usuario_id")
    return e.join(u, e["usuario_id"] == u["u"], "left").select("id", F.when(F.col("u").isNotNull(), F.col("usuario_id")).alias("usuario_id"), F.col("u").isNotNull().alias("valido"))


@query("slugs", r"""SELECT DISTINCT nome, CASE WHEN s = '' THEN 'x' ELSE REGEXP_REPLACE(s, '-$', '') END AS slug FROM (SELECT nome, SUBSTR(REPLACE(TRIM(REGEXP_REPLACE(LOWER(STRIP_ACCENTS(nome)), '[^a-z0-9]+', ' ', 'g')), ' ', '-'), 1, 40) AS s FROM (SELECT nome FROM usuarios UNION ALL SELECT nome FROM ferramentas UNION ALL SELECT nome FROM tipos_informacao) WHERE nome IS NOT NULL)""")
def slugs(spark, d):
    names = [table(spark, d, t).select("nome") for t in ("usuarios", "ferramentas", "tipos_informacao")]
    return names[0].union(names[1]).union(names[2]).where("nome is not null").distinct().select("nome", scalars.slug(F.col("nome")).alias("slug"))


@query("local_datetimes", r"""SELECT id, STRFTIME(TRY_STRPTIME(REPLACE(REGEXP_EXTRACT(ts, '^\s*(\d{2}/\d{2}/\d{4}[ T]\d{2}:\d{2})', 1), 'T', ' '), '%d/%m/%Y %H:%M'), '%Y-%m-%d %H:%M:%S') AS quando FROM (SELECT DISTINCT id, ts FROM eventos WHERE REGEXP_MATCHES(ts, '^\s*\d{2}/\d{2}/\d{4}[ T]\d{2}:\d{2}') AND NOT ENDS_WITH(ts, 'M'))""")
def local_datetimes(spark, d):
    t = table(spark, d, "eventos").where(F.col("ts").rlike(r"^\s*\d{2}/\d{2}/\d{4}[ T]\d{2}:\d{2}") & ~F.col("ts").endswith("M")).select("id", "ts").distinct()
    return t.select("id", _time(scalars.local_datetime(F.col("ts"))).alias("quando"))


@query("lateness", "SELECT cap_id, CAST(EPOCH(CAST(recebido_em AS TIMESTAMP) + INTERVAL 3 HOUR) - FLOOR(EPOCH(CAST(ts AS TIMESTAMPTZ))) AS BIGINT) AS atraso_s FROM (SELECT cap_id, ts, MIN(recebido_em) AS recebido_em FROM capturas WHERE ts IS NOT NULL GROUP BY 1, 2)")
def lateness(spark, d):
    """Seconds from use to first reception."""
    t = table(spark, d, "capturas").where("ts is not null").groupBy("cap_id", "ts").agg(F.min("recebido_em").alias("r"))
    return t.select("cap_id", (F.unix_seconds(F.try_to_timestamp("r")) + 10_800 - F.unix_seconds(F.try_to_timestamp("ts"))).alias("atraso_s"))


@query("capture_ids", f"WITH {_C} SELECT cap_id, 'SEQ-' || LPAD(CAST(ROW_NUMBER() OVER (ORDER BY recebido_em, cap_id) AS VARCHAR), 6, '0') AS id FROM c")
def capture_ids(spark, d):
    """Consecutive ids in order of arrival, without gathering the rows."""
    return sinks.with_ids(_captures(spark, d, "recebido_em"), ["recebido_em", "cap_id"], "SEQ-").select("cap_id", "id")


@query("event_documents")
def event_documents(spark, d):
    """Each event with its evidence as one nested JSON document."""
    e = P.evaluate(_events(spark, d), RULES)
    return sinks.documents(e.select("id", "nivel", "principal", "area"), "id", {"achados": P.chain(e)})


@query("insert_script", "SELECT DISTINCT CONCAT('INSERT INTO ferramentas (id, nome, status) VALUES (', CHR(39), id, CHR(39), ', ', CHR(39), nome, CHR(39), ', ', CHR(39), status, CHR(39), ') ON CONFLICT DO NOTHING;') AS comando FROM ferramentas")
def insert_script(spark, d):
    return sinks.insert_script(table(spark, d, "ferramentas").select("id", "nome", "status").distinct(), "ferramentas")


# ---- general joins and aggregates


def _cents(c):
    """Exact sum of amounts, in hundredths."""
    return (F.sum(F.col(c).cast("decimal(18,2)")) * 100).cast("bigint")


@query("pricing_summary", """SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_quantity AS DECIMAL(18, 2))) * 100 AS BIGINT) AS sum_qty, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18, 2))) * 100 AS BIGINT) AS sum_price, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, d):
    t = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return t.groupBy("l_returnflag", "l_linestatus").agg(_cents("l_quantity").alias("sum_qty"), _cents("l_extendedprice").alias("sum_price"), F.count("*").alias("n"))


@query("customer_exposure", """SELECT c_mktsegment, n_name, COUNT(*) AS pedidos, COUNT(DISTINCT c_custkey) AS clientes, CAST(SUM(CAST(o_totalprice AS DECIMAL(18, 2))) * 100 AS BIGINT) AS total FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def customer_exposure(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("pedidos"), F.countDistinct("c_custkey").alias("clientes"), _cents("o_totalprice").alias("total"))


@query("region_revenue", """SELECT r_name, EXTRACT(YEAR FROM o_orderdate) AS ano, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18, 2))) * 100 AS BIGINT) AS receita FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def region_revenue(spark, d):
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", F.year("o_orderdate").cast("bigint").alias("ano")).agg(_cents("l_extendedprice").alias("receita"))


@query("supplier_part_ranking", """WITH s AS (SELECT s_nationkey, l_suppkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18, 2))) * 100 AS BIGINT) AS total FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE p_size >= 10 GROUP BY 1, 2) SELECT s_nationkey, l_suppkey, total, RANK() OVER (PARTITION BY s_nationkey ORDER BY total DESC) AS pos FROM s QUALIFY pos <= 3""")
def supplier_part_ranking(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "part").where("p_size >= 10"), F.col("l_partkey") == F.col("p_partkey"))
    s = j.groupBy("s_nationkey", "l_suppkey").agg(_cents("l_extendedprice").alias("total"))
    return s.withColumn("pos", F.rank().over(Window.partitionBy("s_nationkey").orderBy(F.desc("total"))).cast("bigint")).where("pos <= 3")


@query("event_windows", "SELECT STRFTIME(TIME_BUCKET(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS inicio, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    w = F.window(F.col("ts").cast("timestamp"), "5 minutes")
    return table(spark, d, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(_time("w.start").alias("inicio"), "event_type", "n")


# ---- streams, drained; they must equal their batch forms


@query("stream_event_windows", SQL["event_windows"])
def stream_event_windows(spark, d):
    return streams.run(streams.windowed_counts(streams.source(spark, f"{d}/events.parquet"), "ts", ["event_type"]), "complete")


@query("stream_heartbeats", "SELECT maquina, fonte_captura, MAX(seq) AS seq FROM capturas GROUP BY 1, 2")
def stream_heartbeats(spark, d):
    return streams.run(streams.source(spark, f"{d}/capturas.parquet").groupBy("maquina", "fonte_captura").agg(F.max("seq").alias("seq")), "complete")


@query("stream_dedup", "SELECT DISTINCT id FROM eventos WHERE recebido_em IS NOT NULL")
def stream_dedup(spark, d):
    return streams.run(streams.deduplicated(streams.source(spark, f"{d}/eventos.parquet").select("id", "recebido_em").where("recebido_em is not null"), "id", "recebido_em", "900 days")).select("id")


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
