"""Queries on ingestion, findings, discovery and stations over the whole test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lavra.operators import governance as G
from lavra.plans.reference import _C, _E, _SENS, _T, SQL as _REFERENCE, _captures, _dims, _events
from lavra.session import table
from lavra.streaming import streams

_SLUG = lambda c: f"COALESCE(NULLIF(REGEXP_REPLACE(SUBSTR(REPLACE(TRIM(REGEXP_REPLACE(LOWER(STRIP_ACCENTS(COALESCE({c}, ''))), '[^a-z0-9]+', ' ', 'g')), ' ', '-'), 1, 40), '-$', ''), ''), 'x')"
_N = lambda c: f"NULLIF(LOWER(TRIM({c})), '')"
_INGESTED = f"""{_C}, u AS (SELECT n, MIN(id) AS id FROM (SELECT id, {_N('nome')} AS n FROM usuarios UNION ALL SELECT id, {_N('id')} FROM usuarios) WHERE n IS NOT NULL AND id IS NOT NULL GROUP BY 1),
  f AS (SELECT {_N('nome')} AS n, MIN(id) AS id FROM ferramentas WHERE {_N('nome')} IS NOT NULL GROUP BY 1), t AS (SELECT {_N('nome')} AS n, MIN(id) AS id FROM tipos_informacao WHERE {_N('nome')} IS NOT NULL GROUP BY 1),
  g AS (SELECT c.cap_id, c.seq, c.ferramenta, c.status_fer, c.dominio, COALESCE(u.id, 'USR-EXT-' || {_SLUG('c.usuario')}) AS usuario_id, COALESCE(f.id, 'IA-EXT-' || {_SLUG("COALESCE(NULLIF(TRIM(c.dominio), ''), c.ferramenta)")}) AS ferramenta_id,
    COALESCE(t.id, 'INF-EXT-' || {_SLUG('c.tipo')}) AS informacao_id FROM c LEFT JOIN u ON u.n = {_N('c.usuario')} LEFT JOIN f ON f.n = {_N('c.ferramenta')} LEFT JOIN t ON t.n = {_N('c.tipo')})"""
_INVENTORY = "SELECT REPLACE(LOWER(STRIP_ACCENTS(nome)), ' ', '') || '.example' AS dominio, nome, status FROM ferramentas WHERE nome IS NOT NULL AND status IS NOT NULL"


def _ingested(spark, d):
    c = _captures(spark, d, "seq", "usuario", "ferramenta", "status_fer", "dominio", "tipo").where("cap_id is not null")
    return G.ingest(c, table(spark, d, "usuarios"), table(spark, d, "ferramentas"), table(spark, d, "tipos_informacao"))


def ingested_captures(spark, d):
    return _ingested(spark, d).select("cap_id", "usuario_id", "ferramenta_id", "informacao_id")


def synthesised_tools(spark, d):
    from lavra.operators.similarity import normalise

    inv = table(spark, d, "ferramentas").where("nome is not null and status is not null")
    return G.synthesised_tools(_ingested(spark, d), inv.select(F.concat(F.replace(normalise(F.col("nome")), F.lit(" "), F.lit("")), F.lit(".example")).alias("dominio"), "nome", "status"))


FINDINGS = [
    G.Finding("F-01", "regra", "alta", "not aprovada and regra_base in ('R07', 'R08', 'R09', 'R10', 'R11')"),
    G.Finding("F-02", "nivel", "alta", "risco_base <> risco_espia"),
    G.Finding("F-03", "lacuna", "media", "lacuna <> ''"),
    G.Finding("F-04", "lacuna", "media", "not aprovada and sensibilidade in ('Interna', 'Pública')"),
    G.Finding("F-05", "horario", "baixa", "fora_horario = 1 and sensibilidade in ('Confidencial', 'Crítica')"),
    G.Finding("F-06", "regra", "baixa", "regra_base = 'R99'"),
]


def audit_findings(spark, d):
    tools = _dims(spark, d, "ferramentas").select(F.col("id").alias("ferramenta_id"), (~F.startswith(F.lower("status"), F.lit("não aprovada"))).alias("aprovada"))
    return G.findings(_events(spark, d).join(tools, "ferramenta_id"), FINDINGS, "regra_base")


def _findings_sql() -> str:
    one = [
        f"SELECT '{r.id}' AS id, '{r.family}' AS familia, '{r.gravity}' AS gravidade, (SELECT COUNT(*) FROM x WHERE {r.when}) AS n, "
        f"COALESCE((SELECT STRING_AGG(id, ',' ORDER BY id) FROM (SELECT id FROM x WHERE {r.when} AND id IS NOT NULL ORDER BY id LIMIT 40)), '') AS ids, "
        f"COALESCE((SELECT STRING_AGG(b || ' (' || c || 'x)', ', ' ORDER BY c DESC, b) FROM (SELECT COALESCE(regra_base, '-') AS b, COUNT(*) AS c FROM x WHERE {r.when} GROUP BY 1)), '') AS resumo"
        for r in FINDINGS
    ]
    return f"WITH {_E}, {_T}, x AS (SELECT e.*, NOT STARTS_WITH(LOWER(t.status), 'não aprovada') AS aprovada FROM e JOIN ferramentas_a t ON e.ferramenta_id = t.id) " + " UNION ALL ".join(one)


POINTS = [
    G.Points("fora do catálogo", 3, "not catalogado"), G.Points("acesso persistente", 3, "contains(escopos, 'Arquivo')"),
    G.Points("uso disseminado", 2, "pessoas >= 5"), G.Points("várias pessoas", 1, "pessoas between 3 and 4"), G.Points("volume", 2, "volume > 1000"),
]
_LEVELS = {"critico": 7, "alto": 5, "medio": 3, "baixo": 0}


def shadow_discovery(spark, d):
    c = _captures(spark, d, "dominio", "usuario", "fonte_captura", "recebido_em", "qtd", "forma")
    seen = c.where("fonte_captura <> 'extensao'").select("dominio", F.col("usuario").alias("pessoa"), F.col("fonte_captura").alias("fonte"), F.col("recebido_em").alias("em"), F.lit(1).alias("requisicoes"), F.col("qtd").cast("bigint").alias("volume"))
    grants = c.where("fonte_captura = 'extensao'").select("dominio", F.col("usuario").alias("pessoa"), F.col("recebido_em").alias("em"), F.col("forma").alias("escopo"))
    known = c.where("fonte_captura = 'mitm'").select("dominio")
    people = table(spark, d, "usuarios").select(F.col("nome").alias("pessoa"), "area")
    return G.discover(seen, grants, known, people, POINTS, _LEVELS)


_SHADOW = f"""WITH {_C}, b AS (SELECT dominio, usuario AS pessoa, fonte_captura AS fonte, recebido_em AS em, 1 AS requisicoes, qtd AS volume, NULL AS escopo FROM c WHERE fonte_captura <> 'extensao'
    UNION ALL SELECT dominio, usuario, 'oauth', recebido_em, NULL, NULL, forma FROM c WHERE fonte_captura = 'extensao'),
  a AS (SELECT nome AS pessoa, MIN(area) AS area FROM usuarios WHERE nome IS NOT NULL GROUP BY 1), k AS (SELECT DISTINCT dominio FROM c WHERE fonte_captura = 'mitm'),
  g AS (SELECT b.dominio, COUNT(DISTINCT b.pessoa) AS pessoas, COUNT(DISTINCT a.area) AS areas, COALESCE(ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT fonte) FILTER (WHERE fonte IS NOT NULL)), ','), '') AS fontes,
      COALESCE(ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT escopo) FILTER (WHERE escopo IS NOT NULL)), ','), '') AS escopos, CAST(COALESCE(SUM(requisicoes), 0) AS BIGINT) AS requisicoes, CAST(COALESCE(SUM(volume), 0) AS BIGINT) AS volume, MIN(em) AS primeiro, MAX(em) AS ultimo
    FROM b LEFT JOIN a USING (pessoa) WHERE b.dominio IS NOT NULL GROUP BY 1),
  h AS (SELECT g.*, dominio IN (SELECT dominio FROM k WHERE dominio IS NOT NULL) AS catalogado FROM g),
  p AS (SELECT *, CAST(CASE WHEN NOT catalogado THEN 3 ELSE 0 END + CASE WHEN CONTAINS(escopos, 'Arquivo') THEN 3 ELSE 0 END + CASE WHEN pessoas >= 5 THEN 2 WHEN pessoas >= 3 THEN 1 ELSE 0 END + CASE WHEN volume > 1000 THEN 2 ELSE 0 END AS INTEGER) AS pontos,
    CONCAT_WS('; ', CASE WHEN NOT catalogado THEN 'fora do catálogo' END, CASE WHEN CONTAINS(escopos, 'Arquivo') THEN 'acesso persistente' END, CASE WHEN pessoas >= 5 THEN 'uso disseminado' WHEN pessoas >= 3 THEN 'várias pessoas' END, CASE WHEN volume > 1000 THEN 'volume' END) AS motivos FROM h)
  SELECT *, CASE WHEN pontos >= 7 THEN 'critico' WHEN pontos >= 5 THEN 'alto' WHEN pontos >= 3 THEN 'medio' ELSE 'baixo' END AS gravidade FROM p"""


def station_report(spark, d):
    """Heartbeats are the captures of 2025 by machine and source, uses those before."""
    c = table(spark, d, "capturas").select("maquina", F.col("fonte_captura").alias("fonte"), F.try_to_timestamp("recebido_em").alias("em"))
    cut = F.lit("2025-03-01").cast("timestamp")
    return G.station_report(c.where(F.col("em") >= cut), c.where(F.col("em") < cut), "2025-07-01 00:00:00", (864_000, 2_592_000), (864_000, 2_592_000))


def _light(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'ausente' WHEN EPOCH(TIMESTAMP '2025-07-01') - FLOOR(EPOCH({c})) <= 864000 THEN 'online' WHEN EPOCH(TIMESTAMP '2025-07-01') - FLOOR(EPOCH({c})) <= 2592000 THEN 'instavel' ELSE 'offline' END"


_STATION = f"""WITH c AS (SELECT COALESCE(maquina, 'desconhecida') AS maquina, fonte_captura AS f, TRY_CAST(recebido_em AS TIMESTAMP) AS em FROM capturas),
  h AS (SELECT maquina, MAX(em) FILTER (WHERE f = 'agente') AS a, MAX(em) FILTER (WHERE f = 'extensao') AS x FROM c WHERE em >= TIMESTAMP '2025-03-01' GROUP BY 1), u AS (SELECT maquina, MAX(em) FILTER (WHERE f = 'agente') AS ua, MAX(em) FILTER (WHERE f = 'extensao') AS ux FROM c WHERE em < TIMESTAMP '2025-03-01' GROUP BY 1),
  m AS (SELECT COALESCE(h.maquina, u.maquina) AS maquina, a, x, ua, ux, {_light('a')} AS fa, {_light('x')} AS fe FROM h FULL JOIN u ON h.maquina = u.maquina),
  n AS (SELECT *, (fa IN ('online', 'instavel') OR COALESCE(EPOCH(TIMESTAMP '2025-07-01') - FLOOR(EPOCH(ua)) < 2592000, FALSE)) AND fe IN ('offline', 'ausente') AS desabilitada FROM m)
  SELECT maquina, fa AS farol_agente, CASE WHEN desabilitada THEN 'desabilitada' ELSE fe END AS farol_extensao, desabilitada, STRFTIME(COALESCE(a, ua), '%Y-%m-%d %H:%M:%S') AS ultimo_agente, STRFTIME(COALESCE(x, ux), '%Y-%m-%d %H:%M:%S') AS ultimo_extensao FROM n"""


def stream_dedup_since_last(spark, d):
    """The stateful stream, drained, over the events in order of reception."""
    src = streams.source(spark, f"{d}/eventos.parquet").select("id", "usuario_id", "ferramenta_id", F.col("recebido_em").alias("quando"))
    return streams.run(streams.since_last(src, 8)).select("id", "usuario_id", "ferramenta_id")


def queries() -> dict:
    return {
        "ingested_captures": ingested_captures, "synthesised_tools": synthesised_tools, "audit_findings": audit_findings, "shadow_discovery": shadow_discovery,
        "station_report": station_report, "stream_dedup_since_last": stream_dedup_since_last,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "ingested_captures": f"WITH {_INGESTED} SELECT cap_id, usuario_id, ferramenta_id, informacao_id FROM g WHERE cap_id IS NOT NULL",
        "synthesised_tools": f"""WITH {_INGESTED}, i AS (SELECT dominio, MAX({{'nome': nome, 'status': status}}) AS inv FROM ({_INVENTORY}) GROUP BY 1),
          x AS (SELECT ferramenta_id AS id, ARG_MIN({{'f': ferramenta, 's': status_fer, 'd': dominio}}, seq) AS x, COUNT(*) AS n FROM g WHERE STARTS_WITH(ferramenta_id, 'IA-EXT-') AND cap_id IS NOT NULL GROUP BY 1),
          y AS (SELECT id, n, COALESCE(NULLIF(TRIM(inv.nome), ''), NULLIF(TRIM(x.f), ''), NULLIF(TRIM(x.d), '')) AS nome, COALESCE(NULLIF(TRIM(inv.status), ''), NULLIF(TRIM(x.s), ''), 'Não aprovada') AS status FROM x LEFT JOIN i ON i.dominio = {_N('x.x.d')})
          SELECT id, nome, status, CASE WHEN STARTS_WITH(LOWER(status), 'aprovada') THEN 'Corporativa' ELSE 'Pública' END AS tipo, n FROM y""",
        "audit_findings": _findings_sql(), "shadow_discovery": _SHADOW, "station_report": _STATION, "stream_dedup_since_last": _REFERENCE["dedup_since_last"],
    }
