"""The queries on text problems (p2, p5, p6, p7, p8) over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.llm import conversations, mixing, packing, pii, quality, tokens
from lavra.session import checkpoint, table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    lex = pii.Lexicon.fit(table(spark, folder, "usuarios"))
    return pii.found(table(spark, folder, "capturas"), lex, "cap_id", ["previa", "titulo"]).withColumnRenamed("chave", "cap_id")


def p2_masked(spark: SparkSession, folder: str) -> DataFrame:
    lex = pii.Lexicon.fit(table(spark, folder, "usuarios"))
    return pii.masked(table(spark, folder, "capturas").select("seq", "cap_id", "previa", "titulo"), lex, ["previa", "titulo"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    out = conversations.named_conversations(table(spark, folder, "capturas"))
    return out.select(F.col("channel").alias("par_id"), F.col("position").cast("int").alias("ordem"), F.col("message").alias("cap_id"))


def _instant(c: str):
    return F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def p5_unnamed_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of the captures that name no conversation, and whether each would be kept."""
    out = conversations.session_report(conversations.sessions(table(spark, folder, "capturas")))
    return out.select(F.col("channel").alias("canal"), _instant("begins").alias("inicio"), "n_mensagens", "n_prompts", "n_respostas", "completa")


def p5_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """All captures as if none named its conversation: the messages of the sessions that are whole."""
    out = conversations.rebuilt(table(spark, folder, "capturas"), unnamed_only=False)
    return out.select(F.col("channel").alias("canal"), _instant("begins").alias("inicio"), F.col("position").cast("int").alias("ordem"), F.col("message").alias("cap_id"), F.col("role").alias("papel"))


def p5_gap(spark: SparkSession, folder: str) -> DataFrame:
    """The calibrated gap (in quarter octaves of seconds), and how many silences within and between named conversations it tells rightly."""
    return conversations.fit_gap(conversations.silences(table(spark, folder, "capturas")))


_P5 = r"""
WITH m AS (
  SELECT cap_id, par_id, TRY_CAST(ts AS TIMESTAMPTZ) AS inst, seq, LOWER(TRIM(COALESCE(papel, ''))) AS w,
         REGEXP_MATCHES(COALESCE(prompt, ''), '[^\s\p{Z}\p{C}]') AS hp, REGEXP_MATCHES(COALESCE(resposta, ''), '[^\s\p{Z}\p{C}]') AS hr
  FROM capturas WHERE cap_id IS NOT NULL AND REGEXP_MATCHES(COALESCE(par_id, ''), '[^\s\p{Z}\p{C}]')
  QUALIFY ROW_NUMBER() OVER (PARTITION BY cap_id ORDER BY seq) = 1),
r AS (SELECT *, CASE WHEN w IN ('prompt', 'usuario', 'user') THEN 'p' WHEN w IN ('resposta', 'assistente', 'assistant') THEN 'r'
                     WHEN hp AND NOT hr THEN 'p' WHEN hr AND NOT hp THEN 'r' END AS papel FROM m),
o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY par_id ORDER BY inst, seq, cap_id) AS ordem, COUNT(*) OVER (PARTITION BY par_id) AS n FROM r),
k AS (SELECT par_id FROM o GROUP BY par_id
      HAVING BOOL_AND(inst IS NOT NULL AND papel IS NOT NULL AND CASE WHEN papel = 'p' THEN hp ELSE hr END AND papel = CASE WHEN ordem % 2 = 1 THEN 'p' ELSE 'r' END)
         AND COUNT(*) % 2 = 0)
SELECT par_id, CAST(ordem AS INTEGER) AS ordem, cap_id FROM o WHERE par_id IN (SELECT par_id FROM k)
"""


_GAP = r"""
WITH m AS (
  SELECT cap_id AS message, CONCAT_WS(CHR(1), COALESCE(usuario, ''), COALESCE(maquina, ''), COALESCE(dominio, '')) AS canal, EPOCH_US(TRY_CAST(ts AS TIMESTAMPTZ)) AS inst, seq,
         CASE WHEN REGEXP_MATCHES(COALESCE(par_id, ''), '[^\s\p{Z}\p{C}]') THEN par_id END AS nome, LOWER(TRIM(COALESCE(papel, ''))) AS w, LOWER(TRIM(COALESCE(forma, ''))) AS f,
         REGEXP_MATCHES(COALESCE(prompt, ''), '[^\s\p{Z}\p{C}]') AS hp, REGEXP_MATCHES(COALESCE(resposta, ''), '[^\s\p{Z}\p{C}]') AS hr
  FROM capturas WHERE cap_id IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY cap_id ORDER BY seq) = 1),
g AS (SELECT CAST(FLOOR(LOG2((inst - LAG(inst) OVER w) // 1000000 + 1.5) * 4) AS INTEGER) AS passo, nome = LAG(nome) OVER w AS mesma FROM m WHERE nome IS NOT NULL AND inst IS NOT NULL
      WINDOW w AS (PARTITION BY canal ORDER BY inst, seq, message)),
h AS (SELECT passo, COUNT(*) FILTER (WHERE mesma) AS m, COUNT(*) FILTER (WHERE NOT mesma) AS o FROM g WHERE passo IS NOT NULL GROUP BY 1),
u AS (SELECT passo, SUM(m) OVER (ORDER BY passo) AS hm, SUM(o) OVER (ORDER BY passo) AS lo, SUM(m) OVER () AS m, SUM(o) OVER () AS o FROM h),
gap AS (SELECT passo, CAST(m AS BIGINT) AS mesmas, CAST(o AS BIGINT) AS outras, CAST(hm AS BIGINT) AS acertos_mesmas, CAST(o - lo AS BIGINT) AS acertos_outras FROM u ORDER BY m - hm + lo, passo LIMIT 1)
"""
_SESSIONS = lambda rows: _GAP + rf""",
r AS (SELECT *, CASE WHEN w IN ('prompt', 'usuario', 'user') THEN 'p' WHEN w IN ('resposta', 'assistente', 'assistant') THEN 'r' WHEN hp AND NOT hr THEN 'p' WHEN hr AND NOT hp THEN 'r'
                     WHEN NOT hp AND NOT hr AND f <> '' THEN CASE WHEN f = 'resposta da ia' THEN 'r' ELSE 'p' END END AS papel FROM m WHERE {rows}),
c AS (SELECT *, COALESCE(CAST(FLOOR(LOG2((inst - LAG(inst) OVER w) // 1000000 + 1.5) * 4) AS INTEGER) > (SELECT passo FROM gap), TRUE) AS novo FROM r WHERE inst IS NOT NULL AND papel IS NOT NULL
      WINDOW w AS (PARTITION BY canal ORDER BY inst, seq, message)),
d AS (SELECT *, SUM(CAST(novo AS INTEGER)) OVER (PARTITION BY canal ORDER BY inst, seq, message) AS s FROM c),
e AS (SELECT canal, STRFTIME(MAKE_TIMESTAMP(MIN(inst) OVER (PARTITION BY canal, s)), '%Y-%m-%d %H:%M:%S.%f') AS inicio, ROW_NUMBER() OVER (PARTITION BY canal, s ORDER BY inst, seq, message) AS ordem, message, papel, CASE WHEN papel = 'p' THEN hp ELSE hr END AS ok FROM d),
k AS (SELECT canal, inicio, COUNT(*) AS n_mensagens, COUNT(*) FILTER (WHERE papel = 'p') AS n_prompts, COUNT(*) FILTER (WHERE papel = 'r') AS n_respostas,
      BOOL_AND(ok AND papel = CASE WHEN ordem % 2 = 1 THEN 'p' ELSE 'r' END) AND COUNT(*) % 2 = 0 AS completa FROM e GROUP BY 1, 2)
"""  # noqa: E731


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of all documents, computed once and kept in the shared folder."""
    return checkpoint(tokens.token_sizes(table(spark, folder, "documents"), extra=["source"]))


def p6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_sizes(spark, folder), table(spark, folder, "capacidades"))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    caps = table(spark, folder, "capacidades")
    return packing.fill_report(packing.pack(_sizes(spark, folder), caps), caps)


def p6_violations(spark: SparkSession, folder: str) -> DataFrame:
    """What breaks the rules of a packing: nothing."""
    sizes, caps = _sizes(spark, folder), table(spark, folder, "capacidades")
    return packing.violations(packing.pack(sizes, caps), sizes, caps)


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_sizes(spark, folder), table(spark, folder, "misturas"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_sizes(spark, folder), table(spark, folder, "misturas"))[1]


def p7_violations(spark: SparkSession, folder: str) -> DataFrame:
    """What breaks the rules of a mix: nothing."""
    return mixing.violations(*mixing.mix(_sizes(spark, folder), table(spark, folder, "misturas")))


def _classified(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.classify(docs, quality.train(docs, table(spark, folder, "rotulos")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(spark, folder).where("classe <> 'prosa'").select("doc_id", "classe")


def p8_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """All figures of each text, with its kind and the calibrated probability."""
    return _classified(spark, folder)


def queries() -> dict:
    return {
        "p2_found": p2_found, "p2_masked": p2_masked, "p5_found": p5_found, "p5_unnamed_sessions": p5_unnamed_sessions, "p5_rebuilt": p5_rebuilt, "p5_gap": p5_gap,
        "p6_packing": p6_packing, "p6_report": p6_report, "p6_violations": p6_violations, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p7_violations": p7_violations,
        "p8_found": p8_found, "p8_statistics": p8_statistics,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p6_violations": "SELECT CAST(0 AS BIGINT) AS capacidade_id, '' AS regra, '' AS onde, CAST(0 AS BIGINT) AS n WHERE FALSE",
        "p7_violations": "SELECT CAST(0 AS INTEGER) AS mistura_id, '' AS source, '' AS regra, CAST(0 AS BIGINT) AS n WHERE FALSE",
        "p5_found": _P5, "p5_gap": _GAP + "SELECT * FROM gap",
        "p5_unnamed_sessions": _SESSIONS("nome IS NULL") + "SELECT * FROM k",
        "p5_rebuilt": _SESSIONS("TRUE") + "SELECT canal, inicio, CAST(ordem AS INTEGER) AS ordem, message AS cap_id, papel FROM e SEMI JOIN k2 USING (canal, inicio)".replace("k2", "(SELECT * FROM k WHERE completa) k2"),
    }
