import datetime as dt

from pyspark.sql import functions as F

from lavra.operators import governance as G
from lavra.streaming import streams

T = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)


def test_ingestion_takes_the_first_step_that_answers(spark):
    dim = lambda rows: spark.createDataFrame(rows, "id string, nome string")
    users, tools, kinds = dim([("U2", "Ana"), ("U1", "ANA "), ("U3", None)]), dim([("T1", "Chat")]), dim([])
    rows = [(1, "c1", " ana", "chat", "x.example", "Contrato", None), (2, "c2", "u3", "Outro", "New.Example", None, "Aprovada"), (3, "c3", None, "Mais", "New.Example", "", ""), (4, "c4", "Zé", "Só", None, "a", None)]
    c = spark.createDataFrame(rows, "seq int, cap_id string, usuario string, ferramenta string, dominio string, tipo string, status_fer string").withColumn("nome", F.lit("clash"))
    out = G.ingest(c, users, tools, kinds)
    got = {r["cap_id"]: (r["usuario_id"], r["ferramenta_id"], r["informacao_id"]) for r in out.collect()}
    assert got == {"c1": ("U1", "T1", "INF-EXT-contrato"), "c2": ("U3", "IA-EXT-new-example", "INF-EXT-x"), "c3": ("USR-EXT-x", "IA-EXT-new-example", "INF-EXT-x"), "c4": ("USR-EXT-ze", "IA-EXT-so", "INF-EXT-a")}
    inv = spark.createDataFrame([("new.example", "Novo", "Não aprovada")], "dominio string, nome string, status string")
    made = lambda i: {r["id"]: tuple(r)[1:] for r in G.synthesised_tools(out, i).collect()}
    assert made(inv) == {"IA-EXT-new-example": ("Novo", "Não aprovada", "Pública", 2), "IA-EXT-so": ("Só", "Não aprovada", "Pública", 1)}
    assert made(inv.where("false"))["IA-EXT-new-example"] == ("Outro", "Aprovada", "Corporativa", 2)
    assert G.ingest(c.where("false"), users, tools, kinds).count() == 0


def test_findings_are_ordered_and_capped(spark):
    df = spark.createDataFrame([(f"e{i:04d}", i, "R1" if i % 3 else None) for i in range(500)] + [(None, 7, "R2")], "id string, n int, regra string")
    rules = [G.Finding("B", "f", "baixa", "n >= 0"), G.Finding("A", "f", "alta", "n % 100 = 7"), G.Finding("C", "f", "alta", "n < 0 or null")]
    got = [tuple(r) for r in G.findings(df, rules, "regra", detail=3).collect()]
    assert [g[0] for g in got] == ["A", "C", "B"]
    assert got[0][3:] == (6, "e0007,e0107,e0207", "R1 (4x), - (1x), R2 (1x)") and got[1][3:] == (0, "", "") and got[2][3:5] == (501, "e0000,e0001,e0002")
    assert [r["n"] for r in G.findings(df.where("false"), rules, "regra").collect()] == [0, 0, 0]


def test_discovery_over_two_sources(spark):
    t = spark.createDataFrame([("a", f"p{i}", "proxy", f"2024-01-0{i + 1}", 2, 10) for i in range(5)] + [("b", None, "proxy", "2024-02-01", None, None), (None, "p1", "proxy", "x", 1, 1)], "dominio string, pessoa string, fonte string, em string, requisicoes int, volume int")
    g = spark.createDataFrame([("a", "p9", "2024-03-01", "drive")], "dominio string, pessoa string, em string, escopo string")
    people = spark.createDataFrame([("p0", "X"), ("p1", "Y"), (None, "Z")], "pessoa string, area string")
    rules = [G.Points("fora", 3, "not catalogado"), G.Points("drive", 3, "contains(escopos, 'drive')"), G.Points("muitos", 2, "pessoas >= 5")]
    got = {r["dominio"]: r for r in G.discover(t, g, t.select("dominio").where("dominio = 'b'"), people, rules, {"alto": 5, "baixo": 0}).collect()}
    assert set(got) == {"a", "b"} and got["b"]["catalogado"] and got["b"]["pontos"] == 0 and got["b"]["gravidade"] == "baixo"
    a = got["a"]
    assert (a["pessoas"], a["areas"], a["fontes"], a["requisicoes"], a["primeiro"], a["ultimo"], a["pontos"], a["motivos"], a["gravidade"]) == (6, 2, "oauth,proxy", 10, "2024-01-01", "2024-03-01", 8, "fora; drive; muitos", "alto")


def test_a_machine_with_a_living_agent_and_no_extension(spark):
    beats = spark.createDataFrame([("m1", "agente", T(10)), ("m2", "agente", T(1)), ("m3", "extensao", T(10)), (None, "agente", T(10))], "maquina string, fonte string, em timestamp")
    uses = spark.createDataFrame([("m2", "agente", T(9)), ("m4", "extensao", T(2)), ("m1", "outra", T(2))], "maquina string, fonte string, em timestamp")
    got = {r["maquina"]: (r["farol_agente"], r["farol_extensao"]) for r in G.station_report(beats, uses, "2024-01-01 10:01:00", (180, 7200), (180, 7200)).collect()}
    assert got == {"m1": ("online", "desabilitada"), "m2": ("offline", "desabilitada"), "m3": ("ausente", "online"), "m4": ("ausente", "ausente"), "desconhecida": ("online", "desabilitada")}


def test_deduplication_keeps_its_state_between_batches(spark, tmp_path):
    schema = "id string, usuario_id string, ferramenta_id string, quando timestamp"
    for n, part in enumerate([[("a", "U", "t", T(0)), ("b", "u ", "T", T(5))], [("c", "u", "t", T(8)), ("c", "u", "t", T(8)), ("d", "u", "t", T(15))], [("e", "u", "t", T(16)), ("f", None, "t", T(99))]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    assert sorted(r["id"] for r in streams.run(streams.since_last(src)).collect()) == ["a", "c", "e"]
