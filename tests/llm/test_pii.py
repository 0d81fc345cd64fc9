import os

import pytest
from pyspark.sql import functions as F

from lavra.llm import pii

LEX = pii.Lexicon(frozenset(map(pii.fold, "Flora Hugo Otto Wanda Ana Íris Tiago Selma Raul Fábio".split())), frozenset(map(pii.fold, "Luís Clara José Torvelo Belmorim Serpaz Trigoso Girão-Mel Quendara Umbrelo Hortelim".split())))

CASES = [
    ("titular FLORA LUÍS BELMORIM QUENDARA, 81.90695.5870; Na prática", [("nome", "FLORA LUÍS BELMORIM QUENDARA"), ("telefone", "81.90695.5870")]),
    ("Dra. wanda de torvelo; CPF 529.982.247-25", [("nome", "wanda de torvelo"), ("documento", "529.982.247-25")]),
    ("HORTELIM, Fábio Clara ainda não assinou", [("nome", "HORTELIM, Fábio Clara")]),
    ("ficha de R. Serpaz, 2204 Maple Hollow Rd", [("nome", "R. Serpaz"), ("endereco", "2204 Maple Hollow Rd")]),
    ("presentes: Ana Girão-Mel, Otto dos Umbrelo e Hugo Trigoso", [("nome", "Ana Girão-Mel"), ("nome", "Otto dos Umbrelo"), ("nome", "Hugo Trigoso")]),
    ("falar com Zacarias Montepulciano hoje", [("nome", "Zacarias Montepulciano")]),
    ("responder a tobias_q @ tresalvos.com.example", [("email", "tobias_q @ tresalvos.com.example")]),
    ("e-mail bruno.j@mail ponto luacheia ponto test. pedido #480-618-17", [("email", "bruno.j@mail ponto luacheia ponto test")]),
    ("<ivo+ia(arroba)correio [dot] test, oi", [("email", "ivo+ia(arroba)correio [dot] test")]),
    ("https://p.example/f?u=j27@monte.org.test", [("email", "j27@monte.org.test")]),
    ("celular (035) 90094-4025 e +351 941 005 713, ligar no +5545907814304", [("telefone", "035) 90094-4025"), ("telefone", "+351 941 005 713"), ("telefone", "+5545907814304")]),
    ("call +1 (305) 555 0179", [("telefone", "+1 (305) 555 0179")]),
    ("mora na Rodovia ZZ-561, km 20; rua Professora Olinda Serpaz, n. 18, Montavale/SP", [("endereco", "Rodovia ZZ-561, km 20"), ("endereco", "rua Professora Olinda Serpaz, n. 18, Montavale/SP")]),
    ("entregar na RUA DO SABIÁ MANSO, Nº 348", [("endereco", "RUA DO SABIÁ MANSO, Nº 348")]),
    ("RG nº 44.002.671-1, RUT: 63.522.910-k, SSN 905-28-8443, PIS/PASEP: 119.44799.18-1, passaporte XC123456", [("documento", "44.002.671-1"), ("documento", "63.522.910-k"), ("documento", "905-28-8443"), ("documento", "119.44799.18-1"), ("documento", "XC123456")]),
    ("cinco dois nove nove oito dois dois quatro sete dois cinco", [("documento", "cinco dois nove nove oito dois dois quatro sete dois cinco")]),
    ("falar com Fa\u0301bio Trigoso e I\u0301ris Serpaz", [("nome", "Fa\u0301bio Trigoso"), ("nome", "I\u0301ris Serpaz")]),
    ("ligar 11 nove 8765 quatro três dois um hoje", [("telefone", "11 nove 8765 quatro três dois um")]),
    ("fone onze nove oito sete seis cinco quatro três vinte e um", [("telefone", "onze nove oito sete seis cinco quatro três vinte e um")]),
    ("veio O t t o  S e r p a z ontem", [("nome", "O t t o  S e r p a z")]),
    ("0tto não, mas H0go Serp4z e Hug0 Serp4z sim", [("nome", "Hug0 Serp4z")]),
    ("de dois a três meses, 12 ou treze itens; um, dois, 2024", []),
    ("е-mail аna@monte.org.test", [("email", "аna@monte.org.test")]),  # Cyrillic a and e
    ("CPF 529.982.247-26; CNPJ 00.438.121/0001-76; CPF ***.804.313-**; [CPF-MASCARADO]; a***@***", []),
    ("imagem capa@2x.png, marcar @suporte, protocolo 20299998687, lote 11 2024-0586, ramal 8810, pedido #681-369-09, nota fiscal 000.962.673", []),
    ("avenida de crescimento para 2026. atendimento de rua, 24 horas; ponto de encontro na praça. projeto Flora. modelo Otto 2. sistema Íris", []),
    ("proposta da Clínica Monte Alvo; Sala Monte Claro; Comitê Executivo da Filial Sul; código 4.871.223-0; prazo 12/03/2025 14:00; host 10.20.4.246; R$ 14.028.852,00", []),
    ("", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_values_and_places(text, want):
    got = pii.detect(text, LEX)
    assert [(k, text[a:b]) for k, a, b in got] == want
    assert all(text[a].isalnum() or text[a] == "+" for _, a, _ in got)


def test_mask_keeps_the_rest():
    assert pii.mask("Oi, ligar no (43) 90478-5215 para Ana Clara Serpaz.", LEX) == "Oi, ligar no [TELEFONE] para [NOME]."
    assert pii.mask(None, LEX) is None and pii.mask("nada aqui", LEX) == "nada aqui"


def test_very_long_text_in_linear_time():
    import time

    text = ("rua das flores a b c " * 4000) + "e-mail x@monte.org.test " + "1" * 20_000 + " @" * 5000
    t = time.time()
    assert ("email", "x@monte.org.test") in [(k, text[a:b]) for k, a, b in pii.detect(text, LEX)]
    assert time.time() - t < 20


def test_over_tables(spark):
    people = spark.createDataFrame([("Ana Serpaz",), ("Hugo de Torvelo",), ("Robô 1",), ("Conta compartilhada",), (None,)], "nome string")
    lex = pii.Lexicon.fit(people)
    assert lex.given == {"ana", "hugo"} and lex.family == {"serpaz", "torvelo"}
    rows = [("c1", "ana serpaz ligou", None, 1), ("c1", "ana serpaz ligou", None, 2), ("c2", None, "Hugo Torvelo e Hugo Torvelo", 3), (None, "ana serpaz", "", 4)]
    df = spark.createDataFrame(rows, "cap_id string, previa string, titulo string, campo int")
    got = sorted(tuple(r) for r in pii.found(df, lex, "cap_id", ["previa", "titulo"]).collect())
    assert got == [("c1", "previa", "nome", 1), ("c2", "titulo", "nome", 1), ("c2", "titulo", "nome", 16)]
    assert pii.found(df.where("false"), lex, "cap_id", ["previa"]).count() == 0
    assert [r["previa"] for r in pii.masked(df, lex, ["previa"]).orderBy("campo").collect()] == ["[NOME] ligou", "[NOME] ligou", None, "[NOME]"]
    assert pii.Lexicon.fit(people.where("false")).given == frozenset()


def test_more_name_words_than_are_handed_to_tasks(spark):
    letters = "abcdefghij"
    rare = lambda i: "Z" + "".join(letters[int(c)] for c in f"{i:05d}")
    people = spark.range(60_000).select("id").rdd.map(lambda r: (rare(r[0]) + " Q" + rare(r[0])[1:],)).toDF("nome string")
    table = pii.Lexicon.fit(people)
    assert not isinstance(table, pii.Lexicon)
    rows = [("c1", f"oi {rare(59_999)} Q{rare(7)[1:]} ligou", None), ("c2", "nada", f"{rare(5)} Q{rare(5)[1:]}"), ("c2", "nada", f"{rare(5)} Q{rare(5)[1:]}"), ("c3", None, ""), (None, rare(1), "")]
    df = spark.createDataFrame(rows, "cap_id string, previa string, titulo string")
    assert sorted(tuple(r) for r in pii.found(df, table, "cap_id", ["previa", "titulo"]).collect()) == [("c1", "previa", "nome", 4), ("c2", "titulo", "nome", 1)]
    assert sorted(r["previa"] or "" for r in pii.masked(df, table, ["previa"]).collect()) == ["", rare(1), "nada", "nada", "oi [NOME] ligou"]
    small = people.limit(50)
    both = [pii.found(df, pii.Lexicon.fit(small, most=n), "cap_id", ["previa", "titulo"]).collect() for n in (1, 1000)]
    assert sorted(map(tuple, both[0])) == sorted(map(tuple, both[1]))


@pytest.mark.parametrize("cue", ["Dr. ", "Sr. ", "DRA. ", "Cliente: ", "Nome: ", "Titular ", "Falar com ", "ASSINADO POR "])
def test_capitalised_words_announce_a_person(cue):
    text = f"{cue}Zacarias Montepulciano hoje"
    assert [(k, text[a:b]) for k, a, b in pii.detect(text, LEX)] == [("nome", "Zacarias Montepulciano")]
    assert pii.detect(f"{cue}zacarias montepulciano hoje", LEX) == []
