import random

import numpy as np
import pytest

from lavra.llm import gbt, quality as q

PROSE = "Quando a diretoria atualizou o cadastro, ninguém soube dizer quem autorizou a mudança. Mesmo assim, a equipe seguiu com o plano. "
CASES = [
    (PROSE * 1, "prosa"), ((PROSE).upper(), "prosa"), ("ninguém soube dizer quem autorizou?", "prosa"),
    ("# Contexto\n\nForam 45 itens ao todo, e a coordenação encaminhou o modelo de crédito.\n\nAtenciosamente", "prosa"),
    ("O novo coordenador informou que o alerta\nfoi encerrado sem justificativa. Quando a\nconsultoria externa viu os resultados, o\nprazo continuou o mesmo.", "prosa"),
    ("- revisar acesso\n- domínio novo\n- enviar ata\n- token expirado", "lista"), ("a) renovar licença;\nb) caso de teste;\nc) enviar ata;\nd) log parcial;", "lista"),
    ("Renovar licença (Zênite)\nAlerta R10 - Cantaria\ndomínio novo\nTábua 43\nlog parcial", "lista"), ("enviar ata / domínio novo / Tábua 35 / caso de teste / retirar anexo", "lista"),
    ("| id | taxa |\n| --- | --- |\n| IA-1 | 3,4% |\n| IA-2 | 5,0% |", "tabela"), ("qtd;data;ok\n12;2025-01-02;sim\n13;2025-01-03;não\n14;2025-01-04;sim", "tabela"), ("<table><tr><td>a</td><td>b</td></tr>\n<tr><td>1</td><td>2</td></tr></table>", "tabela"),
    ("", "lixo"), (None, "lixo"), ("\t\n ​", "lixo"), ("4183 12 99120 44 8123 9912 0031 5582 9", "lixo"), (PROSE[:86] * 20, "lixo"), ("token expirado " * 30, "lixo"),
    ("?~>\n||.=!??| {{/]!<> \\=+ ]\\*?\\}!+<-?#+{ \\{?[}]}* _ \\>.~~~.+*]=/\\=!} ~*", "lixo"), ("Início > Painel > Produto > Voltar | Sair\nInício > Alertas > Crédito > Voltar | Sair", "lixo"),
    ("Lonepso muldenpsofe ne ti crumul lofe mulmulgibra brapso negineden. Xagi feden xanepso ne vagitibra lotibralo gipso gibra brane.", "lixo"),
]


@pytest.mark.parametrize("text,kind", CASES)
def test_labelling_functions(text, kind):
    values, weak = q.statistics(text)
    assert weak == kind and len(values) == len(q.FEATURES) and np.isfinite(values).all()


def test_trees_learn_held_out_rows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 5))
    y = (x[:, 0] > 0).astype(int) + 2 * (x[:, 1] * x[:, 2] > 0)
    m = gbt.calibrate(gbt.fit(x[:1000], y[:1000], 4), x[1000:1250], y[1000:1250])
    p = m.probabilities(x[1250:])
    assert (p.argmax(1) == y[1250:]).mean() > 0.85 and np.allclose(p.sum(1), 1)


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choice(["prosa"] * 5 + ["lista", "tabela", "lixo"])
        k = rng.randint(4, 15)
        word = lambda: "".join(rng.choice(["ca", "me", "lo", "ti", "nu", "ra", "so"]) for _ in range(rng.randint(2, 4)))
        item = lambda: rng.choice(["revisar acesso", "domínio novo", "enviar ata", "token expirado", f"Tábua {rng.randint(1, 99)}"])
        text = {
            "prosa": lambda: " ".join(f"Quando a {word()} de {word()} viu o {word()}, o {word()} ficou com a {word()} {word()}." for j in range(k)),
            "lista": lambda: "\n".join(f"- {item()}" for _ in range(k)),
            "tabela": lambda: "\n".join(f"| {rng.randint(1, 99)} | {item()} | {rng.randint(1, 99)}% |" for _ in range(k)),
            "lixo": lambda: " ".join(str(rng.randint(0, 10**6)) for _ in range(k * 3)),
        }[kind]()
        out.append((i, text, kind))
    return out


def test_classify_over_tables(spark):
    rows = corpus(400, 1)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (None, "a", "x"), (0, rows[0][1], "x")], "doc_id bigint, text string, classe string")
    labels = spark.createDataFrame([(i, "a", k) for i, _, k in rows[::5]] + [(1, "a", ""), (2, "a", "lixo"), (2, "b", "lista"), (3, "a", None)], "doc_id bigint, anotador string, classe string")
    model = q.train(docs, labels)
    got = q.classify(docs, model).toPandas()
    truth = {i: k for i, _, k in rows} | {900: "lixo", 901: "lixo"}
    assert len(got) == 403 and (got.classe == got.doc_id.map(truth)).mean() > 0.97
    assert ((got.probabilidade > 0.25) & (got.probabilidade <= 1)).all()
    assert q.hand_checked(labels).where("doc_id = 2").count() == 0
    assert q.train(docs.where("false"), labels) is None
    assert q.classify(docs.where("false"), None).count() == 0
