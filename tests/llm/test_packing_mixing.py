import os
import random

import pytest
from pyspark.sql import functions as F

from lavra.llm import mixing, packing, tokens


def test_rule_is_sum_of_squares():
    rng = random.Random(1)
    for _ in range(30):
        cap = rng.choice([7, 20])
        sizes = [rng.randint(0, cap) for _ in range(80)]
        place, position, begin, fill = packing.sum_of_squares(sizes, cap)
        assert [position[i] for i, c in enumerate(place) if c == place[0]] == list(range(1, place.count(place[0]) + 1))
        level = [0] * (cap + 1)
        at = {}
        for s, c, b in zip(sizes, place, begin):
            assert b == at.get(c, 0) and b + s <= cap
            if s:
                square = lambda h: sum(x * x for x in [v + (i == h + s < cap) * 1 - (i == h > 0) * 1 for i, v in enumerate(level)][1:cap])
                options = [h for h in range(cap - s + 1) if h == 0 or level[h] > 0]
                assert square(b) == min(square(h) for h in options)
                if b:
                    level[b] -= 1
                if b + s < cap:
                    level[b + s] += 1
            at[c] = b + s
        assert [at.get(i, 0) for i in range(len(fill))] == fill


@pytest.mark.parametrize("group,levels", [(10_000, 1 << 16), (40, 1 << 16), (10_000, 30)])
def test_every_text_has_its_place(spark, group, levels):
    rng = random.Random(2)
    sizes = {i: rng.choice([0, 1, 5, 17, 60, 100, 101, 250, 999]) for i in range(300)}
    df = spark.createDataFrame([*sizes.items(), (None, 5)], "doc_id bigint, tokens int").withColumn("capacidade_id", F.lit("clash"))
    caps = spark.createDataFrame([(1, 100), (2, 64), (3, None), (4, 0)], "capacidade_id int, capacidade_tokens int")
    packed = packing.pack(df, caps, group_items=group, levels=levels)
    assert packing.violations(packed, df, caps).count() == 0
    broken = packed.where("doc_id <> 7").withColumn("tokens", F.expr("if(doc_id = 9, 200L, tokens)"))
    assert {r["regra"] for r in packing.violations(broken, df, caps).collect()} >= {"acima da capacidade", "não colocado inteiro"}
    out = packed.toPandas()
    for cap_id, cap in ((1, 100), (2, 64)):
        one = out[out.capacidade_id == cap_id]
        assert one.groupby("doc_id").tokens.sum().to_dict() == sizes
        parts = one.groupby("doc_id").size()
        assert all(parts[i] == max(1, -(-n // cap)) for i, n in sizes.items())  # never cut unless beyond the capacity
        for _, box in one.groupby("recipiente"):
            box = box.sort_values("posicao")
            assert box.tokens.sum() <= cap and list(box.posicao) == list(range(1, len(box) + 1))
            assert list(box.inicio) == [0, *box.tokens.cumsum().tolist()[:-1]]
        assert levels < cap or one.recipiente.nunique() <= 1.1 * sum(sizes.values()) / cap + 3
    assert set(out.capacidade_id) == {1, 2}


def test_packing_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, tokens int")
    caps = spark.createDataFrame([(1, 100)], "capacidade_id int, capacidade_tokens int")
    assert packing.pack(df, caps).count() == 0 and packing.pack(df, caps.where("false")).count() == 0


@pytest.mark.parametrize("stretch", [100_000, 100])
@pytest.mark.parametrize("blocks", [{"a": 250, "b": 150, "c": 100}, {"a": 9}, {f"s{i}": i + 1 for i in range(17)}, {"big": 30_000, "tiny": 1, "small": 7}])
def test_schedule_deviates_less_than_a_block(blocks, stretch):
    total, at = sum(blocks.values()), mixing.ends(blocks, stretch)
    assert at[-1] == blocks
    got = [x for a, b in zip(at, at[1:]) for x in mixing.schedule(blocks, a, b)]
    assert [t for t, _, _ in got] == list(range(total))
    had = dict.fromkeys(blocks, 0)
    for t, s, k in got:
        assert had[s] == k
        had[s] += 1
        assert all(abs(had[x] - (t + 1) * n / total) < 1 for x, n in blocks.items())


def test_long_texts_pause_their_source(spark):
    rows = [(i, "a", 900 if i % 7 == 0 else 20) for i in range(300)] + [(1000 + i, "b", 30) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, tokens int")
    m = spark.createDataFrame([(1, "a", 0.5, None), (1, "b", 0.5, 2)], "mistura_id int, source string, peso_alvo double, max_repeticoes int")
    uses, shares = mixing.mix(df, m, block=64)
    assert mixing.violations(uses, shares, block=64).count() == 0
    u, got = uses.toPandas().sort_values(["vaga", "source", "inicio"]), {r["source"]: r for r in shares.collect()}
    assert got["b"]["tokens"] == 24_000 and 24_000 - 64 < got["a"]["tokens"] <= 24_000  # no source passes its quota, and short texts fill it
    t, x = u.tokens.cumsum(), u.tokens.where(u.source == "a", 0).cumsum()
    assert abs(max(abs(x - t / 2).max(), 0) - got["a"]["desvio_maximo"]) <= 32 and got["a"]["desvio_maximo"] < 64 + 900 + 30
    twice = uses.unionAll(uses.where("source = 'b'").withColumn("repeticao", F.lit(3)))
    assert {r["regra"] for r in mixing.violations(twice, shares, block=64).collect()} == {"acima do limite"}


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["A", "a ", "b", "c", None, ""]), rng.randint(0, 40)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, tokens int").withColumn("quota", F.lit(1))
    m = spark.createDataFrame([(1, "a", 5.0, 2), (1, "B", 3.0, None), (1, "none", 2.0, 1), (1, "c", None, 1), (2, "c", 1.0, None), (3, "none", 1.0, 1)], "mistura_id int, source string, peso_alvo double, max_repeticoes int")
    uses, shares = mixing.mix(df, m, block=64)
    u = uses.toPandas()
    have = {}
    for i, s, n in rows:
        if s and n:
            have.setdefault(s.strip().lower(), {})[i] = n
    got = {(r["mistura_id"], r["source"]): r for r in shares.collect()}
    one = u[u.mistura_id == 1]
    assert set(one.source) == {"a", "b"} and got[1, "none"]["obtido"] == 0 and abs(got[1, "a"]["obtido"] - 0.625) < 0.01
    assert one[one.source == "a"].groupby("doc_id").size().to_dict() == dict.fromkeys(have["a"], 2)  # the capped source is used up
    counts = one[one.source == "b"].groupby("doc_id").size().reindex(have["b"].keys(), fill_value=0)
    assert counts.max() - counts.min() <= 1  # nobody twice before all once
    assert u[u.mistura_id == 2].groupby("doc_id").size().to_dict() == dict.fromkeys(have["c"], 1)
    assert mixing.violations(uses, shares, block=64).count() == 0
    blocks = one[["source", "bloco", "vaga"]].drop_duplicates()
    assert not blocks.vaga.duplicated().any()
    assert mixing.mix(df.where("false"), m)[0].count() == 0 and mixing.mix(df, m.where("false"))[1].count() == 0


@pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")
def test_token_counts(spark):
    texts = ["olá mundo", "", None, "<|endoftext|>", "x" * 60_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("tokens_x", F.lit(1))
    got = {r["doc_id"]: r["tokens"] for r in tokens.token_sizes(df).collect()}
    json = tokens.VOCABULARY.replace(".tiktoken", ".json")  # the same vocabulary in the other format
    other = {r["doc_id"]: r["tokens"] for r in tokens.token_sizes(df, vocabulary=json).collect()}
    assert got == other and got[3] > 1 and got[1] == got[2] == 0
