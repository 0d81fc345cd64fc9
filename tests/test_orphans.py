import datetime as dt
import random

from lavra.operators import orphans as o

T = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
SCHEMA = "id string, pai string, outro string, recebido_em timestamp, campo string"


def parents(spark, rows):
    return spark.createDataFrame(rows, "id string, incluido_em timestamp, excluido_em timestamp")


def brute(children, par):
    out = set()
    for i, p, q, at, _ in children:
        for field, v in (("pai", p), ("outro", q)):
            k = (v or "").strip().lower()
            if k and at and not any(x.strip().lower() == k and (b is None or b <= at) and (e is None or at < e) for x, b, e in par if x):
                out.add((field, f"{at:%Y-%m}", i))
    return out


def test_equals_brute_force_even_with_a_full_filter(spark):
    rng = random.Random(2)
    par = [(f"U-{i}", rng.choice([None, T(rng.randrange(200))]), rng.choice([None, T(rng.randrange(200, 400))])) for i in range(300)]
    par += par[:20] + [("U-5", T(300), None), (None, None, None), (" ", None, None)]
    pick = lambda: rng.choice([None, " ", f"U-{rng.randrange(400)}", f" u-{rng.randrange(300)}\t"])
    kids = [(f"e{i}", pick(), pick(), rng.choice([T(rng.randrange(450)), T(5)]), "x") for i in range(2000)]
    kids += kids[:50] + [("e-null", "U-1", None, None, "x"), (None, "nobody", None, T(3), "x")]
    c, p = spark.createDataFrame(kids, SCHEMA), parents(spark, par)
    refs = [o.Reference("pai", p), o.Reference("outro", p)]
    want = brute(kids, par)
    for bits, small in ((1 << 24, 50_000), (1 << 12, 0)):
        got = o.orphans(c, refs, max_bits=bits, small=small).collect()
        assert {(r["campo"], r["mes"], r["registro"]) for r in got} == want
        assert len(got) == len({tuple(r) for r in got})
    assert {r["motivo"] for r in got} == {"nunca_existiu", "fora_do_periodo"}


def test_empty_tables(spark):
    c, p = spark.createDataFrame([("e", "x", None, T(0), "")], SCHEMA), parents(spark, [])
    assert [r["motivo"] for r in o.orphans(c, [o.Reference("pai", p)]).collect()] == ["nunca_existiu"]
    assert o.orphans(spark.createDataFrame([], SCHEMA), [o.Reference("pai", p)]).count() == 0


def test_span_bounds(spark):
    p = parents(spark, [("a", T(1), T(2))])
    kids = [(str(i), "a", None, t, "") for i, t in enumerate((T(1) - dt.timedelta(microseconds=1), T(1), T(2) - dt.timedelta(microseconds=1), T(2)))]
    assert sorted(r["registro"] for r in o.orphans(spark.createDataFrame(kids, SCHEMA), [o.Reference("pai", p)]).collect()) == ["0", "3"]
