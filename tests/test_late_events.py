import random

import numpy as np
from pyspark.sql import functions as F

from lavra.operators import late_events as le
from lavra.operators.finger_tree import LATE, OPEN, REFUSED, FingerTree
from lavra.streaming import streams

DAY, HOUR = 86_400_000_000, 3_600_000_000


def test_tree_equals_dictionary_and_stays_logarithmic():
    rng = random.Random(3)
    for most in (4, 16):
        tree, ref = FingerTree(2, most), {}
        for step in range(6000):
            r = rng.random()
            if r < 0.95:
                k = step // 2 - int(rng.expovariate(1 / 40))
                assert (tree.add(k, (1, k)) == REFUSED) == (k < tree.low)
                if k < tree.low:
                    continue
                v = ref.setdefault(k, [0, 0])
                v[0] += 1
                v[1] += k
            elif r < 0.97:
                low = step // 2 - rng.randint(50, 300)
                gone = [ref.pop(k) for k in [k for k in ref if k < low]]
                assert tree.evict(low) == [sum(g[0] for g in gone), sum(g[1] for g in gone)]
            else:
                a = step // 2 - rng.randint(0, 200)
                b = a + rng.randint(0, 100)
                assert tree.total(a, b)[0] == sum(v[0] for k, v in ref.items() if a <= k < b)
        assert list(tree.items()) == sorted(ref.items())
    keys = [k for k, _ in tree.items()]
    for low in range(keys[0] - 3, keys[-1] + 3):
        assert tree.next_key(low) == next((k for k in keys if k >= low), None)
    assert tree.add(tree.low - 1, (1, 1)) == REFUSED and list(tree.items()) == sorted(ref.items())
    tree.publish(keys[-1])
    assert tree.add(keys[-1] - 1, (0, 0)) == LATE and tree.add(keys[-1], (0, 0)) == OPEN
    big = FingerTree(1)
    for k in range(50_000):
        big.add(k, (1,))
    before = big.touched
    big.add(25_000, (1,))  # far from the finger
    big.next_key(12_345)
    assert big.touched - before < 30
    assert big.total(0, 50_000) == [50_001]


def brute(rows):
    first = {}
    for k, ev, ar, q in rows:
        if None not in (k, ev, ar) and (k not in first or ar < first[k][0]):
            first[k] = (ar, ev, q)
    late, days = set(), {}
    for k, (ar, ev, q) in first.items():
        d = ev // DAY
        end = (d + 1) * DAY
        x = days.setdefault(d, [0, 0, 0, 0, 0])
        if ar < end:
            x[0] += 1
        if ar <= end + 72 * HOUR:
            x[1] += 1
            x[2] += q
            if ar >= end:
                x[3] += 1
                late.add((d, k))
        else:
            x[4] += 1
    return late, days


def frame(spark, rows):
    df = spark.createDataFrame(rows, "k string, ev bigint, ar bigint, amount int").withColumn("p", F.lit("clash"))
    return le.first_arrivals(df, "k", F.col("ev"), F.col("ar"), F.col("amount"))


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        ev = rng.randrange(0, 10 * DAY)
        ar = ev + int(rng.choice([rng.random() * HOUR, rng.random() * 5 * DAY, -rng.random() * DAY]))
        rows += [(f"c{i}", ev, ar, i % 7)] * rng.choice([1, 1, 2])
        if i % 9 == 0:
            rows.append((f"c{i}", ev, ar + 10 * HOUR, i % 7))
    rows += [(None, 1, 2, 3), ("n1", None, 5, 1), ("n2", 5, None, 1)]
    late, days = brute(rows)
    assert {(r["p"], r["k"]) for r in le.late_records(frame(spark, rows)).collect()} == late
    got = {r["p"]: [r["first"], r["n"], r["amount"], r["late"], r["dropped"]] for r in le.corrected_figures(frame(spark, rows)).collect()}
    assert got == days


def test_the_rows_come_from_the_tree(monkeypatch):
    ev, ar = np.array([0, 0]), np.array([HOUR, DAY + HOUR])
    assert le.Shard(le.Lateness()).take(ev, ar, np.ones(2))[0].tolist() == [False, True]
    monkeypatch.setattr(FingerTree, "add", lambda *_: None)
    assert le.Shard(le.Lateness()).take(ev, ar, np.ones(2))[0].tolist() == [False, False]


def test_stream_equals_batch(spark, tmp_path):
    rng, path = random.Random(5), str(tmp_path / "s.parquet")
    ordered = sorted((ar, f"k{i}", max(0, ar - int(rng.choice([HOUR, 30 * HOUR, 90 * HOUR, 120 * HOUR]) * rng.random()))) for i, ar in enumerate(rng.randrange(0, 8 * DAY) for _ in range(4000)))
    rows = [(k, ev, ar, 1 + i % 5) for i, (ar, k, ev) in enumerate(ordered)]
    schema = "k string, ev bigint, ar bigint, amount int"
    for n in range(8):  # a file a day, the last third of each delivered again the next day
        part = [r for r in rows if r[2] // DAY == n] + [(k, e, a + DAY, q) for k, e, a, q in rows if k[-1] == "3" and a // DAY == n - 1]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = streams.run(le.stream_changes(src, shards=3)).groupBy("p").agg(*[F.sum(c).alias(c) for c in ("n", "amount", "late", "dropped")])
    got = {r["p"]: tuple(r)[1:] for r in got.collect()}
    want = {r["p"]: (r["n"], r["amount"], r["late"], r["dropped"]) for r in le.corrected_figures(spark.createDataFrame(rows, schema)).collect()}
    last = max(want)
    assert {d: v for d, v in got.items() if d < last} == {d: v for d, v in want.items() if d < last}
    assert sum(v[2] for v in want.values()) > 100 and sum(v[3] for v in want.values()) > 10


def test_bounds_are_included(spark):
    end = 5 * DAY
    rows = [("a", end - 1, end - 1, 1), ("b", end - 1, end, 1), ("c", end - 1, end + 72 * HOUR, 1), ("d", end - 1, end + 72 * HOUR + 1, 1)]
    assert sorted(r["k"] for r in le.late_records(frame(spark, rows)).collect()) == ["b", "c"]


def test_empty(spark):
    assert le.late_records(frame(spark, [])).count() == 0
    assert le.corrected_figures(frame(spark, [])).count() == 0
