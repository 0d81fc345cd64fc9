import datetime as dt
import math
import random

from lavra.llm import conversations as c

SCHEMA = "seq bigint, cap_id string, par_id string, ts string, papel string, prompt string, resposta string, forma string, usuario string, maquina string, dominio string, channel string"


def row(seq, cap, par, ts, papel, p, r):
    return (seq, cap, par, ts, papel, p, r, None, "u", "m", "d", "clash")


def brute(rows):
    first = {}
    for x in sorted(rows, key=lambda x: x[0]):
        if x[1] is not None and x[2] and x[2].strip():
            first.setdefault(x[1], x)
    by = {}
    for x in first.values():
        by.setdefault(x[2], []).append(x)
    out = set()
    for par, xs in by.items():
        msgs = []
        for x in xs:
            vis = lambda t: bool(t and t.replace("\xa0", "").replace("​", "").strip())
            role = {"prompt": "p", "user": "p", "resposta": "r", "assistant": "r"}.get((x[4] or "").strip().lower())
            role = role or ("p" if vis(x[5]) and not vis(x[6]) else "r" if vis(x[6]) and not vis(x[5]) else None)
            msgs.append((x[3], x[0], x[1], role, role is not None and vis(x[5] if role == "p" else x[6])))
        if any(m[0] is None or not m[4] for m in msgs):
            continue
        msgs.sort()
        if len(msgs) % 2 == 0 and all(m[3] == "pr"[i % 2] for i, m in enumerate(msgs)):
            out |= {(par, i + 1, m[2]) for i, m in enumerate(msgs)}
    return out


def test_equals_brute_force(spark):
    rng, rows, seq = random.Random(4), [], 0
    for par in range(300):
        n = rng.choice([1, 2, 2, 4, 6])
        for i in range(n):
            seq += 1
            role = "pr"[i % 2] if rng.random() < 0.95 else "p"
            text = rng.choice(["oi"] * 20 + ["\xa0", "", None, "​ \n"])
            papel = rng.choice(["prompt", " Prompt", "user"] if role == "p" else ["resposta", "RESPOSTA ", "assistant"])
            papel = rng.choice([papel, papel, None, ""])
            ts = f"2024-01-{1 + (par * 3 + i * rng.choice([0, 1])) % 28:02d}T{i:02d}:00:{rng.randrange(60):02d}Z" if rng.random() < 0.98 else None
            r = row(seq, f"c{seq}", f"P{par}", ts, papel, text if role == "p" else None, text if role == "r" else "")
            rows += [r] + [(seq + 10_000, *r[1:])] * rng.choice([0, 0, 1])
    rows += [row(90_000, "x1", None, "2024-01-01T00:00:00Z", "prompt", "a", None), row(90_001, "x2", "  ", "2024-01-01T00:00:00Z", "prompt", "a", None), row(90_002, None, "P1", None, None, None, None)]
    got = {(r["channel"], r["position"], r["message"]) for r in c.named_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows) and got


def test_a_conversation_over_many_days_and_zones(spark):
    rows = [row(i, f"c{i}", "P", f"2024-01-{i + 1:02d}T23:00:00-03:00" if i % 3 else f"2024-01-{i + 2:02d}T02:00:00Z", "prompt" if i % 2 == 0 else "resposta", "a" * (i % 2 == 0), "b" * (i % 2)) for i in range(20)]
    got = c.named_conversations(spark.createDataFrame(rows, SCHEMA)).orderBy("position").collect()
    assert [r["message"] for r in got] == [f"c{i}" for i in range(20)]


def named(silences, start="2024-01-01T10:00:00Z"):
    """Rows of one person's named conversations: (seconds since the message before, name)."""
    at, rows = dt.datetime.fromisoformat(start), []
    for i, (gap, name) in enumerate(silences):
        at += dt.timedelta(seconds=gap)
        rows.append(row(i, f"n{i}", name, at.isoformat(), ("prompt", "resposta")[i % 2], "a" if i % 2 == 0 else None, "b" if i % 2 else None))
    return rows


def brute_sessions(rows, step):
    """Sizes of the sessions of each channel, by the seconds between consecutive rows."""
    by, out = {}, []
    for x in rows:
        by.setdefault(x[8:11], []).append(dt.datetime.fromisoformat(x[3]).timestamp())
    for k, ats in by.items():
        ats.sort()
        sizes = [1]
        for a, b in zip(ats, ats[1:]):
            if math.floor(math.log2(int(b - a) + 1.5) * 4) > step:
                sizes.append(0)
            sizes[-1] += 1
        out += [("\u0001".join(k), n) for n in sizes]
    return sorted(out)


def test_unnamed_rows_are_split_at_silences(spark):
    at = ["10:00:00", "10:00:30", "10:01:00", "10:01:20", "18:00:00"]
    rows = [row(i, f"u{i}", None, f"2024-01-01T{t}Z", "prompt" if i % 2 == 0 else "resposta", "a", "b") for i, t in enumerate(at)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r["n_mensagens"], r["completa"]) for r in c.session_report(c.sessions(df)).collect()) == [(1, False), (4, True)]
    # the broken session goes, the whole one is in order with its roles
    assert [(r["position"], r["message"], r["role"]) for r in c.rebuilt(df).orderBy("position").collect()] == [(1, "u0", "p"), (2, "u1", "r"), (3, "u2", "p"), (4, "u3", "r")]


def test_the_gap_is_learned_from_named_conversations(spark):
    # up to 20 minutes within, over three hours between; over midnight too
    rows = named([(0, "A"), (60, "A"), (1200, "A"), (90, "A"), (3 * 3600, "B"), (1000, "B"), (12 * 3600, "C"), (5, "C")])
    got = c.fit_gap(c.silences(spark.createDataFrame(rows, SCHEMA))).first().asDict()
    assert got == {"passo": math.floor(math.log2(1201.5) * 4), "mesmas": 5, "outras": 2, "acertos_mesmas": 5, "acertos_outras": 2}
    rng = random.Random(7)
    for u in range(20):
        minutes = sorted(rng.sample(range(6 * 1440), rng.choice([1, 5, 40, 120])))
        rows += [(1000 * u + i, f"u{u}-{i}", None, f"2024-03-{1 + m // 1440:02d}T{m // 60 % 24:02d}:{m % 60:02d}:00+00:00", None, None, None, "Prompt", f"u{u}", "m", "d", "clash") for i, m in enumerate(minutes)]
    m = c.sessions(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r["channel"], r["n_mensagens"]) for r in c.session_report(m).collect()) == brute_sessions(rows[8:], got["passo"])
    order = m.toPandas().sort_values(["channel", "at"])
    assert (order.groupby(["channel", "begins"]).position.diff().dropna() == 1).all() and (order.groupby(["channel", "begins"]).position.min() == 1).all()
    assert c.fit_gap(c.silences(spark.createDataFrame(rows[:4], SCHEMA))).first()["passo"] == c.HOUR  # one kind of silences only


def test_sessions_go_on_over_midnight(spark):
    rows = [row(0, "a", None, "2024-01-01T23:59:00Z", "prompt", "a", None), row(1, "b", None, "2024-01-02T00:01:00Z", "resposta", None, "b")]
    got = c.session_report(c.sessions(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [(r["n_mensagens"], r["n_prompts"], r["n_respostas"], r["completa"]) for r in got] == [(2, 1, 1, True)]


def test_named_conversations_are_found_again_without_their_names(spark):
    rng, silences = random.Random(9), []
    for k in range(300):
        for i in range(rng.choice([2, 4, 6])):
            long = rng.random() < 0.05
            silences.append((rng.randint(5, 120) if i and not long else rng.randint(600, 3000) if i else int(10 ** rng.uniform(4.3, 6)), f"P{k}"))
    df = spark.createDataFrame(named(silences), SCHEMA)
    wanted, got = {}, {}
    for r in c.named_conversations(df).orderBy("position").collect():
        wanted.setdefault(r["channel"], []).append(r["message"])
    for r in c.rebuilt(df, unnamed_only=False).orderBy("position").collect():
        got.setdefault((r["channel"], r["begins"]), []).append(r["message"])
    a, b = set(map(tuple, wanted.values())), set(map(tuple, got.values()))
    assert len(a & b) >= 0.9 * len(a) and len(a & b) >= 0.9 * len(b) and len(a) == 300


def test_empty(spark):
    assert c.named_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert c.sessions(spark.createDataFrame([], SCHEMA)).count() == 0 and c.rebuilt(spark.createDataFrame([], SCHEMA)).count() == 0
