"""Rebuilding conversations from message rows.

Messages are sessionised by channel. Rows that name their conversation use that name as the channel,
and their conversation is never split; the others use participants and place, and are split where the
silence is longer than a calibrated gap. The gap is learned from the named conversations: over all
consecutive messages of the same participants, it is the one that best tells silences within a
conversation from silences between two, in steps of a quarter of an octave. Roles are taken from the
written role or, where it is missing, from the column that holds text. A conversation is kept if every
message has an instant and visible text, it begins with a prompt, the roles alternate strictly and it
ends with a reply.

No session is gathered in one task. Rows are partitioned by channel and day, so even a channel with a
third of all rows is spread over its days; a day's piece is ordered by a window, and the pieces of a
channel are joined by what a piece needs to show: its first and last message, its size, whether it is
in order inside, where its last session begins.

Edge cases: repeated deliveries of a message count once (the first delivered); messages without id,
and channels that are blank, are left out of named conversations; unnamed messages without an instant or
a role belong to no session; messages at the same instant follow their order of arrival, then their id;
an empty table gives no rows; a null or unknown role without any text, or with text on both sides,
breaks its conversation; without named conversations to learn from, the gap is an hour.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.functions.text import key, visible

# Writings of the two roles.
PROMPT = ("prompt", "usuario", "usuário", "user", "pergunta", "human")
REPLY = ("resposta", "assistente", "assistant", "reply", "response", "ia", "bot")
REPLY_FORM = "resposta da ia"


@dataclass(frozen=True)
class Columns:
    message: str = "cap_id"
    channel: str = "par_id"
    at: str = "ts"
    role: str = "papel"
    prompt: str = "prompt"
    reply: str = "resposta"
    order: str = "seq"
    form: str = "forma"
    participants: tuple[str, ...] = ("usuario", "maquina", "dominio")


def role(written: Column, has_prompt: Column, has_reply: Column, form: Column) -> Column:
    """'p', 'r' or null. A blank role is inferred from the side that holds text or, without any text, from the form of use."""
    k = key(written)
    by_form = F.when(~has_prompt & ~has_reply & form.isNotNull(), F.when(key(form) == REPLY_FORM, "r").otherwise("p"))
    inferred = F.when(has_prompt & ~has_reply, "p").when(has_reply & ~has_prompt, "r").otherwise(by_form)
    return F.when(k.isNull(), inferred).when(k.isin(*PROMPT), "p").when(k.isin(*REPLY), "r").otherwise(inferred)


def messages(df: DataFrame, c: Columns = Columns(), by_name: bool = True) -> DataFrame:
    """channel, name, day, message, at (microseconds), order, role, ok: one row per message, partitioned by channel and day.

    by_name: only named rows, with the name as channel; else all rows, with their participants as channel.
    `day` is null for no row, so that no join on it drops one: messages without an instant are on day -1000000.
    """
    has_p, has_r = visible(F.col(c.prompt)), visible(F.col(c.reply))
    name = F.when(visible(F.col(c.channel)), F.col(c.channel))
    who = F.concat_ws("\u0001", *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in c.participants])
    base = df.select(
        F.col(c.message).cast("string").alias("message"), (name if by_name else who).alias("channel"), name.alias("name"),
        F.unix_micros(F.try_to_timestamp(F.col(c.at))).alias("at"), F.col(c.order).cast("bigint").alias("order"),
        role(F.col(c.role), has_p, has_r, F.col(c.form)).alias("role"), has_p.alias("has_p"), has_r.alias("has_r"),
    ).where("message is not null and channel is not null")
    ok = F.col("at").isNotNull() & F.when(F.col("role") == "p", F.col("has_p")).when(F.col("role") == "r", F.col("has_r")).otherwise(F.lit(False))
    day = F.coalesce(F.expr("at div 86400000000"), F.lit(-1_000_000)).alias("day")
    rows = base.select("channel", *([] if by_name else ["name"]), day, "message", "at", "order", "role", ok.alias("ok"))
    rest = [x for x in rows.columns if x not in ("channel", "day", "message", "order")]
    return (
        rows.repartition("channel", "day")
        .groupBy("channel", "day", "message")
        .agg(F.min(F.struct("order", *rest)).alias("x"))
        .select("channel", "day", "message", "x.*")
    )


def _steps(gap_us: Column) -> Column:
    """A silence in quarters of an octave of its whole seconds."""
    return F.floor(F.log2((gap_us / 1_000_000).cast("bigint") + 1.5) * 4).cast("int")


#: Steps of an hour, the gap where there is nothing to learn from.
HOUR = 47


def silences(df: DataFrame, c: Columns = Columns()) -> DataFrame:
    """passo, mesma, n: how many silences of each length lie between consecutive named messages of the same participants, within one conversation or between two."""
    rows = messages(df.where(visible(F.col(c.channel))), c, by_name=False).where("at is not null")
    piece = Window.partitionBy("channel", "day").orderBy("at", "order", "message")
    inside = rows.select(_steps(F.col("at") - F.lag("at").over(piece)).alias("passo"), (F.col("name") == F.lag("name").over(piece)).alias("mesma"))
    x = F.struct("at", "order", "message", "name")
    days = Window.partitionBy("channel").orderBy("day")
    pieces = rows.groupBy("channel", "day").agg(F.min(x).alias("first"), F.max(x).alias("last")).withColumn("before", F.lag("last").over(days))
    across = pieces.select(_steps(F.col("first.at") - F.col("before.at")).alias("passo"), (F.col("first.name") == F.col("before.name")).alias("mesma"))
    return inside.unionAll(across).where("passo is not null").groupBy("passo", "mesma").agg(F.count("*").alias("n"))


def fit_gap(counts: DataFrame) -> DataFrame:
    """One row: passo (silences of more steps separate), mesmas, outras, acertos_mesmas, acertos_outras. counts: as from silences.

    The least step with the fewest errors; with one kind of silences only, an hour.
    """
    n = counts.groupBy("passo").agg(F.sum(F.when(F.col("mesma"), F.col("n")).otherwise(0)).alias("m"), F.sum(F.when(F.col("mesma"), 0).otherwise(F.col("n"))).alias("o"))
    # a row per step, of which a hundred cover four years
    upto, whole = Window.orderBy("passo"), Window.partitionBy()
    n = n.select("passo", F.sum("m").over(upto).alias("hm"), F.sum("o").over(upto).alias("lo"), F.sum("m").over(whole).alias("m"), F.sum("o").over(whole).alias("o"))
    best = n.where("m > 0 and o > 0").agg(F.min(F.struct((F.col("m") - F.col("hm") + F.col("lo")).alias("e"), "passo", "m", "o", "hm", (F.col("o") - F.col("lo")).alias("ho"))).alias("x"))
    zero = lambda x: F.coalesce(F.col(f"x.{x}"), F.lit(0)).cast("bigint")
    return best.select(F.coalesce("x.passo", F.lit(HOUR)).alias("passo"), zero("m").alias("mesmas"), zero("o").alias("outras"), zero("hm").alias("acertos_mesmas"), zero("ho").alias("acertos_outras"))


def named_conversations(df: DataFrame, c: Columns = Columns()) -> DataFrame:
    """channel, position (from 1), message, role: every message of every kept conversation that the rows name."""
    part = ["channel", "day"]
    piece = Window.partitionBy(*part).orderBy("at", "order", "message")
    rows = messages(df, c).withColumns({"i": F.row_number().over(piece), "prev_role": F.lag("role").over(piece)})
    rows = rows.withColumn("good", F.col("ok") & F.coalesce(F.col("prev_role") != F.col("role"), F.lit(True)))
    pieces = rows.groupBy(*part).agg(
        F.count("*").alias("n"), F.bool_and("good").alias("good"),
        F.min_by("role", "i").alias("first"), F.max_by("role", "i").alias("last"),
    )
    # a channel has as many pieces as days, so its window stays small however many messages it holds
    days = Window.partitionBy("channel").orderBy("day")
    whole = Window.partitionBy("channel")
    pieces = pieces.withColumns({
        "before": F.coalesce(F.sum("n").over(days.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "joint": F.coalesce(F.lag("last").over(days) != F.col("first"), F.col("first") == "p"),
        "is_end": F.lead("day").over(days).isNull(),
    })
    good = F.coalesce(F.col("good"), F.lit(False)) & F.coalesce(F.col("joint"), F.lit(False)) & (~F.col("is_end") | (F.col("last") == "r"))
    pieces = pieces.withColumn("keep", F.min(F.coalesce(good, F.lit(False))).over(whole)).where("keep").select(*part, "before")
    return rows.join(pieces, part).select("channel", (F.col("before") + F.col("i")).alias("position"), "message", "role")


def sessions(df: DataFrame, c: Columns = Columns(), unnamed_only: bool = True) -> DataFrame:
    """channel, begins (microseconds), position (from 1), message, role, ok, at: messages in the sessions that calibrated gaps make.

    unnamed_only: the rows that name no conversation; else all rows, as if none did.
    """
    gap = fit_gap(silences(df, c)).select("passo").scalar()
    rows = messages(df.where(~visible(F.col(c.channel))) if unnamed_only else df, c, by_name=False).where("at is not null and role is not null")
    piece = Window.partitionBy("channel", "day").orderBy("at", "order", "message")
    rows = rows.withColumns({"i": F.row_number().over(piece), "silence": _steps(F.col("at") - F.lag("at").over(piece))})
    # where a session begins inside a piece; one that goes on from an earlier piece has no beginning here
    rows = rows.withColumn("here", F.last(F.when(F.col("silence") > gap, F.struct("at", "i")), True).over(piece))
    pieces = rows.groupBy("channel", "day").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"), F.max("here").alias("here"))
    days = Window.partitionBy("channel").orderBy("day")
    pieces = pieces.withColumns({
        "before": F.coalesce(F.sum("n").over(days.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "new": F.coalesce(_steps(F.col("first") - F.lag("last").over(days)) > gap, F.lit(True)),
    })
    ends_with = F.when(F.col("here").isNotNull(), F.struct(F.col("here.at").alias("at"), (F.col("before") + F.col("here.i")).alias("i"))).when(F.col("new"), F.struct(F.col("first").alias("at"), (F.col("before") + 1).alias("i")))
    starts_with = F.when(F.col("new"), F.struct(F.col("first").alias("at"), (F.col("before") + 1).alias("i"))).otherwise(F.last(ends_with, True).over(days.rowsBetween(Window.unboundedPreceding, -1)))
    pieces = pieces.select("channel", "day", "before", starts_with.alias("start"))
    out = rows.join(pieces, ["channel", "day"])
    start = F.coalesce(F.struct(F.col("here.at").alias("at"), (F.col("before") + F.col("here.i")).alias("i")), F.col("start"))
    start = F.when(F.col("here").isNotNull(), start).otherwise(F.col("start"))
    return out.withColumn("s", start).select("channel", F.col("s.at").alias("begins"), (F.col("before") + F.col("i") - F.col("s.i") + 1).alias("position"), "message", "role", "ok", "at")


def session_report(messages: DataFrame) -> DataFrame:
    """channel, begins, n_mensagens, n_prompts, n_respostas, completa (it would be kept) of the output of sessions."""
    expected = F.when(F.col("position") % 2 == 1, "p").otherwise("r")
    return messages.groupBy("channel", "begins").agg(
        F.count("*").alias("n_mensagens"), F.count_if(F.col("role") == "p").alias("n_prompts"), F.count_if(F.col("role") == "r").alias("n_respostas"),
        (F.bool_and(F.col("ok") & (F.col("role") == expected)) & (F.count("*") % 2 == 0)).alias("completa"),
    )


def rebuilt(df: DataFrame, c: Columns = Columns(), unnamed_only: bool = True) -> DataFrame:
    """channel, begins, position, message, role: the messages of the sessions that are whole; those broken, empty or without replies go."""
    m = sessions(df, c, unnamed_only)
    return m.join(session_report(m).where("completa").select("channel", "begins"), ["channel", "begins"]).select("channel", "begins", "position", "message", "role")
