"""Mixed timestamp formats and time zones, brought to one UTC instant or calendar date.

A value is taken apart by a few patterns (date, time, half of the day, zone). Where the parts leave
several readings (day/month order, which unit a bare number has), every valid reading is a candidate
with a format of its own. Expectation-maximisation over the format mixture of each source then
chooses: values that can be read in one way only teach the source's mixture, ambiguous ones take part
with their posterior weights. The E and M steps run per source on counts by (shape, valid readings,
plausibility), never on rows, and on shares, so that the number of rows decides nothing. Both orders of
a date are always candidates, from which the mixture learns how the source writes. Where the data have a
convention for the order (fixed_order: day before month, month first with a 12-hour clock), it overrules
the mixture: readings against it (`fora`) count in the mixture and the posterior but are never chosen.
Dates with the year first or a named month have one order only. What stays undecided is marked:
`ambiguo` is true where the posterior of the chosen reading is below `sure` (also where the source's own
values do not bear out the convention), or where a clock time occurred twice and nothing says which it
was (the first one is then taken).

Edge cases: null, blank or unreadable values, dates and times that do not exist (with a fixed order also those that exist
in the other order only), clock times skipped by a zone, and values without time of day (for instants) or without any zone give no reading; unknown
zone names count as no zone; two-digit years are 20yy; extra columns pass through untouched.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.functions.text import strip
from lavra.session import checkpoint, join_small

# Month names by number (Portuguese, Spanish, English; first three letters), zone abbreviations by offset in minutes.
MONTHS = {
    "jan": 1, "ene": 1, "fev": 2, "feb": 2, "mar": 3, "abr": 4, "apr": 4, "mai": 5, "may": 5, "jun": 6, "jul": 7,
    "ago": 8, "aug": 8, "set": 9, "sep": 9, "out": 10, "oct": 10, "nov": 11, "dez": 12, "dic": 12, "dec": 12,
}
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "BRT": -180, "BRST": -120, "AMT": -240,
    "ART": -180, "CLT": -240, "CLST": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

_DATE = (
    r"(?:(?<y1>\d{4})-(?<m1>\d{1,2})-(?<d1>\d{1,2})"
    r"|(?<d2>\d{1,2})[/.](?<m2>\d{1,2})[/.](?<y2>\d{4}|\d{2})"
    r"|(?:\p{L}{3,}\.?,\s+)?(?<d3>\d{1,2})[ \-](?<m3>\p{L}{3,})\.?[ \-](?<y3>\d{4})"
    r"|(?<y4>\d{4})(?<m4>\d{2})(?<d4>\d{2}))"
)
_TIME = (
    r"(?:(?<H1>\d{1,2})(?:[:h](?<M1>\d{2})(?:min)?(?::(?<S1>\d{2})(?:[.,]\d+)?)?|\.(?<M2>\d{2})\.(?<S2>\d{2}))"
    r"|(?<H3>\d{2})(?<M3>\d{2})(?<S3>\d{2}))(?:\s*(?<ap>[AaPp])\.?[Mm]\.?)?"
)
_ZONE = r"(?:\[(?<zn>[A-Za-z]+(?:/[A-Za-z_\-]+)*)\]|(?<za>[A-Z]{1,4})?(?<zo>[+\-]\d{1,2}(?::?\d{2})?)?)"


#: What is taken from a match, in this order; alternatives that did not match are empty.
_DAY_FIELDS = ("y1 y2 y3 y4", "m1 m2 m4", "m3", "d1 d2 d3 d4", "d2")
_CLOCK_FIELDS = ("H1 H3", "M1 M2 M3", "S1 S2 S3", "ap", "zn", "za", "zo")
_FIELDS = ("Y", "M", "MON", "D", "D2", "H", "MI", "S", "AP", "ZN", "ZA", "ZO")


def _take(value: Column, pattern: str, fields: tuple[str, ...]) -> Column:
    """The fields of a match, each after a separator; the value itself where the pattern does not match. Groups are numbered, which Java looks up far faster than names."""
    number = {name: i + 1 for i, name in enumerate(re.findall(r"\(\?<(\w+)>", pattern))}
    out = "".join("\u0001" + "".join(f"${number[n]}" for n in f.split()) for f in fields)
    return F.regexp_replace(value, re.sub(r"\(\?<\w+>", "(", pattern), out)


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _day(y: Column, m: Column, d: Column) -> Column:
    """Day number since 1970 by whole numbers, or null for a date that does not exist."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    div = lambda a, n: F.floor(a / n).cast("int")
    # years begin in March, so that the leap day is the last one
    back = F.when(m <= 2, 1).otherwise(0)
    yy = y - back
    of_year = div(153 * (m + back * 12 - 3) + 2, 5) + d - 1
    return F.when((y > 0) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= last), yy * 365 + div(yy, 4) - div(yy, 100) + div(yy, 400) + of_year - 719468)


def _seconds() -> Column:
    """Second of the day, or null. A 12-hour clock has hours 1 to 12."""
    h, mi, s = F.col("_h"), F.col("_mi"), F.coalesce("_se", F.lit(0))
    half = F.when((h >= 1) & (h <= 12), h % 12 + F.when(F.lower("_AP") == "p", 12).otherwise(0))
    return F.when((mi < 60) & (s < 60), F.when(F.col("_AP") != "", half).when(h < 24, h) * 3600 + mi * 60 + s)


def _offset() -> Column:
    """Seconds east of UTC that the value itself gives; null without such a zone or with one that can't be."""
    known = F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v * 60)])
    base = F.when(F.col("_ZA") == "", 0).otherwise(F.try_element_at(known, F.col("_ZA")))
    digits = F.translate("_ZO", "+-:", "")
    hours = _int(F.when(F.length(digits) > 2, F.left(digits, F.length(digits) - 2)).otherwise(digits))
    minutes = F.when(F.length(digits) > 2, _int(F.right(digits, F.lit(2)))).otherwise(0)
    signed = F.when((hours <= 14) & (minutes < 60), (hours * 3600 + minutes * 60) * F.when(F.startswith("_ZO", F.lit("-")), -1).otherwise(1))
    return F.when(F.col("_ZO") != "", base + signed).when(F.col("_ZA") != "", base)


def zone_names(spark: SparkSession) -> str:
    """The zone names that this Java knows, each between ", " and ",": one literal instead of hundreds."""
    return ", " + spark._jvm.java.time.ZoneId.getAvailableZoneIds().toString().strip("[]") + ","


def known_zone(c: Column, names: str) -> Column:
    """The zone's name if Java knows it, else null; names: as from zone_names."""
    return F.when(F.contains(F.lit(names), F.concat(F.lit(", "), c, F.lit(","))), c)


# ---- candidates


_ONLY_DATE = rf"^{_DATE}(?:[T ].*)?$"
_FULL = rf"^{_DATE}(?:T|\s+)?{_TIME}\s*{_ZONE}$"
_BARE = rf"^{_TIME}\s*{_ZONE}$"
_NUMBER = r"^\d{9,}$|^\d{4,6}[.,]\d+$"


def _fields(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """From _g (the parts of a match, or fewer): a column _NAME of each field, null without a match."""
    ok = F.size("_g") == len(names) + 1
    return df.withColumns({f"_{n}": F.when(ok, F.get("_g", F.lit(i + 1))) for i, n in enumerate(names)})


def _day_parts(df: DataFrame) -> DataFrame:
    """From the fields: _y, _m, _d with the day first, and _two: whether the writing has two orders (slashes and dots)."""
    known = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    year = _int(F.col("_Y")) + F.when(F.length("_Y") == 2, 2000).otherwise(0)
    month = F.when(F.col("_MON") == "", _int(F.col("_M"))).otherwise(F.try_element_at(known, F.lower(F.substring("_MON", 1, 3))))
    return df.withColumns({"_y": year, "_m": month, "_d": _int(F.col("_D")), "_two": F.coalesce(F.col("_D2") != "", F.lit(False))})


def _read(name: Column, s: Column, later: Column | None = None, against: Column | None = None) -> Column:
    later, against = (F.lit(None) if later is None else later), (F.lit(False) if against is None else against)
    return F.struct(name.alias("formato"), s.cast("bigint").alias("s"), later.cast("bigint").alias("depois"), against.alias("fora"))


def _order() -> Column:
    return F.when(F.col("_two"), "dma").otherwise("unica")


def date_candidates(df: DataFrame, value: str, fixed_order: bool = True, names: tuple[str, str] = ("_forma", "_cand")) -> DataFrame:
    """Adds _forma, _cand like instant_candidates; s is the day number since 1970. Time of day is ignored. fixed_order: only a reading with the day first may be chosen."""
    had = df.columns
    df = _fields(df.withColumn("_g", F.split(_take(strip(F.col(value)), _ONLY_DATE, _DAY_FIELDS), "\u0001")), _FIELDS[:5])
    df = _day_parts(df)
    df = df.withColumns({"_dma": _day(F.col("_y"), F.col("_m"), F.col("_d")), "_mda": F.when(F.col("_two"), _day(F.col("_y"), F.col("_d"), F.col("_m")))})
    cand = F.array(F.when(F.col("_dma").isNotNull(), _read(_order(), F.col("_dma"))), F.when(F.col("_mda").isNotNull(), _read(F.lit("mda"), F.col("_mda"), against=F.lit(fixed_order))))
    return df.select(*had, F.lit("data").alias(names[0]), F.array_compact(cand).alias(names[1]))


def instant_candidates(df: DataFrame, value: str, day_of: str | None, zone: str, fixed_order: bool = True) -> DataFrame:
    """Adds _forma (shape of the writing) and _cand: array<struct<formato, s, depois, fora>>; drops no row.

    value: text of the field. day_of: column with the date that a bare time belongs to. zone: column with the IANA name
    for values without a zone of their own, null or passed through known_zone (once, in its small table). fixed_order: only
    readings with the day first, with a date and a 12-hour clock those with the month first, may be chosen; fora: the others.
    s: seconds since 1970; depois: the second occurrence, if any.
    Each step is a projection of its own, so that nothing is computed twice and the generated code stays small.
    """
    had = df.columns
    names = zone_names(df.sparkSession)
    df = df.withColumn("_v", strip(F.col(value)))
    df = df.withColumn("_num", F.coalesce(F.col("_v").rlike(_NUMBER), F.lit(False)))
    df = df.withColumn("_g", F.when(~F.col("_num"), F.split(_take(F.col("_v"), _FULL, _DAY_FIELDS + _CLOCK_FIELDS), "\u0001")))
    df = df.withColumn("_bare", (~F.col("_num") & (F.size("_g") <= 1)) if day_of is not None else F.lit(False))
    if day_of is not None:
        bare = F.concat(_take(strip(F.col(day_of)), _ONLY_DATE, _DAY_FIELDS), _take(F.col("_v"), _BARE, _CLOCK_FIELDS))
        df = df.withColumn("_g", F.when(F.col("_bare"), F.split(bare, "\u0001")).otherwise(F.col("_g")))
    df = _day_parts(_fields(df, _FIELDS))
    df = df.withColumns({"_h": _int(F.col("_H")), "_mi": _int(F.col("_MI")), "_se": _int(F.col("_S")), "_twelve": F.coalesce(F.col("_AP") != "", F.lit(False))})
    # bare numbers by their digits: Unix times, compact local date-times, spreadsheet days
    digits = F.length("_v")
    whole = F.col("_num") & ~F.col("_v").rlike("[.,]")
    df = df.withColumns({
        "_len": F.when(whole, digits), "_n": F.when(whole & (digits <= 17), F.col("_v")).try_cast("bigint"),
        "_c": F.when(whole & digits.isin(12, 14), F.rpad("_v", 14, "0")).try_cast("bigint"),
        "_ser": F.when(F.col("_num") & ~whole, F.translate("_v", ",", ".")).try_cast("decimal(30,15)"),
    })
    part = lambda unit, mod: (F.floor(F.col("_c") / unit) % mod).cast("int")
    df = df.withColumns({"_cy": part(10**10, 10**4), "_cm": part(10**8, 100), "_cd": part(10**6, 100), "_ch": part(10**4, 100), "_ci": part(100, 100), "_cs": part(1, 100)})
    month_first = F.col("_twelve") & ~F.col("_bare") & F.col("_two")
    df = df.withColumns({"_s": _seconds(), "_off": _offset(), "_named": F.when(F.coalesce(F.col("_ZN"), F.lit("")) != "", known_zone(F.col("_ZN"), names)).otherwise(F.col(zone))})
    compact = _day(F.col("_cy"), F.col("_cm"), F.col("_cd")).cast("bigint") * 86400 + F.when((F.col("_ch") < 24) & (F.col("_ci") < 60) & (F.col("_cs") < 60), F.col("_ch") * 3600 + F.col("_ci") * 60 + F.col("_cs"))
    local = {
        "_l0": F.when(F.col("_c").isNotNull(), compact).when(F.col("_ser").isNotNull(), F.round(F.col("_ser") * 86400).cast("bigint") - 25569 * 86400)
        .when(F.size("_g") == len(_FIELDS) + 1, _day(F.col("_y"), F.col("_m"), F.col("_d")).cast("bigint") * 86400 + F.col("_s")),
        "_l1": F.when(F.col("_two"), _day(F.col("_y"), F.col("_d"), F.col("_m")).cast("bigint") * 86400 + F.col("_s")),
        # a zone that is written but can't be understood leaves no reading
        "_z": F.when((F.coalesce(F.col("_ZA"), F.lit("")) == "") & (F.coalesce(F.col("_ZO"), F.lit("")) == ""), F.col("_named")),
    }
    df = df.withColumns(local)
    utc = lambda c: F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(F.col(c)), F.col("_z")))
    df = df.withColumns({f"_u{i}": F.when(F.col("_off").isNotNull(), F.col(f"_l{i}") - F.col("_off")).otherwise(utc(f"_l{i}")) for i in (0, 1)})
    shown = lambda i, later: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(F.col(f"_u{i}") + later), F.col("_z"))) == F.col(f"_l{i}")
    # the clock shows that time: else the zone skipped it; and again an hour later: it occurred twice
    df = df.withColumns({f"_k{i}": F.when(F.col("_off").isNotNull(), F.lit(True)).otherwise(shown(i, 0)) for i in (0, 1)})
    # a reading whose date exists but whose clock time was skipped stays a candidate, without an instant
    later = lambda i: F.when(F.col("_off").isNull() & F.col(f"_k{i}") & shown(i, 3600), F.col(f"_u{i}") + 3600)
    zoned = F.col("_off").isNotNull() | F.col("_z").isNotNull()
    read = lambda name, i, against=None: F.when(F.col(f"_l{i}").isNotNull() & zoned, _read(name, F.when(F.col(f"_k{i}"), F.col(f"_u{i}")), later(i), against))
    unix = lambda name, unit, least, most: F.when(F.col("_n").isNotNull() & F.col("_len").between(least, most), _read(F.lit(name), F.floor(F.col("_n") / unit)))
    own = F.when(F.col("_ser").isNotNull(), "planilha").otherwise("compacto")
    numbers = F.array(unix("unix_s", 1, 9, 10), unix("unix_ms", 1000, 12, 13), unix("unix_us", 1_000_000, 15, 16), read(own, 0))
    texts = F.array(read(_order(), 0, F.lit(fixed_order) & month_first), read(F.lit("mda"), 1, F.lit(fixed_order) & ~month_first))
    shape = (
        F.when(F.col("_num"), F.concat(F.lit("numero"), F.coalesce(F.col("_len").cast("string"), F.lit("_fracao"))))
        .when(F.col("_twelve"), F.when(F.col("_bare"), "hora12").otherwise("texto12"))
        .otherwise(F.when(F.col("_bare"), "hora24").otherwise("texto24"))
    )
    return df.select(*had, shape.alias("_forma"), F.array_compact(F.when(F.col("_num"), numbers).otherwise(texts)).alias("_cand"))


# ---- choosing


def fit_mixture(counts: pd.DataFrame, rounds: int = 200, smooth: float = 1e-4) -> pd.DataFrame:
    """EM for one source. counts: fonte, forma, leituras ('fmt:plausibility,...' in order), n. Gives fonte, forma, formato, peso.

    Works on shares of the source's values of a shape, with a smoothing in proportion: a thousand times
    the rows in the same mixture give the same weights.
    """
    out = []
    for (source, shape), part in counts.groupby(["fonte", "forma"], sort=True, dropna=False):
        total = float(part["n"].sum())
        rows = [([(f, float(p)) for f, p in (x.split(":") for x in r.split(","))], n / total) for r, n in zip(part["leituras"], part["n"])]
        formats = sorted({f for cs, _ in rows for f, _ in cs})
        weight = dict.fromkeys(formats, 1 / len(formats))
        for _ in range(rounds):
            got: dict[str, float] = defaultdict(float)
            for cs, share in rows:
                z = sum(weight[f] * p for f, p in cs)
                for f, p in cs:
                    got[f] += share * weight[f] * p / z
            new = {f: (got[f] + smooth) / (1 + smooth * len(formats)) for f in formats}
            moved = max(abs(new[f] - weight[f]) for f in formats)
            weight = new
            if moved < 1e-9:
                break
        out += [(source, shape, f, weight[f]) for f in formats]
    return pd.DataFrame(out, columns=["fonte", "forma", "formato", "peso"])


def _plausible(s: Column, seen: Column) -> Column:
    """How well an instant fits the record's reception: within 45 days before and 2 after, or not; no reception says nothing."""
    lag = F.unix_seconds(seen) - s
    return F.when(seen.isNull() | s.isNull() | ((lag > -2 * 86400) & (lag < 45 * 86400)), 1.0).otherwise(0.05)


def choose(df: DataFrame, source: Column, seen: Column | None, sure: float = 0.95) -> DataFrame:
    """Adds fonte, formato, s, depois, ambiguo from _forma and _cand; rows without a reading that may be chosen go. A readable value stays, however rare its format is."""
    seen = F.lit(None).cast("timestamp") if seen is None else seen
    scored = F.transform("_cand", lambda x: F.struct(x["formato"].alias("formato"), x["s"].alias("s"), x["depois"].alias("depois"), x["fora"].alias("fora"), F.when(F.size("_cand") > 1, _plausible(x["s"], seen)).otherwise(1.0).alias("p")))
    # a filter on _cand would be pushed below and repeat all that makes it; a generator's output is a barrier
    had = [c for c in df.columns if c != "_cand"]
    kept = df.withColumn("fonte", F.coalesce(source, F.lit("-"))).select(*had, "fonte", F.explode_outer(F.when(F.size("_cand") > 0, F.array(scored))).alias("_cand"))
    # the readings are used twice, by the mixture and by the choice; parsing is what costs
    df = checkpoint(kept.where(F.col("_cand").isNotNull()))
    one = F.get("_cand", F.lit(0))
    seen_as = F.when(F.size("_cand") == 1, F.concat(one["formato"], F.lit(":1.0"))).otherwise(F.array_join(F.transform("_cand", lambda x: F.concat(x["formato"], F.lit(":"), x["p"].cast("string"))), ","))
    counts = df.groupBy("fonte", F.col("_forma").alias("forma"), seen_as.alias("leituras")).agg(F.count("*").alias("n"))
    mixture = counts.groupBy("fonte").applyInPandas(lambda pdf: fit_mixture(pdf), "fonte string, forma string, formato string, peso double")
    maps = mixture.groupBy("fonte", F.col("forma").alias("_forma")).agg(F.map_from_entries(F.collect_list(F.struct("formato", "peso"))).alias("_pesos"))
    df = join_small(df, maps, ["fonte", "_forma"])
    # posteriors over all readings; of equal ones the first candidate counts, of those against the convention none
    posterior = F.transform("_cand", lambda x, i: F.struct((F.coalesce(F.try_element_at(F.col("_pesos"), x["formato"]), F.lit(0.0)) * x["p"]).alias("w"), (-i).alias("i"), x["formato"].alias("formato"), x["s"].alias("s"), x["depois"].alias("depois"), x["fora"].alias("fora")))
    single = F.array(F.struct(F.lit(1.0).alias("w"), F.lit(0).alias("i"), one["formato"].alias("formato"), one["s"].alias("s"), one["depois"].alias("depois"), one["fora"].alias("fora")))
    df = df.withColumn("_w", F.when(F.size("_cand") == 1, single).otherwise(posterior)).withColumn("_top", F.array_max(F.filter("_w", lambda x: ~x["fora"])))
    open_ = F.when(F.size("_w") > 1, (F.size(F.array_distinct(F.transform("_w", lambda x: x["s"]))) > 1) & (F.col("_top.w") < sure * F.aggregate("_w", F.lit(0.0), lambda a, x: a + x["w"]))).otherwise(F.lit(False))
    return df.withColumns({
        "formato": F.col("_top.formato"), "s": F.col("_top.s"), "depois": F.col("_top.depois"), "ambiguo": open_ | F.col("_top.depois").isNotNull(),
    }).where(F.col("s").isNotNull()).drop("_w", "_top", "_cand", "_pesos", "_forma")


def settle(df: DataFrame, witness: Column) -> DataFrame:
    """Of a clock time that occurred twice, the occurrence nearer to the witness (a timestamp; null: the first), which is then not open any more. Drops depois."""
    w, twice = F.unix_seconds(witness), F.col("depois").isNotNull()
    later = twice & w.isNotNull() & (F.abs(F.col("depois") - w) < F.abs(F.col("s") - w))
    return df.withColumns({"s": F.when(later, F.col("depois")).otherwise(F.col("s")), "ambiguo": F.col("ambiguo") & ~(twice & w.isNotNull())}).drop("depois")


def instant_text(s: Column) -> Column:
    return F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def date_text(s: Column) -> Column:
    return F.date_format(F.date_from_unix_date(s.cast("int")), "yyyy-MM-dd")


def normalise_instants(
    df: DataFrame, value: str, zone: str, source: Column, day_of: str | None = None, seen: Column | None = None, witness: Column | None = None, fixed_order: bool = True
) -> DataFrame:
    """Adds fonte, formato, instante (yyyy-mm-ddThh:mm:ssZ) and ambiguo; rows without a reading go.

    witness: another instant of the same record (timestamp), which says which occurrence of a
    repeated clock time is meant.
    """
    out = settle(choose(instant_candidates(df, value, day_of, zone, fixed_order), source, seen), F.lit(None).cast("timestamp") if witness is None else witness)
    return out.withColumn("instante", instant_text(F.col("s"))).drop("s")


def normalise_dates(df: DataFrame, value: str, source: Column, fixed_order: bool = True) -> DataFrame:
    """Adds fonte, formato, dia (yyyy-mm-dd) and ambiguo; rows without a reading go."""
    out = choose(date_candidates(df, value, fixed_order), source, None)
    return out.withColumn("dia", date_text(F.col("s"))).drop("s", "depois")
