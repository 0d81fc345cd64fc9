"""Scalar functions on fields as they arrive: texts, numbers, dates, JSON, hosts. All native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lavra.functions.text import strip
from lavra.operators.similarity import normalise


def text(c: Column) -> Column:
    """Null becomes the empty text; white space at the ends goes."""
    return F.coalesce(strip(c), F.lit(""))


def integer(c: Column) -> Column:
    """A number written with comma or dot, cut off; anything else is 0."""
    return F.coalesce(F.replace(strip(c), F.lit(","), F.lit(".")).try_cast("double").try_cast("bigint"), F.lit(0))


def local_datetime(c: Column) -> Column:
    """dd/mm/yyyy hh:mm at the beginning of a text; a date that does not exist is null."""
    rx = r"^\s*(\d{2})/(\d{2})/(\d{4})[ T](\d{2}):(\d{2})"
    g = lambda i: F.regexp_extract(c, rx, i)
    return F.try_to_timestamp(F.concat(g(3), F.lit("-"), g(2), F.lit("-"), g(1), F.lit(" "), g(4), F.lit(":"), g(5), F.lit(":00")))


def iso_without_zone(c: Column) -> Column:
    """An ISO instant as its clock time; the zone is dropped, not applied."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(c), r"(?i)(z|[+-]\d{2}:?\d{2})$", ""))


def slug(c: Column, most: int = 40) -> Column:
    s = F.substring(F.replace(normalise(c), F.lit(" "), F.lit("-")), 1, most)
    return F.when(s == "", "x").otherwise(F.regexp_replace(s, "-$", ""))


def first_json(c: Column) -> Column:
    """The text from the first to the last brace, without thoughts before it, if it is JSON."""
    body = F.regexp_extract(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(F.nullif(body, F.lit(""))).isNotNull(), body)


def quantity(c: Column) -> Column:
    """(quantity, rest) of a text like "10 arquivos de propostas"."""
    rx = r"(?i)^\s*(\d+)\s+\p{L}+\s+de\s+(.+)$"
    n = F.regexp_extract(c, rx, 1).try_cast("int")
    return F.struct(F.coalesce(n, F.lit(1)).alias("qtd"), F.when(n.isNotNull(), F.regexp_extract(c, rx, 2)).otherwise(c).alias("resto"))


def snap(c: Column, vocabulary: list[str]) -> Column:
    """The entry of a vocabulary that equals the text without case, else the first that contains it or is contained in it."""
    low = F.lower(strip(c))
    words = F.array(*[F.lit(v) for v in vocabulary])
    same = F.filter(words, lambda v: F.lower(v) == low)
    near = F.filter(words, lambda v: F.contains(F.lower(v), low) | F.contains(low, F.lower(v)))
    return F.when(low != "", F.coalesce(F.get(same, F.lit(0)), F.get(near, F.lit(0))))


def level(score: Column, thresholds: dict[str, float]) -> Column:
    """The first level, from the highest threshold down, that a score reaches."""
    out = F.lit(None).cast("string")
    for name, least in sorted(thresholds.items(), key=lambda x: x[1]):
        out = F.when(score >= least, name).otherwise(out)
    return out


def sql_literal(c: Column) -> Column:
    """A text as a quoted SQL literal; null as NULL."""
    return F.coalesce(F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def host_port(c: Column) -> Column:
    """(host, porta) of host:port, [v6]:port and dotted forms."""
    host = F.regexp_replace(F.regexp_replace(c, r"[:.](\d+|\*)$", ""), r"[\[\]]", "")
    return F.struct(host.alias("host"), F.regexp_extract(c, r"[:.](\d+)$", 1).try_cast("int").alias("porta"))


def json_strings(c: Column) -> Column:
    """All string values inside a JSON text, in order, with their escapes decoded; keys are left out, broken JSON gives none."""
    # strings with what follows them; those before a colon are keys
    found = F.regexp_extract_all(c, F.lit(r'"(?:[^"\\]++|\\.)*+"(?:\s*:)?'), F.lit(0))
    values = F.transform(F.filter(found, lambda x: x.endswith('"')), lambda x: F.get(F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>"), F.lit(0)))
    return F.when(F.try_parse_json(c).isNotNull(), values).otherwise(F.array().cast("array<string>"))
