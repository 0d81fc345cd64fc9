"""Sources: JSON captures, logs, dumps, spreadsheets, policies. All give DataFrames with fixed schemas."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CAPTURE = """ts string, usuario string, maquina string, dominio string, ferramenta string, forma string, qtd string, tipo string, sens string, finalidade string,
  deteccoes array<struct<tipo:string,contagem:int,validado:boolean>>, previa string, titulo string, par_id string, papel string, prompt string, resposta string,
  fonte_captura string, origem_sensor string, via string"""


def json_captures(lines: DataFrame, column: str = "value") -> DataFrame:
    """Captures from JSON text; a malformed text gives a row of nulls, kept with `valido` false."""
    body = F.from_json(F.col(column), CAPTURE, {"mode": "PERMISSIVE"})
    return lines.select(body.alias("b"), F.try_parse_json(F.col(column)).isNotNull().alias("valido")).select("b.*", "valido")


def sanitise(df: DataFrame) -> DataFrame:
    """Defaults, enumerations and lengths of capture fields."""
    cut = lambda c, n: F.substring(F.coalesce(F.trim(c), F.lit("")), 1, n)
    source = F.when(F.col("fonte_captura") != "", F.col("fonte_captura")).when(F.col("origem_sensor").isNotNull() | F.col("via").isNotNull(), "agente").otherwise("extensao")
    return df.withColumns({
        "usuario": cut("usuario", 120), "maquina": cut("maquina", 120), "dominio": F.lower(cut("dominio", 200)), "titulo": cut("titulo", 200), "previa": cut("previa", 200),
        "sens": F.when(F.col("sens").isin("Pública", "Interna", "Confidencial", "Crítica"), F.col("sens")).otherwise("Interna"),
        "qtd": F.greatest(F.lit(1), F.coalesce(F.col("qtd").try_cast("int"), F.lit(1))), "fonte_captura": source,
    })


# Severity of the log to sensitivity, label to information type (a label that is not there has the default type).
SEVERITIES = {"critical": "Crítica", "high": "Confidencial", "medium": "Interna", "low": "Pública"}
LABELS = {
    "PII-CPF": "INFO-003", "PII-Cartao": "INFO-004", "FIN-Resultado": "INFO-011", "SEC-Credencial": "INFO-018", "DEV-Codigo": "INFO-014",
}
DEFAULT_LABEL = "INFO-000"
UPLOADS = ("IA-Generativa-Upload", "IA-Generativa-Colagem")


def cef(lines: DataFrame, column: str = "value") -> DataFrame:
    """Security log lines in the common event format: vendor, product, event, severity, sens, informacao_id by the label (cs1), politica (act), and the extension as a map.

    An unknown severity gives Interna, an unknown label the default type.
    """
    head = F.split(F.regexp_extract(column, r"CEF:\d\|(.*)$", 1), r"(?<!\\)\|", 7)
    ext = F.str_to_map(F.regexp_replace(F.get(head, F.lit(6)), r"\s(?=\w+=)", "\u0001"), F.lit("\u0001"), F.lit("="))
    level = F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv])
    out = lines.where(F.col(column).rlike(r"CEF:\d\|")).select(F.get(head, F.lit(0)).alias("fornecedor"), F.get(head, F.lit(1)).alias("produto"), F.get(head, F.lit(4)).alias("evento"), F.lower(F.get(head, F.lit(5))).alias("severidade"), ext.alias("campos"))
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return out.withColumns({
        "sens": F.coalesce(F.try_element_at(level, F.col("severidade")), F.lit("Interna")), "politica": F.col("campos.act"),
        "informacao_id": F.coalesce(F.try_element_at(label, F.col("campos.cs1")), F.lit(DEFAULT_LABEL)),
    })


def uploads(events: DataFrame) -> DataFrame:
    """Of cef events, those of the policies on generative tools; users may be missing."""
    return events.where(F.col("politica").isin(*UPLOADS))


def web_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """W3C proxy log: instant, user, host; the query string never enters."""
    rx = r"^(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+)\s+(\S+)"
    url = F.regexp_extract(column, rx, 5)
    host = F.lower(F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z]+://", ""), r"[/:?].*$", ""))
    when = F.try_to_timestamp(F.concat_ws(" ", F.regexp_extract(column, rx, 1), F.regexp_extract(column, rx, 2)))
    return lines.where(F.col(column).rlike(rx)).select(when.alias("quando"), F.regexp_extract(column, rx, 3).alias("usuario"), F.regexp_extract(column, rx, 4).alias("metodo"), host.alias("host"))


def connections(lines: DataFrame, column: str = "value") -> DataFrame:
    """Remote addresses and ports of a connection listing, with whether the address is public."""
    rx = r"(?i)^\s*tcp\d?\s+(?:\d+\s+\d+\s+)?(\S+)\s+(\S+)\s+(\w+)"
    # BSD writes the port after a dot; it also has queue lengths before the addresses
    remote = F.regexp_extract(column, rx, 2)
    ip = F.regexp_replace(F.regexp_replace(remote, r"[:.](\d+|\*)$", ""), r"[\[\]]", "")
    out = lines.where(F.col(column).rlike(rx)).select(ip.alias("ip"), F.regexp_extract(remote, r"[:.](\d+)$", 1).try_cast("int").alias("porta"), F.upper(F.regexp_extract(column, rx, 3)).alias("estado"))
    return out.withColumn("publico", is_public(F.col("ip")))


def is_public(ip: Column) -> Column:
    """An address that can be reached from outside: version 6 but link-local and loopback; version 4, four numbers, none of the private blocks. Any other text is none."""
    n = [F.regexp_extract(ip, r"^(\d+)\.(\d+)\.(\d+)\.(\d+)$", i).try_cast("int") for i in (1, 2)]
    private = n[0].isin(10, 127) | ((n[0] == 192) & (n[1] == 168)) | ((n[0] == 172) & n[1].between(16, 31)) | ((n[0] == 169) & (n[1] == 254))
    v6 = ~F.startswith(F.lower(ip), F.lit("fe80")) & (ip != "::1")
    return F.coalesce(F.when(F.contains(ip, F.lit(":")), v6).otherwise(~private), F.lit(False))


def dns_names(lines: DataFrame, column: str = "value") -> DataFrame:
    """Every host name in a resolver cache dump, whatever the words before it."""
    found = F.regexp_extract_all(F.lower(F.col(column)), F.lit(r"(?:^|[^a-z0-9.\-])((?:[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?\.)+[a-z]{2,})(?![a-z0-9\-])"), F.lit(1))
    return lines.select(F.explode(found).alias("host")).select(F.lower("host").alias("host")).distinct()


def event_stream_text(body: Column) -> Column:
    """The data lines of a server-sent event body, joined; the end marker is dropped."""
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: x.startswith("data:"))
    return F.array_join(F.filter(F.transform(lines, lambda x: F.trim(F.substring(x, 6, 1 << 30))), lambda x: x != "[DONE]"), "\n")


def policy(path: str) -> dict:
    """A policy document in YAML, read on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def spreadsheet(spark: SparkSession, path: str, sheet: str, header_row: int = 2) -> DataFrame:
    """A sheet of a workbook as strings; the header's row number counts from 0, blank rows are skipped.

    A workbook is one small file and is read on the driver.
    """
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): rels[s.get(rel)] for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{{{ns['m']}}}sheet")}
        target = sheets[sheet].lstrip("/")
        root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
    rows: dict[int, dict[int, str]] = {}
    for row in root.iter(f"{{{ns['m']}}}row"):
        for c in row.findall("m:c", ns):
            col = 0
            for ch in re.match(r"[A-Z]+", c.get("r"))[0]:
                col = col * 26 + ord(ch) - 64
            value = c.find("m:v", ns)
            text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if c.get("t") == "inlineStr" else (value.text if value is not None else None)
            if text is not None and c.get("t") == "s":
                text = shared[int(text)]
            rows.setdefault(int(row.get("r")) - 1, {})[col - 1] = text
    header = rows.get(header_row, {})
    cols = [(i, header[i]) for i in sorted(header) if header[i]]
    data = [tuple(r.get(i) for i, _ in cols) for n, r in sorted(rows.items()) if n > header_row and any(v for v in r.values())]
    return spark.createDataFrame(data, ", ".join(f"`{name}` string" for _, name in cols))


def excel_date(serial: Column) -> Column:
    """A spreadsheet day number as a timestamp, to the second."""
    return F.timestamp_seconds(F.round(serial.try_cast("decimal(30,15)") * 86400).cast("bigint") - 25569 * 86400)
