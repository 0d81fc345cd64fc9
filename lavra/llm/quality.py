"""Per-document text quality statistics and the kind of a text: prose, list, table or junk.

Statistics are taken of the whole text. Labelling functions on the structure give weak labels to a
bounded sample of documents (SAMPLE, chosen by hashed id); gradient-boosted trees learn the statistics
of the four kinds from them; the probabilities are calibrated on the hand-checked labels, of which
contradictory and empty ones are left out. Every document is then classified by the trees.

Edge cases: null and blank texts are junk (nothing visible) with all statistics 0; documents without id are left out;
repeated rows are classified each; very long texts are read whole in time proportional to their length;
with too few kinds in the sample the labelling functions decide alone; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.llm import gbt

CLASSES = ("prosa", "lista", "tabela", "lixo")
SAMPLE = 6_000  # documents with weak labels that the trees are fitted on
HOLDOUT = 6_000  # hand-checked documents for the calibration

# Function words by language.
COMMON = {
    "pt": frozenset(
        """a o e é as os um uma de da do das dos em no na nos nas por pelo pela para com sem que se não mais mas como ao aos à às foi são ser está tem já também muito quando onde porque seu sua ou entre até sobre depois antes isso este esta esse essa ele ela eles nós me ainda apenas será foram cabe quem ninguém nada só ver havia mesmo nesse""".split()
    ),
    "es": frozenset("el la los las un una y a o en de del al es por para con sin que se no más pero como fue son ser está hay su sus lo le entre hasta sobre cuando porque este esta ese esa todavía nadie quien".split()),
    "en": frozenset("the a of and to in is was are were be been that this it for on with as at by from an or not but which when who their its had has have can could there than more nobody no if we you i".split()),
    "fr": frozenset("le la les un une des du de et est dans pour sur avec ne pas que qui au aux ce cette il elle nous vous ils à en plus mais".split()),
    "de": frozenset("der die das und ist nicht ein eine mit von zu auf für den dem des im wird sich auch es in an als".split()),
    "it": frozenset("il lo la gli di che e è non per un una sono della del nel con da in si".split()),
}
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_BULLET = re.compile(r"^\s*(?:[-–—•*·‣▪◦●○+»>]\s+|\[[ xX]?\]\s*|\(?\d{1,4}[.)\]ºª]\s*|\(?[a-zA-Z][.)]\s+|\(?[ivxIVX]{1,5}[.)]\s+|(?:passo|item|art\.?|§)\s*\d+\s*[:.\-)]?\s*)(?=\S)", re.I)
_GAPS = re.compile(r"\S(?: {2,}|\t+)(?=\S)")
_END = frozenset(".!?…:;\"”')]")
_INNER = re.compile(r"[.!?]\s+\S")
_RULER = re.compile(r"^[\s|+:\-=─┼│]+$")
_HEX = re.compile(r"^[0-9a-fA-F]{6,8}\s+(?:[0-9a-fA-F]{2}\s+){4,}")
_TAG = re.compile(r"</?t[dhr]\b", re.I)
_VISIBLE = re.compile(r"[^\s\x00-\x1f\x7f\u00ad\u200b-\u200f\u2060\ufeff\u2800]")

_CRUMBS = re.compile(r"\s>\s")

FEATURES = (
    "n_chars", "n_words", "mean_word", "symbol_share", "digit_share", "letter_share", "upper_share", "space_share", "n_lines", "mean_line", "line_variation",
    "end_punct_share", "inner_punct_share", "common_share", "distinct_root", "top_word_share", "words_per_distinct", "bullet_share", "pipe_share", "tag_share",
    "hex_share", "repeated_line_share", "repeated_sentence_share", "vowel_share", "long_word_share", "longest_word",
    "table_chars", "list_chars", "loose_chars", "prose_chars", "crumb_chars", "odd_chars", "sentence_words", "short_line_share", "flow_share",
)


_FUNCTION_WORDS = frozenset().union(*COMMON.values())


def common_share(said: Counter, n: int) -> float:
    """The largest share that the function words of one language have among n words, given with their counts."""
    hits = [(w, said[w]) for w in said.keys() & _FUNCTION_WORDS]
    return max(sum(k for w, k in hits if w in c) for c in COMMON.values()) / max(1, n)


def _inline(line: str) -> bool:
    """Entries one after the other in a line, between slashes, semicolons, bars or commas."""
    if line.count(" ") < 3 or _INNER.search(line):
        return False
    for sep, least in ((" / ", 4), ("; ", 4), (" | ", 4), (" • ", 4), (" · ", 4), (", ", 5)):
        if line.count(sep) < least - 1:
            continue
        pieces = line.split(sep)
        if len(line) / len(pieces) <= 50 and max(map(len, pieces)) <= 110:
            if sep != ", ":
                return True
            low = _WORD.findall(line.lower())
            return common_share(Counter(low), len(low)) < 0.36
    return False


def _cells(line: str) -> int:
    return line.count("|") + line.count("│") + line.count("┃") + line.count("¦")


def _gaps(line: str) -> bool:
    """Whether there is a wide gap inside the line."""
    return ("  " in line or "\t" in line) and _GAPS.search(line.strip()) is not None


def _line_kind(line: str, columns: Counter) -> str:
    """t (cells), l (marked or inline entries), c (a menu path), p (none of these)."""
    if line.count(">") >= 2 and len(_CRUMBS.findall(line)) >= 2:
        return "c"
    tabs, semicolons, commas = line.count("\t"), line.count(";"), line.count(",")
    if "<" in line and len(_TAG.findall(line)) >= 2 or _cells(line) >= 2 or tabs >= 1 and columns["\t", tabs] >= 2:
        return "t"
    if semicolons >= 2 and columns[";", semicolons] >= 2 and "; " not in line and not line.rstrip().endswith(";"):
        return "t"
    if commas >= 2 and columns[",", commas] >= 2 and ", " not in line:
        return "t"
    if columns["gap"] >= 2 and (_gaps(line) or line.startswith("   ")) and not _INNER.search(line.replace("  ", "")):
        return "t"
    if _BULLET.match(line) and len(line) < 400 and not re.search(r"\?\s+[-–—]\s", line) or _inline(line):
        return "l"
    return "p"


def _sentences(t: str) -> list[str]:
    """Pieces between line ends and the marks at the end of a sentence, without the blanks around them."""
    for mark in ".!?":
        t = t.replace(mark + " ", mark + "\n")
    return [x for x in map(str.strip, t.split("\n")) if x]


def _longest(t: str) -> int:
    """Characters of the longest piece without white space, brackets, bars and commas."""
    for mark in "<>|│;,":
        t = t.replace(mark, " ")
    return max(map(len, t.split()), default=0)


def _kinds(lines: list[str], lens: list[int], common: float) -> tuple[dict[str, float], float]:
    """Characters of the lines by kind (p: prose, u: short unmarked entries), and the share of lines that end where the next word would not fit."""
    columns: Counter = Counter()
    for x in lines:
        for sep in (";", "\t", ","):
            if c := x.count(sep):
                columns[sep, c] += 1
        if _gaps(x):
            columns["gap"] += 1
    chars = dict.fromkeys("tlcpu", 0.0)
    if not lines:
        return chars, 0.0
    plain: list[int] = []
    for i, x in enumerate(lines):
        kind = "t" if len(x) > 3 and _RULER.match(x) else _line_kind(x, columns)
        if kind == "p":
            plain.append(i)
        else:
            chars[kind] += lens[i]
    width = max((lens[i] for i in plain), default=0.0)
    full = {i for i in plain if i + 1 < len(lines) and lens[i] + 1 + len(lines[i + 1].split(None, 1)[0]) >= width - 3}
    flow = len(full) / max(1, len(plain) - 1) if len(plain) > 1 else 0.0
    entries = []
    for i in plain:
        x = lines[i]
        wrapped = flow > 0.5 and common >= 0.2 and (i in full or i - 1 in full)
        sentence = x.rstrip()[-1] in ".!?…" or _INNER.search(x) or len(x) > 120
        (entries if not wrapped and not sentence else []).append(i)
        if wrapped or sentence:
            chars["p"] += lens[i]
    for i in entries:
        chars["u" if len(entries) >= 3 else "p"] += lens[i]
    return chars, flow


def statistics(text: str | None) -> tuple[list[float], str]:
    """The numbers of FEATURES, and the weak label."""
    t = text or ""
    n = len(t)
    if not n or not _VISIBLE.search(t):
        return [0.0] * len(FEATURES), "lixo"
    low = _WORD.findall(t.lower())
    said = Counter(low)
    letters = sum(map(len, low))
    chars = Counter(t)
    digits = spaces = upper = odd = vowels = 0
    for c, k in chars.items():
        if c.isdigit():
            digits += k
        elif c.isspace():
            spaces += k
        elif c.isupper():
            upper += k
        if c == "\ufffd" or "\x80" <= c <= "\x9f" or c in "ÃÂâ€œ§©":
            odd += k
        if c.lower() in "aeiouáéíóúâêôãõàü":
            vowels += k
    lines = [x for x in t.split("\n") if x.strip()]
    lens = list(map(len, lines))
    m = max(1, len(lines))
    common = common_share(said, len(low))
    kinds, flow = _kinds(lines, lens, common)
    total = max(1.0, sum(kinds.values()))
    sentences = _sentences(t)
    mean = sum(lens) / m
    variation = (max(0.0, sum(x * x for x in lens) / m - mean * mean)) ** 0.5 / mean if lens else 0.0
    values = [
        n, len(low), letters / max(1, len(low)), (n - letters - digits - spaces) / n, digits / n, letters / n, upper / max(1, letters), spaces / n,
        len(lines), mean, variation,
        sum(1 for x in lines if x.rstrip()[-1] in _END) / m, sum(1 for x in lines if _INNER.search(x)) / m, common,
        len(said) / max(1.0, (2 * len(low)) ** 0.5), max(said.values()) / len(low) if low else 0.0, len(low) / max(1, len(said)),
        sum(1 for x in lines if _BULLET.match(x)) / m, sum(1 for x in lines if _cells(x) >= 2) / m, len(_TAG.findall(t)) / n if "<" in t else 0.0,
        sum(bool(_HEX.match(x)) for x in lines) / m,
        1 - sum(map(len, set(lines))) / total, 1 - sum(map(len, set(sentences))) / max(1, sum(map(len, sentences))),
        vowels / max(1, letters), sum(k for w, k in said.items() if len(w) > 18) / max(1, len(low)), _longest(t),
        kinds["t"] / total, kinds["l"] / total, kinds["u"] / total, kinds["p"] / total, kinds["c"] / total, odd / n,
        len(low) / max(1, len(sentences)), sum(1 for x in lens if x < 60) / m if lens else 0.0, flow,
    ]
    return [float(v) for v in values], _weak(dict(zip(FEATURES, values)))


def _weak(f: dict) -> str:
    """Labelling functions in order of precedence."""
    if f["hex_share"] > 0.5 or f["odd_chars"] > 0.15 or f["crumb_chars"] > 0.5:
        return "lixo"
    entries = f["list_chars"] + f["loose_chars"]
    tight = max(entries, f["table_chars"])
    if max(f["repeated_line_share"], f["repeated_sentence_share"]) > 0.6 and (tight < 0.5 or f["distinct_root"] < 1):
        return "lixo"
    if f["words_per_distinct"] >= 4 and f["distinct_root"] < 2 and f["n_words"] >= 16 and f["table_chars"] < 0.5:
        return "lixo"
    if f["letter_share"] + f["digit_share"] < 0.05 or f["letter_share"] < 0.05 and f["table_chars"] < 0.5 or f["symbol_share"] > 0.45 and f["tag_share"] < 0.01 and f["pipe_share"] < 0.5:
        return "lixo"
    if f["table_chars"] > 0.5 and f["n_lines"] >= 2:
        return "tabela"
    strange = f["n_words"] >= 6 and f["common_share"] < 0.12 or f["n_chars"] > 60 and (f["longest_word"] > max(60, 0.3 * f["n_chars"]) or f["letter_share"] < 0.35)
    if entries > 0.5 and f["letter_share"] > 0.4 and f["longest_word"] < 60:
        return "lista"
    return "lixo" if strange else "prosa"


# ---- over tables


def document_statistics(df: DataFrame, key: str = "doc_id", text: str = "text", extra: list[str] | None = None) -> DataFrame:
    """<key>, the extra columns, the FEATURES (double), fraca (weak label)."""
    extra = extra or []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [statistics(t) for t in pdf["_text"]]
            out = pd.DataFrame([v for v, _ in got], columns=list(FEATURES), dtype=float)
            for i, c in enumerate([key, *extra]):
                out.insert(i, c, pdf[c].to_numpy())
            out["fraca"] = [k for _, k in got]
            yield out

    src = df.where(F.col(key).isNotNull()).select(key, *extra, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in src.drop("_text").dtypes)
    return src.mapInPandas(run, f"{kinds}, " + ", ".join(f"{c} double" for c in FEATURES) + ", fraca string")


def hand_checked(labels: DataFrame, key: str = "doc_id", label: str = "classe") -> DataFrame:
    """<key>, classe: documents on which all non-empty opinions agree."""
    ok = labels.select(key, F.lower(F.trim(label)).alias("classe")).where(F.col("classe").isin(*CLASSES))
    return ok.groupBy(key).agg(F.min("classe").alias("classe"), F.count_distinct("classe").alias("n")).where("n = 1").drop("n")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, holdout: int = HOLDOUT) -> gbt.Boosted | None:
    """Trees on at most about `sample` weakly labelled documents, calibrated on at most `holdout` hand-checked ones. Both are taken in one scan."""
    n = docs.count()
    part = int(min(1.0, sample / max(1, n)) * 1_000_000)
    checked = hand_checked(labels, key).orderBy(F.xxhash64(key)).limit(holdout).withColumnRenamed("classe", "_opiniao")
    drawn = F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000)) < part
    some = docs.select(key, F.col(text).alias("_texto")).join(F.broadcast(checked), key, "left").where(drawn | F.col("_opiniao").isNotNull())
    got = document_statistics(some.withColumn("_sorteado", drawn), key, "_texto", ["_sorteado", "_opiniao"]).toPandas()
    weak, held = got[got["_sorteado"]], got[got["_opiniao"].notna()]
    x, y = weak[list(FEATURES)].to_numpy(), np.array([CLASSES.index(k) for k in weak["fraca"]], dtype=int)
    if len(y) < 20 or len(set(y)) < 2:
        return None
    # rare kinds count as much together as a third of the prose
    counts = np.bincount(y, minlength=len(CLASSES))
    weight = np.minimum(5.0, counts.max() / np.maximum(1, 3 * counts))[y]
    model = gbt.fit(x, y, len(CLASSES), np.maximum(1.0, weight))
    return gbt.calibrate(model, held[list(FEATURES)].to_numpy(), np.array([CLASSES.index(k) for k in held["_opiniao"]], dtype=int))


def classify(docs: DataFrame, model: gbt.Boosted | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """<key>, classe, probabilidade and the FEATURES of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [statistics(t) for t in pdf["_text"]]
            x = np.array([v for v, _ in got], dtype=float).reshape(-1, len(FEATURES))
            out = pd.DataFrame(x, columns=list(FEATURES))
            out.insert(0, key, pdf[key].to_numpy())
            blank = x[:, 0] == 0
            if model is None:
                out["classe"], out["probabilidade"] = [k for _, k in got], 1.0
            else:
                p = model.probabilities(x) if len(x) else np.zeros((0, len(CLASSES)))
                out["classe"] = np.where(blank, "lixo", np.array(CLASSES)[p.argmax(axis=1)] if len(p) else [])
                out["probabilidade"] = np.where(blank, 1.0, p.max(axis=1) if len(p) else [])
            yield out

    src = docs.where(F.col(key).isNotNull()).select(key, F.col(text).alias("_text"))
    kind = dict(src.dtypes)[key]
    return src.mapInPandas(run, f"`{key}` {kind}, " + ", ".join(f"{c} double" for c in FEATURES) + ", classe string, probabilidade double")
