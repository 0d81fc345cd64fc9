"""Personal information inside free text, found through its disguises and replaced by typed placeholders.

A text goes through a chain of transducers. Each rewrites disguised characters to plain ones and keeps,
for every character of its output, the place it came from: homoglyphs and full-width forms, invisible
characters, marks apart from their letters, letters written apart, numbers in words (also mixed with
digits), "at" and "dot" in an address; in names, digits that stand for letters. Detectors work on the plain text; a match is
given by its place in the source. A text without any trigger of a transducer is its own output.

Detectors, in order of precedence: e-mail, street address, identity documents (CPF with correct check
digits; other numbers by the word before them), telephone, names. A name is read from a lexicon of
all given names and surnames of the staff table (see Lexicon.fit) by a small grammar (given name
and surnames; surname, given name; initial and surname), or, outside the lexicon, as a run of
capitalised words after a word that announces a person.

Edge cases: null and empty texts give nothing; very long texts are scanned whole, by patterns without nested repetition;
masked values ([CPF-MASCARADO], ***) are none; the same value twice gives two occurrences; a row
without id is left out; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("nome", "email", "telefone", "documento", "endereco")
PLACEHOLDER = {t: f"[{t.upper()}]" for t in TYPES}

# ---- transducers

# Letters of other scripts that look like Latin ones.
_LOOKALIKES = str.maketrans(
    "АВЕКМНОРСТУХаеорсухіјѕԁɡΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονρτυχ", "ABEKMHOPCTYXaeopcyxijsdgABEZHIKMNOPTYXaovptux"
)
# Digits as words.
_WORDS = {
    "zero": "0", "um": "1", "uma": "1", "dois": "2", "duas": "2", "três": "3", "tres": "3", "quatro": "4", "cinco": "5", "seis": "6", "meia": "6",
    "sete": "7", "oito": "8", "nove": "9", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "cero": "0", "uno": "1", "dos": "2", "cuatro": "4", "siete": "7", "ocho": "8", "nueve": "9",
}
# Numbers of two digits as words; tens take a unit after them (vinte e um, treinta y dos, forty-two).
_TEENS = {
    w: str(n)
    for words in (
        "dez onze doze treze catorze quinze dezesseis dezessete dezoito dezenove", "diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve",
        "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen",
    ) for n, w in enumerate(words.split(), 10)
}
_TENS = {
    w: str(n)
    for words in ("vinte trinta quarenta cinquenta sessenta setenta oitenta noventa", "veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa", "twenty thirty forty fifty sixty seventy eighty ninety")
    for n, w in enumerate(words.split(), 2)
}
_ODD = re.compile(r"[^\x00-ſ‐-‧‰-›]|[­​-‏⁠﻿]")
_any = lambda words: "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"
_NUMERAL = rf"(?:(?P<tens>{_any(_TENS)})(?:(?: e | y |-| )(?P<unit>{_any(_WORDS)})\b)?|(?P<teen>{_any(_TEENS)})|(?P<word>{_any(_WORDS)})|(?P<digits>\d{{1,5}}))(?!\w)"
_PLAIN_NUMERAL = re.sub(r"\?P<\w+>", "?:", _NUMERAL)
_SPELLED = re.compile(rf"(?<!\w){_PLAIN_NUMERAL}(?:[ ,.\-]{{1,3}}{_PLAIN_NUMERAL}){{2,}}", re.I)
_ONE_NUMERAL = re.compile(_NUMERAL, re.I)
_NUMBER_WORDS = frozenset(_WORDS) | frozenset(_TEENS) | frozenset(_TENS)
#: Letters written apart: four and more single ones in a row.
_SPACED = re.compile(r"(?<!\S)[^\W\d_](?: [^\W\d_]){3,}(?!\S)")
#: A word with digits in the place of letters.
_LEET = re.compile(r"(?<![\w@./\-])[^\W\d_]+[013457][^\W_]*(?![\w@./\-])")
# Digits that look like letters.
_AS_LETTERS = str.maketrans("013457", "oieast")
_APART = str.maketrans(",.-", "   ")
_LOCAL = r"[A-Za-z0-9][A-Za-z0-9._%+\-]*"
_AT = r"(?:\s?@\s?|\s?[(\[{<]\s?(?:at|arroba)\s?[)\]}>]\s?|\s(?:arroba|at)\s)"
_DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|ponto|punto)\s?[)\]}]\s?|\s(?:dot|ponto|punto)\s)"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
_DISGUISED = re.compile(rf"(?<![A-Za-z0-9._%+\-])({_LOCAL})({_AT})({_LABEL}(?:{_DOT}{_LABEL})+)", re.I)
#: Parts of words without which a pattern can't match, in lower case: tests that spare most texts the pattern.
_AT_HINTS = ("@", "arroba", "(at", "[at", "{at", "<at", " at ", "( at", "[ at")
_CUED_HINTS = ("rg", "r.g", "identidade", "cédula", "cedula", "pis", "nis", "nit", "pasep", "rut", "run", "r.u", "ssn", "dni", "passap", "passpo", "pasapo")
_STREET_HINTS = (
    "rua", "r. ", "av", "alameda", "al.", "travessa", "tv.", "praça", "pça", "largo", "calle", "estrada", "rod", "carre", "paseo", "via", "ladeira", "beco", "br",
    " st", "rd", "road", "lane", "ln", "blvd", "drive", "dr", "court", "ct", "way", "place", "square",
)


class Plain:
    """The output of the transducers. Its character i comes from the source's characters at[i] to to[i] (None: from the same place)."""

    __slots__ = ("text", "at", "to")

    def __init__(self, source: str):
        self.text, self.at, self.to = source, None, None
        if _ODD.search(source):
            self._letters()
        if len(self.text) > 6 and self.text.count(" ") > 2 and _SPACED.search(self.text):
            self._rewrite(_SPACED, self._joined)
        low = self.text.lower()
        if sum(w in _NUMBER_WORDS for w in low.translate(_APART).split()) >= 2:
            self._rewrite(_SPELLED, self._digits)
        if any(h in low for h in _AT_HINTS):
            self._rewrite(_DISGUISED, self._address)

    def span(self, a: int, b: int) -> tuple[int, int]:
        """The place in the source of the output's characters a to b."""
        return (a, b) if self.at is None else (self.at[a], self.to[b - 1])

    def _letters(self) -> None:
        """Plain letters; marks on a letter are joined to it where there is such a letter, else left out."""
        out, at, to = [], [], []
        for i, c in enumerate(self.text):
            if unicodedata.category(c) == "Cf":
                continue
            if unicodedata.combining(c):
                if out:
                    one = unicodedata.normalize("NFC", out[-1] + c)
                    if len(one) == 1:
                        out[-1] = one
                    to[-1] = i + 1
                continue
            for x in unicodedata.normalize("NFKC", c).translate(_LOOKALIKES) if ord(c) > 0x17F else c:
                out.append(x)
                at.append(i)
                to.append(i + 1)
        self.text, self.at, self.to = "".join(out), at, to

    def _rewrite(self, pattern: re.Pattern, how) -> None:
        out, at, to, done = [], [], [], 0
        for m in pattern.finditer(self.text):
            pieces = how(m)
            if pieces is None:
                continue
            out.append(self.text[done : m.start()])
            at.extend(range(done, m.start()))
            to.extend(range(done + 1, m.start() + 1))
            for piece, start, end in pieces:
                out.append(piece)
                if len(piece) == end - start:
                    at.extend(range(start, end))
                    to.extend(range(start + 1, end + 1))
                else:
                    at.extend([start] * len(piece))
                    to.extend([end] * len(piece))
            done = m.end()
        if not done:
            return
        out.append(self.text[done:])
        at.extend(range(done, len(self.text)))
        to.extend(range(done + 1, len(self.text) + 1))
        if self.at is not None:
            at, to = [self.at[i] for i in at], [self.to[i - 1] for i in to]
        self.text, self.at, self.to = "".join(out), at, to

    @staticmethod
    def _digits(m: re.Match):
        """Digits of a run of numerals; only of runs with five words, or with two and as many digits as an identifier has."""
        pieces, words, digits = [], 0, 0
        for w in _ONE_NUMERAL.finditer(m[0]):
            if w["digits"]:
                value = w["digits"]
            else:
                words += 1
                low = lambda g: w[g].lower()  # noqa: B023, E731
                value = _TENS[low("tens")] + (_WORDS[low("unit")] if w["unit"] else "0") if w["tens"] else _TEENS[low("teen")] if w["teen"] else _WORDS[low("word")]
            digits += len(value)
            pieces.append((value, m.start() + w.start(), m.start() + w.end()))
        return pieces if words >= 5 or words >= 2 and digits >= 8 else None

    @staticmethod
    def _joined(m: re.Match):
        return [(c, m.start() + i, m.start() + i + 1) for i, c in enumerate(m[0]) if c != " "]

    @staticmethod
    def _address(m: re.Match):
        if m[2] == "@" and " " not in m[0] and "(" not in m[0] and "[" not in m[0]:
            return None
        pieces, at = [(m[1], m.start(1), m.end(1)), ("@", m.start(2), m.end(2))], m.start(3)
        for part in re.split(rf"({_DOT})", m[3], flags=re.I):
            pieces.append(("." if re.fullmatch(_DOT, part, re.I) else part, at, at + len(part)))
            at += len(part)
        return pieces


# ---- detectors

_EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+\-]){_LOCAL}@{_LABEL}(?:\.{_LABEL})+")
_FILE = re.compile(r"\.(?:png|jpe?g|gif|svg|webp|bmp|pdf|docx?|xlsx?|csv|zip|css|js)$", re.I)

_NAME_WORD = r"(?:[A-ZÀ-Ý0-9][\w'’\-]*|d[aeo]s?|D[AEO]S?|del|DEL|la|LA|los|LOS|las|LAS|e|E)"
_NUMBER_MARK = r"(?:\s*,\s*|\s+)(?:(?:n|N)(?:[º°.]|[oO]\.?\s)\s*|(?:num|núm|número|numero)\.?\s*|#\s*|(?:s/n))?"
_STREET = re.compile(
    r"(?<![\w.@])(?:(?:[Rr]ua|RUA|R\.|[Aa]v\.|AV\.?|[Aa]venida|AVENIDA|[Aa]lameda|ALAMEDA|Al\.|AL\.|[Tt]ravessa|TRAVESSA|Tv\.|TV\.|[Pp]raça|PRAÇA|Pça\.?|[Ll]argo|LARGO"
    r"|[Cc]alle|CALLE|[Ee]strada|ESTRADA|[Cc]arrera|CARRERA|[Pp]aseo|PASEO|[Vv]ia|VIA|[Ll]adeira|LADEIRA|[Bb]eco|BECO)"
    rf"\s+(?:{_NAME_WORD}\s+){{0,7}}?{_NAME_WORD}{_NUMBER_MARK}\d{{1,6}}\b"
    r"|(?:[Rr]odovia|RODOVIA|[Ee]strada|ESTRADA|[Cc]arretera|Rod\.|BR)\s*[A-Z0-9][\w\-]*(?:\s+[A-ZÀ-Ýd][\w\-]*){0,5}\s*,?\s*(?:km|KM|Km)\.?\s*\d+"
    r"|\d{1,6}\s+(?:[A-Z][\w'’\-]*\s+){1,4}(?:[Ss]treet|STREET|St|ST|[Aa]ve(?:nue)?|AVE(?:NUE)?|[Rr](?:oa)?d|RO?A?D|[Ll](?:ane|n)|LANE|LN|[Bb]lvd|[Dd]rive|DRIVE|Dr|[Cc]ourt|Ct|[Ww]ay|WAY|[Pp]lace|[Ss]quare)\b)"
)
_STREET_LOWER = re.compile(
    r"(?<![\w.@])(?:rua|r\.|av\.?|avenida|alameda|travessa|praça|largo|calle|estrada)\s+(?:[\w'’\-]+\s+){0,6}?[\w'’\-]+(?:\s*,\s*|\s+)(?:n[º°.]|no\s|número\s)\s*\d{1,6}\b"
    r"|(?<![\w.@])rodovia\s+[a-z]{1,3}-?\d+\s*,?\s*km\s*\d+"
    r"|(?<![\w.@])(?:rua|r\.|av\.|avenida|alameda|travessa|praça|calle)\s+(?:[\w'’\-]+\s+){0,6}?[\w'’\-]+,\s*\d{1,6}\b(?=\s*(?:$|[,;.()/\-]|ap))"
)
_STREET_TAIL = re.compile(
    r"(?:[\s,\-]*(?:\b(?:ap(?:to|t)?\.?|apartamento|casa|bloco|bl\.?|sala|fundos|loja|lote|qd\.?|quadra|conj\.?|andar|CEP)\s*[\w.\-]*\d[\w\-]*|\bbloco\s+\w\b))*(?:\s*[,\-]\s*(?:[A-ZÀ-Ý][\w]*(?:\s+d[aeo]s?)?\s*){1,4}/[A-Z]{2}\b(?:,?\s*CEP\s*[\d\-]+)?)?", re.I
)

_CPF = re.compile(r"(?<![\w*.\-/])(?:\d{3}([. ])\d{3}\1\d{3}[\-./ ]\d{2}|\d{9}[\-/]\d{2}|\d{11}|\d{3}\.\d{3}\.\d{3}\d{2})(?![\w*]|[\-/.]\d)")
_CUED = re.compile(
    r"(?<!\w)(?P<cue>R\.?G\.?|identidade|c[ée]dula(?: de identidade)?|NIS|PIS|PASEP|NIT|passaporte|passport|pasaporte|R\.?U\.?T\.?|R\.?U\.?N\.?|SSN|DNI)(?:\s*/\s*[A-Za-z]{2,6})?"
    r"\s*(?:(?:n|N)[º°.o]\.?\s*|n[uú]mero\s+|no\.\s*|number\s+|num\.?\s*)?(?::|#|-|=)?\s*"
    r"(?P<v>(?=[A-Za-z0-9.\-/ ]{0,20}\d)[A-Za-z]{0,3}[ \-]?\d(?:[\d.\-/]|\s(?=\d))*(?:-?[xXkK](?!\w))?)", re.I
)
_PHONE = re.compile(
    r"(?<![\w*.,/#@\-])(?:"
    r"(?P<i>\+\d{1,3}(?:[\s.\-]{0,3}\(?0?\d{1,5}\)?){2,6}|\+\d{9,15})"
    r"|(?P<b>\(?0?[1-9]\d\)?\s{0,2}[.\-]?\s{0,2}9[\s.\-]?\d{4}\s?[.\-]?\s?\d{4})"
    r"|(?P<f>\(0?[1-9]\d\)\s{0,2}[2-5]\d{3}\s?[.\-]?\s?\d{4}|0?[1-9]\d\s{0,2}[.\-]?\s{0,2}[2-5]\d{3}\s?[.\-]?\s?\d{4})"
    r"|(?P<u>\(\d{3}\)\s?\d{3}[\s.\-]?\d{4}|\d{3}[\-. ]\d{3}[\-. ]\d{4}|1[\-. ]\d{3}[\-. ]\d{3}[\-. ]\d{4})"
    r")(?![\w*]|[\-/.,]\d)"
)
_PHONE_START = re.compile(r"[\d+]")
# Words before a number that say what it is, or that it is none of these.
_PHONE_CUE = re.compile(r"(?:tel(?:efone|éfono)?|fone|phone|cel(?:ular)?|whats ?app|zap|call|ligar|ligue|m[oó]vil|mobile|contato|fax)\b[^\d]{0,12}$", re.I)
_DOC_CUE = re.compile(r"(?:cpf(?:\s*/\s*mf)?|doc(?:umento)?|portador)\b[^\d]{0,12}$", re.I)
_OTHER_CUE = re.compile(
    r"(?:protocolo|pedido|lote|nota(?: fiscal)?|nf-?e?|c[oó]digo|cnpj|vers[aã]o|host|fatura|invoice|order|ramal|ext(?:ension)?\.?|batch|lot|r\$|us\$|matr[ií]cula|chamado|ticket|processo|contrato|cep|rg|identidade|pis|nis|pasep|rut|ssn|prazo|item)\b[\s:#nº°.\-]{0,6}$", re.I
)
_PARTICLES = frozenset("da de do das dos del e la los".split()) - {"e"}
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_PERSON_CUE = re.compile(
    r"(?i:(?<!\w)(?:sr|sra|dr|dra|mr|mrs|ms|dona)\.?|\b(?:titular|cliente|client|nome|nombre|name|assinado por|signed by|firmado por|em nome de|on behalf of|en nombre de|falar com|a pessoa é|ficha de|cadastro|dados))\s*:?\s+"
    r"((?:[A-ZÀ-Ý]\.\s+)?[A-ZÀ-Ý][\w\-]+(?:\s+(?:d[aeo]s?\s+)?[A-ZÀ-Ý][\w\-]+){0,4})"
)
_NO_PERSON = frozenset(
    "projeto sala comite relatorio sistema modelo filial banco clinica grupo seguros metalurgica varejo cooperativa empresa companhia departamento diretoria equipe gerencia setor area rua avenida praca alameda rodovia".split()
)


def fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def valid_cpf(digits: str) -> bool:
    if len(digits) != 11 or len(set(digits)) == 1:
        return False
    d = [int(c) for c in digits]
    for n in (9, 10):
        r = sum(x * w for x, w in zip(d, range(n + 1, 1, -1))) * 10 % 11 % 10
        if r != d[n]:
            return False
    return True


@dataclass(frozen=True)
class Lexicon:
    """Folded given names and family names."""

    given: frozenset[str] = field(default_factory=frozenset)
    family: frozenset[str] = field(default_factory=frozenset)

    @staticmethod
    def words(people: DataFrame, column: str = "nome") -> DataFrame:
        """w (folded), given, family: every word of the personal names in a table of staff.

        Only the shape of personal names counts: two or more capitalised words, with particles, without digits.
        """
        shape = r"^\p{Lu}[\p{L}'’\-]+(\s+(d[aeo]s?|del|\p{Lu}[\p{L}'’\-]+))*\s+\p{Lu}[\p{L}'’\-]+$"

        @F.pandas_udf("string")
        def folded(w: pd.Series) -> pd.Series:
            return w.map(fold)

        words = people.where(F.col(column).rlike(shape)).select(F.posexplode(F.split(F.col(column), r"\s+")).alias("i", "w")).where(~F.lower("w").isin(*_PARTICLES))
        words = words.groupBy("w").agg(F.bool_or(F.col("i") == 0).alias("given"), F.bool_or(F.col("i") > 0).alias("family"))
        return words.groupBy(folded("w").alias("w")).agg(F.bool_or("given").alias("given"), F.bool_or("family").alias("family"))

    @staticmethod
    def of(rows) -> Lexicon:
        """rows: (w, given, family)."""
        return Lexicon(frozenset(r[0] for r in rows if r[1]), frozenset(r[0] for r in rows if r[2]))

    @staticmethod
    def fit(people: DataFrame, column: str = "nome", most: int = 50_000) -> Lexicon | DataFrame:
        """The lexicon itself if it has no more than `most` words, to be handed to all tasks; else its table, from which each text is given the words it needs by a join. No word is left out."""
        table = Lexicon.words(people, column)
        rows = table.limit(most + 1).collect()
        return Lexicon.of(rows) if len(rows) <= most else table


def _with_words(df: DataFrame, table: DataFrame, fields: list[str]) -> DataFrame:
    """Adds _lex (array<struct<w, given, family>>): the words of the table that occur in the fields. Equal texts are looked up once."""

    @F.pandas_udf("array<string>")
    def words_of(texts: pd.Series) -> pd.Series:
        def one(t):
            if not t:
                return []
            plain = Plain(t).text
            return list({fold(w) for w in _WORD.findall(plain)} | {fold(w.translate(_AS_LETTERS)) for w in _LEET.findall(plain)})

        return texts.map(one)

    text = F.concat_ws("\n", *fields)
    keyed = df.withColumn("_k", F.sha2(text, 256))
    each = keyed.groupBy("_k").agg(F.first(text).alias("t")).select("_k", F.explode(words_of("t")).alias("w"))
    own = each.join(table, "w").groupBy("_k").agg(F.collect_list(F.struct("w", "given", "family")).alias("_lex"))
    return keyed.join(own, "_k", "left").drop("_k")


def _emails(t: str) -> Iterator[tuple[int, int]]:
    for m in _EMAIL.finditer(t):
        if not _FILE.search(m[0]):
            yield m.span()


def _streets(t: str, family: frozenset[str]) -> Iterator[tuple[int, int]]:
    for p in (_STREET, _STREET_LOWER):
        at = 0
        while m := p.search(t, at):
            # "R. Surname, 12 ..." is an initial and a surname, not a street
            if m[0][:2] in ("R.", "r.") and (w := _WORD.findall(m[0][2:])) and len(w) == 1 and fold(w[0]) in family:
                at = m.start() + 2
                continue
            tail = _STREET_TAIL.match(t, m.end())
            at = tail.end() if tail else m.end()
            yield m.start(), at


def _undisguised(t: str, lex: Lexicon) -> str:
    """The text with digits that stand for letters in names put right; of the same length."""
    def one(m: re.Match) -> str:
        w = m[0].translate(_AS_LETTERS)
        return w if fold(w) in lex.given or fold(w) in lex.family else m[0]

    return _LEET.sub(one, t)


def _names(t: str, lex: Lexicon, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    if _LEET.search(t):
        t = _undisguised(t, lex)
    words = [(m.start(), m.end()) for m in _WORD.finditer(t)]
    folded = [_FOLDED(t[a:b]) for a, b in words]
    given, family = lex.given, lex.family
    if not any(f in given or f in family for f in folded):
        return
    n, i = len(words), 0
    free = lambda a, b: not any(x < b and a < y for x, y in taken)
    gap = lambda k: t[words[k][1] : words[k + 1][0]] if k + 1 < n else "\n"

    def run(k: int, kinds) -> int:
        """The last word of the longest run of names after word k, joined by blanks and particles."""
        while True:
            j = k
            while gap(j) != "" and gap(j).isspace() and gap(j) != "\n" and j + 1 < n and folded[j + 1] in _PARTICLES:
                j += 1
            if j + 1 < n and gap(j).strip(" \t\xa0") == "" and gap(j) and folded[j + 1] in kinds:
                k = j + 1
            else:
                return k

    both = given | family
    while i < n:
        f, (a, _) = folded[i], words[i]
        end = -1
        if f in given:
            last = run(i, both)
            if last > i:
                end = last
        elif f in family:
            last = run(i, family)
            if gap(last) in (", ", ",") and last + 1 < n and folded[last + 1] in given:
                end = run(last + 1, family)
        elif len(f) == 1 and i + 1 < n and gap(i) in (". ", "."):
            j = i
            while j + 1 < n and folded[j + 1] in _PARTICLES and (j == i or gap(j).isspace()):
                j += 1
            if j + 1 < n and folded[j + 1] in family and (j == i or gap(j).isspace()):
                end = run(j + 1, family)
        if end >= 0 and free(a, words[end][1]):
            yield a, words[end][1]
            i = end + 1
        else:
            i += 1


class _Folds(dict):
    def __missing__(self, w: str) -> str:
        if len(self) > 200_000:
            self.clear()
        self[w] = out = fold(w)
        return out


_FOLDS = _Folds()


def _FOLDED(w: str) -> str:
    return _FOLDS[w]


def detect(source: str, lex: Lexicon) -> list[tuple[str, int, int]]:
    """(tipo, begin, end) in the source, in order; begin is the place of the value's first letter, digit or plus sign."""
    if not source:
        return []
    plain = Plain(source)
    t = plain.text
    out: list[tuple[str, int, int]] = []
    taken: list[tuple[int, int]] = []
    free = lambda a, b: not any(x < b and a < y for x, y in taken)

    def add(kind: str, a: int, b: int) -> None:
        taken.append((a, b))
        out.append((kind, *plain.span(a, b)))

    if "@" in t:
        for a, b in _emails(t):
            if free(a, b):
                add("email", a, b)
    digits_in = sum(map(t.count, "0123456789"))
    if digits_in:
        low = t.lower()
        if any(h in low for h in _STREET_HINTS):
            for a, b in _streets(t, lex.family):
                if free(a, b):
                    add("endereco", a, b)
        for m in _CUED.finditer(t) if digits_in >= 5 and any(h in low for h in _CUED_HINTS) else ():
            a, v = m.start("v"), m["v"].rstrip(" .-/")
            if 5 <= sum(c.isdigit() for c in v) <= 12 and free(a, a + len(v)):
                a += len(v) - len(v.lstrip(" -"))
                add("documento", a, m.start("v") + len(v))
        numbers: list[tuple[int, int, str]] = []
        for m in _CPF.finditer(t) if digits_in >= 11 else ():
            digits = re.sub(r"\D", "", m[0])
            if not free(*m.span()):
                continue
            before = t[max(0, m.start() - 24) : m.start()]
            if _DOC_CUE.search(before) or len(digits) == len(m[0]) and not _PHONE_CUE.search(before) or len(digits) < len(m[0]):
                if valid_cpf(digits) and not _OTHER_CUE.search(before):
                    numbers.append((*m.span(), "documento"))
                elif _DOC_CUE.search(before):
                    taken.append(m.span())
        for a, b, kind in numbers:
            add(kind, a, b)
        for m in _PHONE.finditer(t) if digits_in >= 8 else ():
            a, b = m.span()
            digits = sum(c.isdigit() for c in m[0])
            if not free(a, b) or not 8 <= digits <= 15 or m["i"] and digits < 10:
                continue
            before = t[max(0, a - 24) : a]
            if _OTHER_CUE.search(before) or _DOC_CUE.search(before) and not m["i"]:
                continue
            start = a + _PHONE_START.search(m[0]).start()
            add("telefone", start, b)
    for a, b in _names(t, lex, taken):
        add("nome", a, b)
    for m in _PERSON_CUE.finditer(t):
        a, b = m.span(1)
        words = m[1].split()
        if len(words) > 1 and free(a, b) and not any(fold(w) in _NO_PERSON for w in words):
            add("nome", a, b)
    return sorted(out, key=lambda x: x[1])


def mask(source: str | None, lex: Lexicon) -> str | None:
    """The same text with placeholders for what detect() finds."""
    if not source:
        return source
    out, done = [], 0
    for kind, a, b in detect(source, lex):
        if a < done:
            continue
        if a > done and source[a - 1] == "(" and source.count(")", a, b) > source.count("(", a, b):
            a -= 1  # the bracket of an area code
        out += [source[done:a], PLACEHOLDER[kind]]
        done = b
    return "".join(out) + source[done:]


# ---- over tables


_LEX_TYPE = "array<struct<w:string,given:boolean,family:boolean>>"


def _prepared(df: DataFrame, lex: Lexicon | DataFrame, fields: list[str]) -> tuple[DataFrame, Lexicon | None]:
    """The table with a column _lex, null where one lexicon serves all rows."""
    if isinstance(lex, Lexicon):
        return df.withColumn("_lex", F.lit(None).cast(_LEX_TYPE)), lex
    return _with_words(df, lex, fields), None


def _own(words) -> Lexicon:
    return Lexicon.of([(x["w"], x["given"], x["family"]) for x in words] if words is not None else [])


def found(df: DataFrame, lex: Lexicon | DataFrame, key: str, fields: list[str]) -> DataFrame:
    """chave, campo, tipo, inicio (1-based): each occurrence once, however often a row was delivered."""
    src, shared = _prepared(df.select(F.col(key).cast("string").alias("chave"), *fields).where("chave is not null"), lex, fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for f in fields:
                if shared is None:
                    rows += [(k, f, kind, a + 1) for k, t, w in zip(pdf["chave"], pdf[f], pdf["_lex"]) if t for kind, a, _ in detect(t, _own(w))]
                    continue
                codes, texts = pd.factorize(pdf[f], use_na_sentinel=True)
                hits = [[(k, a + 1) for k, a, _ in detect(t, shared)] for t in texts]
                some = {i for i, h in enumerate(hits) if h}
                rows += [(k, f, kind, a) for k, c in zip(pdf["chave"], codes) if c in some for kind, a in hits[c]]
            yield pd.DataFrame(rows, columns=["chave", "campo", "tipo", "inicio"])

    return src.mapInPandas(run, "chave string, campo string, tipo string, inicio int").distinct()


def masked(df: DataFrame, lex: Lexicon | DataFrame, fields: list[str]) -> DataFrame:
    """The same rows and columns, with placeholders in the fields."""
    had = df.columns
    out, shared = _prepared(df, lex, fields)
    for f in fields:

        @F.pandas_udf("string")
        def one(texts: pd.Series, words: pd.Series) -> pd.Series:
            if shared is None:
                return pd.Series([mask(t, _own(w)) for t, w in zip(texts, words)], dtype=object)
            codes, distinct = pd.factorize(texts, use_na_sentinel=True)
            done = [mask(t, shared) for t in distinct]
            return pd.Series([None if c < 0 else done[c] for c in codes], dtype=object)

        out = out.withColumn(f, one(F.col(f), F.col("_lex")))
    return out.select(*had)
