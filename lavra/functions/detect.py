"""Detectors of sensitive content on the capture side, and their masks, as native expressions.

Numbers are not looked for by one pattern a kind. A text is cut into runs of digits with single
separators; what a run is follows from its number of digits, the separators in it and its check digits.
Identifiers made of letters and digits (keys, accounts, bank codes) have patterns made from the public
descriptions of their formats.

Edge cases: null and empty texts hold nothing; the same value twice counts twice; a number with wrong
check digits is none of the validated kinds; long texts are read whole, by patterns that don't go back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lavra.functions import validators as v

#: The kinds, in the order in which they are reported and masked.
KINDS = ("cpf", "cnpj", "cartao", "email", "telefone", "chave_pix_aleatoria", "credencial", "conta_bancaria", "iban_swift")
VALIDATED = ("cpf", "cnpj", "cartao")

_DIGITS = r"[0-9]++"
#: Runs of digits: tax numbers have dots, dashes and a slash inside, cards have blanks or dashes.
_TAX_RUN = rf"{_DIGITS}(?:[./-]{_DIGITS})*+"
_CARD_RUN = rf"{_DIGITS}(?:[ -]{_DIGITS})*+"
#: Groups of letters, digits and dashes, of which keys are made.
_WORD_RUN = r"[0-9A-Za-z]++(?:-[0-9A-Za-z]++)*+"
_ATOM = r"[A-Za-z0-9_%+-]++"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_EMAIL = rf"{_ATOM}(?:\.{_ATOM})*+@{_LABEL}(?:\.{_LABEL})+"
# an area code, then nine digits from 9 or eight from 2 to 5, alone or after the country's code
_PHONE = r"(?<![0-9A-Za-z_])(?:\+?55[ .-]?)?(?:\([1-9][0-9]\)|[1-9][0-9])[ .-]?(?:9[ .-]?[0-9]{4}|[2-5][0-9]{3})[ .-]?[0-9]{4}(?![0-9A-Za-z_])"
# formats published by the issuers, and words that introduce a secret
_SECRET = (
    r"(?:sk-[A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9]{30,}|A[KS]IA[A-Z0-9]{16}|-----BEGIN [A-Z ]*PRIVATE KEY-----"
    r"|(?i:passphrase|passw(?:or)?d|pwd|senha|segredo|secret|token|api[ _-]?key)[ ]?[:=][ ]?[^ \n]{8,})"
)
_ACCOUNT = r"(?i:ag(?:[eê]ncia|\.)?[ :]{1,2}[0-9]{3,5}(?:-[0-9X])?[ ,;/-]{1,3}(?:conta(?: corrente)?|c/?c|cta\.?)[ :]{1,2}[0-9.]{4,12}-?[0-9X])"
_IBAN = r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"
_BIC = r"[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?"
_BANK_WORD = r"(?i)(?:^|[^a-z])(?:swift|bic|iban)(?:[^a-z]|$)"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def is_cpf(run: Column) -> Column:
    """A run of eleven digits with right check digits, separated by dots and a dash or by nothing."""
    return ~F.contains(run, F.lit("/")) & v.cpf(v.digits(run))


def is_cnpj(run: Column) -> Column:
    return v.cnpj(v.digits(run))


def is_card(run: Column) -> Column:
    d = v.digits(run)
    return v.luhn(d) & ~v.cpf(d) & ~v.cnpj(d)


def is_uuid(word: Column) -> Column:
    """Hexadecimal groups of 8, 4, 4, 4 and 12."""
    sizes = F.transform(F.split(word, "-"), lambda g: F.length(g))
    return (sizes == F.array(*[F.lit(n) for n in (8, 4, 4, 4, 12)])) & (F.translate(F.lower(word), "0123456789abcdef-", "") == "")


def matches(text: Column, kind: str) -> Column:
    """All values of a kind; those with check digits only if they are right."""
    if kind in ("cpf", "cnpj"):
        return F.filter(_all(text, _TAX_RUN), is_cpf if kind == "cpf" else is_cnpj)
    if kind == "cartao":
        # numbers side by side make one run: where it is no card as a whole, its groups are looked at
        apart = lambda r: F.when(is_card(r), F.array(r)).otherwise(F.filter(F.split(r, " "), is_card))
        return F.flatten(F.transform(_all(text, _CARD_RUN), apart))
    if kind == "chave_pix_aleatoria":
        return F.filter(_all(text, _WORD_RUN), is_uuid)
    if kind == "iban_swift":
        # short codes are too common to count where nobody speaks of banks
        codes = F.filter(_all(text, r"[A-Z0-9]++"), lambda w: w.rlike(f"^(?:{_IBAN}|{_BIC})$"))
        return F.when(F.coalesce(text.rlike(_BANK_WORD), F.lit(False)), codes).otherwise(F.array().cast("array<string>"))
    return _all(text, {"email": _EMAIL, "telefone": _PHONE, "credencial": _SECRET, "conta_bancaria": _ACCOUNT}[kind])


def detect(text: Column) -> Column:
    """array<struct<tipo, contagem, validado>> of the kinds that occur, in the order of KINDS."""
    one = [F.struct(F.lit(k).alias("tipo"), F.size(matches(text, k)).alias("contagem"), F.lit(k in VALIDATED).alias("validado")) for k in KINDS]
    return F.filter(F.array(*one), lambda x: x["contagem"] > 0)


#: Kinds that identify a person.
PERSONAL = ("cpf", "cartao", "email", "telefone", "conta_bancaria")


def personal_total(found: Column) -> Column:
    """How many values of the personal kinds there are."""
    mine = F.filter(found, lambda x: x["tipo"].isin(*PERSONAL))
    return F.aggregate(mine, F.lit(0), lambda a, x: a + x["contagem"])


# Kind of information and sensitivity by what was detected, first match wins.
CLASSES = (
    (("credencial",), "Chave/API secret", "Crítica"),
    (("cartao",), "Dado financeiro (cartão)", "Crítica"),
    (("cpf",), "Dado pessoal (CPF)", "Crítica"),
    (("conta_bancaria",), "Dado bancário", "Crítica"),
    (("cnpj",), "Dado cadastral (CNPJ)", "Confidencial"),
    (("chave_pix_aleatoria",), "Chave Pix", "Confidencial"),
    (("email", "telefone"), "Dado de contato", "Interna"),
)


def classify(found: Column) -> Column:
    """struct<tipo, sens> by what was detected."""
    named = lambda kind, sens: F.struct(F.lit(kind).alias("tipo"), F.lit(sens).alias("sens"))
    out = named("Conteúdo não classificado", "Interna")
    types = F.transform(found, lambda x: x["tipo"])
    for kinds, kind, sens in reversed(CLASSES):
        out = F.when(F.arrays_overlap(types, F.array(*[F.lit(k) for k in kinds])), named(kind, sens)).otherwise(out)
    return out


# ---- masks: a text is cut into runs of digits and what lies between, and each run is replaced or kept


def _replace_runs(text: Column, run: str, how) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(rf"{run}|[^0-9]++"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[0-9]"), how(p)).otherwise(p)), "")


def publish(text: Column) -> Column:
    """The mask applied before content is published: tax numbers and cards by their length, any other block of six digits or more; unvalidated."""

    def how(run: Column) -> Column:
        n = F.length(v.digits(run))
        tax = F.when(~F.contains(run, F.lit("/")) & (n == 11), "[CPF]").when(n == 14, "[CNPJ]")
        return F.coalesce(tax, F.when((n >= 13) & (n <= 16), "[cartão]"), F.regexp_replace(run, "[0-9]{6,}", "[número]"))

    out = _replace_runs(text, _TAX_RUN, how)
    # cards are written with blanks too
    return _replace_runs(out, _CARD_RUN, lambda r: F.when(F.length(v.digits(r)).between(13, 16), "[cartão]").otherwise(r))


# What stands for a masked value.
MASKS = {
    "cpf": "[CPF-MASCARADO]", "cnpj": "[CNPJ-MASCARADO]", "cartao": "[CARTAO-MASCARADO]", "email": "[EMAIL-MASCARADO]",
    "telefone": "[TELEFONE-MASCARADO]", "chave_pix_aleatoria": "[CHAVE-PIX-MASCARADA]", "credencial": "[CREDENCIAL-REMOVIDA]", "conta_bancaria": "[CONTA-MASCARADA]",
}


def mask(text: Column) -> Column:
    """struct<texto, n>: valid CPFs and cards, CNPJs by their form, and the other kinds but bank codes replaced; n replacements.

    Secrets, mail addresses and keys go first, so that no digit run inside them is taken for a number.
    """
    out = text
    for kind, pattern in (("credencial", _SECRET), ("email", _EMAIL), ("conta_bancaria", _ACCOUNT)):
        out = F.regexp_replace(out, pattern, MASKS[kind])
    words = F.regexp_extract_all(out, F.lit(rf"{_WORD_RUN}|[^0-9A-Za-z]++"), F.lit(0))
    out = F.array_join(F.transform(words, lambda w: F.when(is_uuid(w), MASKS["chave_pix_aleatoria"]).otherwise(w)), "")
    tax = lambda r: F.when(is_cpf(r), MASKS["cpf"]).when(F.length(v.digits(r)) == 14, MASKS["cnpj"]).otherwise(r)
    out = _replace_runs(out, _TAX_RUN, tax)
    out = _replace_runs(out, _CARD_RUN, lambda r: F.when(v.luhn(v.digits(r)), MASKS["cartao"]).otherwise(r))
    out = F.regexp_replace(out, _PHONE, MASKS["telefone"])
    marks = "|".join(m.strip("[]") for m in MASKS.values())
    count = lambda c: F.regexp_count(c, F.lit(rf"\[(?:{marks})\]"))
    return F.struct(out.alias("texto"), (count(out) - count(text)).alias("n"))
