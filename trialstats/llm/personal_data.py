"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.llm.common import whole_text
from trialstats.llm.spans import counted, in_order, spans, written

# A run is tried once, where it begins or where the last match ended; possessive, so no run is read twice.
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# A whole run of digits with single separators, of 14 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
# Characters of an account number, by country, as the register of IBANs has them.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}


def _of_length(n: int, countries: str) -> str:
    tail = rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else ""
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{n // 4 - 1}}}{tail}"


# What follows a number of its country's length is no part of it, even where it could be read on.
NATIONAL_IBAN = rf"(?<![A-Za-z0-9])(?:{'|'.join(_of_length(n, c) for n, c in LENGTHS.items())})(?![A-Za-z0-9])"

# Words that speak for a kind when they stand near it, in the languages of the corpus.
CONTEXT = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "telefon", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
}
# What a confirmed span of a kind is worth by itself, and what a word nearby adds.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
NEARBY = 0.1
REACH = 40


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Does a string of digits pass Luhn's check: every second digit from the right doubled, 9 taken off above 9."""
    places = F.transform(F.split(F.reverse(number), ""), lambda c: c.cast("int"))
    worth = F.transform(places, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def mod_97(iban: Column) -> Column:
    """Does an account number pass ISO 7064 mod 97-10, its first four characters moved to the end and letters as 10 to 35."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    values = F.transform(F.split(turned, ""), lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1)
    rest = F.aggregate(F.filter(values, lambda v: v >= 0), F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97)
    return rest == 1


def small_parts(ip: Column) -> Column:
    """Is every part at most 255, whatever zeros lead it."""
    parts = F.transform(F.split(ip, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.char_length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))


def ibans(text: Column) -> Column:
    """Numbers of their country's length, and others that pass mod 97 and overlap none of these."""
    national = spans(text, NATIONAL_IBAN, "iban", 4, mod_97)
    other = spans(text, IBAN, "iban", 4, mod_97)
    apart = F.filter(other, lambda o: ~F.exists(national, lambda n: (n["start"] < o["end"]) & (o["start"] < n["end"])))
    return F.concat(national, apart)


def proposals(text: Column) -> list[Column]:
    return [
        spans(text, EMAIL, "email", 0),
        spans(text, IP, "ip", 1, small_parts),
        spans(text, CARD, "card", 2, lambda m: luhn(digits(m))),
        spans(text, PHONE, "phone", 3, lambda m: F.char_length(digits(m)).between(10, 15)),
        ibans(text),
    ]


def score(text: Column, span: Column) -> Column:
    """The score of a confirmed span: its kind's, more where a context word stands within ``REACH`` characters before it."""
    start = span["start"]
    before = F.lower(F.substring(text, F.greatest(start - (REACH - 1), F.lit(1)), F.least(start, F.lit(REACH))))
    out = F.lit(0.0)
    for kind, worth in SCORES.items():
        near = F.rlike(before, F.lit(r"\b(" + "|".join(CONTEXT[kind]) + r")\b"))
        out = F.when(span["kind"] == kind, F.lit(worth) + F.when(near, NEARBY).otherwise(0.0)).otherwise(out)
    return out


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, found, scores``; ``found`` is an array of ``start, rank, end, kind, match``.

    Kinds are email, ip, card, phone and, by mod 97, iban. ``scores`` stand in the order of the spans; no span is
    dropped for its score. A null text is empty; empty texts and tables give no spans. No shuffle: a text
    is worked on where it lies.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("_text"))
    rows = rows.select("doc_id", "_text", in_order(*proposals(F.col("_text"))).alias("found"))
    return rows.select("doc_id", "found", F.transform("found", lambda s: score(F.col("_text"), s)).alias("scores"))


def report(found: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the four base kinds, all spans as text, and the mean score."""
    base = F.filter("found", lambda s: s["kind"] != "iban")
    mean = F.aggregate("scores", F.lit(0.0), lambda a, s: a + s) / F.size("scores")
    return found.select(
        "doc_id",
        *[counted(F.col("found"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone", "iban")],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
        F.when(F.size("scores") > 0, F.round(mean, 6)).alias("mean_score"),
    )
