"""Secrets in texts: patterns, and strings whose characters are too evenly mixed to be words.

Candidate strings are cut into character classes (hexadecimal, base 64). A window slides over each; the counts
of its characters change by one that comes and one that goes, and so does the sum from which the Shannon
entropy follows. A string is reported where any window reaches the bound of its class, unless an
allow list names what it looks like.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.llm.common import whole_text
from trialstats.llm.spans import counted, empty, in_order, spans, written

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

WINDOW = 20
# Class: candidate strings, its characters, least bits per character in a window of 20 (at most log2 20 = 4.32).
CLASSES = {
    "hex_entropy": (r"(?<![A-Za-z0-9+/_-])[0-9A-Fa-f]{20,}+(?![A-Za-z0-9+/_-])", "0123456789abcdef", 3.0),
    "base64_entropy": (
        r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-",
        3.8,
    ),
}
# Looks random, but is public: digits only, paths and words joined by hyphens, one letter case without digits, UUIDs.
ALLOWED = (
    r"^[0-9]+$",
    r"^[A-Za-z]+([/_-]+[A-Za-z]+)+$",
    r"^[A-Z]?[a-z]+$",
    r"^[A-Z]+$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
)


def _weight(count: Column) -> Column:
    """``c * log2(c)``, 0 for none."""
    return F.when(count > 0, count * F.log2(count)).otherwise(0.0)


def peak_entropy(string: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits per character, of any ``window`` characters of ``string`` that are in ``alphabet``.

    The state is a count per character and the sum of ``c * log2(c)``; a step adds one character, takes
    the one that leaves the window, and corrects the sum by what the two counts changed.
    """
    chars = F.transform(F.split(string, ""), lambda c: F.instr(F.lit(alphabet), c))
    size = len(alphabet)
    start = F.struct(
        F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("peak"), chars.alias("chars")
    )

    def step(acc: Column, i: Column) -> Column:
        comes = F.element_at(acc["chars"], i)
        goes = F.when(i > window, F.element_at(acc["chars"], F.greatest(i - window, F.lit(1)))).otherwise(0)
        out = F.when(goes > 0, F.element_at(acc["counts"], F.greatest(goes, F.lit(1)))).otherwise(0)
        here = F.when(comes > 0, F.element_at(acc["counts"], F.greatest(comes, F.lit(1))) - F.when(comes == goes, 1).otherwise(0)).otherwise(0)
        total = acc["sum"] - _weight(out) + _weight(out - 1) - _weight(here) + F.when(comes > 0, _weight(here + 1)).otherwise(0.0)
        counts = F.transform(
            acc["counts"],
            lambda n, k: n + F.when(k + 1 == comes, 1).otherwise(0) - F.when(k + 1 == goes, 1).otherwise(0),
        )
        entropy = F.lit(math.log2(window)) - total / window
        return F.struct(
            counts.alias("counts"), total.alias("sum"), F.when(i >= window, F.greatest(acc["peak"], entropy)).otherwise(acc["peak"]).alias("peak"), acc["chars"].alias("chars")
        )

    return F.aggregate(F.sequence(F.lit(1), F.char_length(string)), start, step, lambda acc: acc["peak"])


def _suspicious(pattern: str, alphabet: str, bound: float):
    def keep(match: Column) -> Column:
        allowed = F.lit(False)
        for rule in ALLOWED:
            allowed = allowed | F.rlike(match, F.lit(rule))
        string = F.lower(match) if alphabet.islower() or alphabet == CLASSES["hex_entropy"][1] else match
        # The allow list comes first: it is cheap, and what it names is not measured.
        return F.when(allowed | (F.char_length(match) < WINDOW), False).otherwise(peak_entropy(string, alphabet) >= bound)

    return keep


def base_spans(text: Column) -> list[Column]:
    long_enough = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    return [
        spans(text, ASSIGN, "assign", 0, long_enough),
        # Every run of its class is matched whole, so the length can be asked for in the pattern.
        spans(text, ACCESS, "access", 1),
        spans(text, HEX, "hex", 2),
    ]


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, base, added``, arrays of ``start, rank, end, kind, match`` by start.

    ``base`` are the pattern matches, ``added`` strings found by entropy that do not lie within one of them. A
    null text is empty; empty texts and tables give no spans. No shuffle: a text is worked on where it
    lies.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("_text"))
    parts = base_spans(F.col("_text"))
    for rank, (kind, (pattern, alphabet, bound)) in enumerate(CLASSES.items(), len(parts)):
        parts.append(spans(F.col("_text"), pattern, kind, rank, _suspicious(pattern, alphabet, bound)))
    rows = rows.select("doc_id", in_order(*parts[:3]).alias("base"), F.concat(*parts[3:]).alias("_more"))
    new = F.filter("_more", lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    # One string may look random in both classes; it is reported once, as the narrower one.
    new = F.filter(new, lambda s: ~((s["kind"] == "base64_entropy") & F.exists("_more", lambda o: (o["rank"] < s["rank"]) & (o["start"] == s["start"]) & (o["end"] == s["end"]))))
    return rows.select("doc_id", "base", F.array_sort(F.when(F.size("_more") > 0, new).otherwise(empty())).alias("added"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``doc_id`` and the text with the base patterns replaced by ``mark``."""
    text = whole_text(text_col)
    assigned = F.regexp_replace(text, F.lit(ASSIGN.replace("]+)", "]{6,})")), F.lit("$1=" + mark))
    hidden = F.regexp_replace(F.regexp_replace(assigned, F.lit(ACCESS), F.lit(mark)), F.lit(HEX), F.lit(mark))
    return docs.select(F.col(id_col).alias("doc_id"), hidden.alias("text"))


def report(found: DataFrame, kinds: tuple[str, ...] = ("assign", "access", "hex")) -> DataFrame:
    """Counts per kind, the digest of the base spans, and all spans as text."""
    return found.select(
        "doc_id",
        *[counted(F.col("base"), k).alias(f"n_{k}") for k in kinds],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(in_order(F.col("base"), F.col("added"))).alias("spans"),
        F.size("added").cast("bigint").alias("n_added"),
    )
