"""Pattern detectors: a text's candidates for each type, in a fixed order of types."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright import vocab as V
from maskwright.functions import text as T


def _candidates(text: Column, pattern: str, kind: str, confidence: float, keep: Callable[[Column], Column] | None = None, flags: str = "U") -> Column:
    found = F.transform(T.scan(text, pattern, flags), lambda s: T.entity(T.part(text, s["start"], s["end"]), kind, s["start"], s["end"], confidence, "regex"))
    return F.filter(found, lambda e: keep(e["text"])) if keep else found


def emails(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("@")), _candidates(text, V.EMAIL, "EMAIL", V.PATTERN_HIGH)).otherwise(T.no_entities())


def _numbers(text: Column, least: str, pattern: str, kind: str, confidence: float, keep=None, flags: str = "U") -> Column:
    """Only texts in which the cheaper pattern finds something are scanned."""
    return F.when(text.rlike(least), _candidates(text, pattern, kind, confidence, keep, flags)).otherwise(T.no_entities())


def phones(text: Column) -> Column:
    return _numbers(text, r"(?U)\d{3}", V.PHONE, "PHONE", V.PATTERN_MEDIUM, lambda m: F.length(F.regexp_replace(m, r"(?U)\D", "")) >= 10)


def social_security_numbers(text: Column) -> Column:
    return _numbers(text, r"(?U)\d{3}-\d", V.SSN, "SSN", V.PATTERN_HIGH)


def credit_cards(text: Column) -> Column:
    return _numbers(text, r"(?U)\d(?:[ -]*\d){12}", V.CREDIT_CARD, "CREDIT_CARD", V.PATTERN_HIGH, lambda m: T.luhn(F.regexp_replace(m, "[ -]", "")))


def ip_addresses(text: Column) -> Column:
    return _numbers(text, r"[0-9]\.[0-9]+\.[0-9]", V.IP_ADDRESS, "IP_ADDRESS", V.PATTERN_HIGH)


def dates(text: Column) -> Column:
    return _numbers(text, r"(?U)\d\d", V.DATE, "DATE", V.PATTERN_MEDIUM, flags="Ui")


def aadhaar_numbers(text: Column) -> Column:
    return _numbers(text, r"(?U)\d{4}", V.AADHAAR, "AADHAAR", V.PATTERN_MEDIUM, lambda m: F.length(F.regexp_replace(m, r"(?U)[-\s]", "")) == 12)


def director_numbers(text: Column) -> Column:
    return _numbers(text, r"(?U)\d{8}", V.DIN, "DIN", V.PATTERN_MEDIUM)


#: In the order in which candidates come; dates are always looked for, as context makes birth dates of them.
DETECTORS: dict[str, Callable[[Column], Column]] = {
    "EMAIL": emails, "PHONE": phones, "SSN": social_security_numbers, "CREDIT_CARD": credit_cards, "IP_ADDRESS": ip_addresses, "DATE": dates, "AADHAAR": aadhaar_numbers, "DIN": director_numbers,
}


def detect(text: Column, enabled: Collection[str] = V.ENTITY_TYPES) -> Column:
    """All pattern candidates of a text; all types but e-mail addresses need a digit, which most texts lack."""
    numbers = F.concat(*[find(text) for kind, find in DETECTORS.items() if kind != "EMAIL" and (kind == "DATE" or kind in enabled)])
    numbers = F.when(text.rlike(r"(?U)\d"), numbers).otherwise(T.no_entities())
    return T.numbered(F.concat(emails(text), numbers) if "EMAIL" in enabled else numbers)
