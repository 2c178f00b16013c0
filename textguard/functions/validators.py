"""Checks applied to single matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.functions.dialect import java_regex
from textguard.rules.injection import BASE64_KEYWORDS
from textguard.rules.pii import PRIVATE_IP

_NOT_DIGIT = java_regex(r"\D")
_SEPARATOR = java_regex(r"[\s-]")


def luhn(col: Column) -> Column:
    """At least 13 digits whose Luhn sum is a multiple of ten."""
    digits = F.regexp_replace(col, _NOT_DIGIT, "")
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))

    def doubled(d, i):
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = F.aggregate(F.transform(values, doubled), F.lit(0), lambda a, x: a + x)
    return (F.length(digits) >= 13) & (total % 10 == 0)


def aadhaar(col: Column) -> Column:
    """Twelve digits after removing separators, the first not zero."""
    digits = F.regexp_replace(col, _SEPARATOR, "")
    return digits.rlike(r"^\p{Nd}{12}$") & ~digits.startswith("0")


def abha(col: Column) -> Column:
    return F.length(F.regexp_replace(col, _SEPARATOR, "")) == 14


def public_ip(col: Column) -> Column:
    return ~col.rlike(java_regex(PRIVATE_IP))


def base64_payload(col: Column) -> Column:
    """The decoded run mentions one of the payload words."""
    raw = F.try_to_binary(F.rtrim(col, F.lit("=")), F.lit("base64"))
    text = F.lower(F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit("")))
    found = F.lit(False)
    for word in BASE64_KEYWORDS:
        found = found | F.contains(text, F.lit(word))
    return F.coalesce(found, F.lit(False))


VALIDATORS = {
    "luhn": luhn,
    "aadhaar": aadhaar,
    "abha": abha,
    "public_ip": public_ip,
    "base64": base64_payload,
}


def value_hash(col: Column, digits: int = 16) -> Column:
    """One-way hash of a value, shortened for logs."""
    return F.substring(F.sha2(col.cast("binary"), 256), 1, digits)
