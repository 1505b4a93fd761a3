"""Value patterns as rlike conditions, and masks for sensitive values.

Patterns match a whole string. All conditions of a scan are evaluated in one pass; `first_match` classifies single values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of the plain profile, all tried (fixed values).
PROFILE = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^[\+]?[(]?[0-9]{3}[)]?[-\s\.]?[0-9]{3}[-\s\.]?[0-9]{4,6}$",
    "url": r"^https?://[^\s/$.?#].[^\s]*$",
    "uuid": r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "ip_address": r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$",
    "date_iso": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "credit_card": r"^(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13})$",
    "zip_code": r"^[0-9]{5}(?:-[0-9]{4})?$",
    "json": r"(?s)^[\[\{].*[\]\}]$",
    "numeric_id": r"^[0-9]+$",
    "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "mac_address": r"^([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})$",
    "slug": r"^[a-z0-9]+(?:-[a-z0-9]+)*$",
    "currency": r"^\$?[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{2})?$",
    "percentage": r"^[0-9]+(?:\.[0-9]+)?%$",
}


@dataclass(frozen=True)
class Pattern:
    """threshold: least share for medium confidence; a smaller priority wins ties."""

    name: str
    regex: str
    threshold: float
    priority: int
    sensitive: bool = False


#: Stricter patterns with thresholds and priorities (fixed values).
STRICT = (
    Pattern("email", r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", 0.8, 10, True),
    Pattern("phone", r"^[\+]?[(]?[0-9]{1,4}[)]?[-\s\./0-9]{6,}$", 0.75, 15, True),
    Pattern("url", r"(?i)^https?://[^\s/$.?#].[^\s]*$", 0.85, 20),
    Pattern("uuid", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$", 0.9, 5),
    Pattern("ip_address", r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$", 0.9, 25),
    Pattern("mac_address", r"^([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})$", 0.9, 30),
    Pattern("credit_card", r"^(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12}|(?:2131|1800|35[0-9]{3})[0-9]{11})$", 0.95, 1, True),
    Pattern("ssn", r"^(?!000|666|9[0-9]{2})[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", 0.95, 2, True),
    Pattern("date_iso", r"^[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])$", 0.85, 35),
    Pattern("date_us", r"^(?:0?[1-9]|1[0-2])/(?:0?[1-9]|[12][0-9]|3[01])/(?:[0-9]{2}|[0-9]{4})$", 0.8, 40),
    Pattern("date_eu", r"^(?:0?[1-9]|[12][0-9]|3[01])/(?:0?[1-9]|1[0-2])/(?:[0-9]{2}|[0-9]{4})$", 0.8, 41),
    Pattern("zip_code", r"(?i)^(?:[0-9]{5}(?:-[0-9]{4})?|[A-Z][0-9][A-Z]\s?[0-9][A-Z][0-9])$", 0.85, 50),
    Pattern("currency", r"^(?:[$€£¥]?\s*-?[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{1,2})?|-?[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{1,2})?\s*[$€£¥]?)$", 0.75, 55),
    Pattern("percentage", r"^-?[0-9]+(?:\.[0-9]+)?%$", 0.9, 60),
    Pattern("json", r"(?s)^[\[\{].*[\]\}]$", 0.8, 70),
    Pattern("slug", r"^[a-z0-9]+(?:-[a-z0-9]+)*$", 0.85, 75),
    Pattern("numeric_id", r"^[0-9]+$", 0.95, 80),
    Pattern("alphanumeric_code", r"(?i)^[A-Z0-9]{2,}(?:[-_][A-Z0-9]+)*$", 0.85, 85),
)

#: Further patterns that no scan uses unless asked (fixed values).
ADDITIONAL = {
    "ipv6": r"^(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$|^(?:[0-9a-fA-F]{1,4}:){1,7}:$|^(?:[0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}$|^::(?:ffff:)?(?:[0-9]{1,3}\.){3}[0-9]{1,3}$",
    "hex_color": r"^#?([A-Fa-f0-9]{6}|[A-Fa-f0-9]{3})$",
    "time_12h": r"^(?:0?[1-9]|1[0-2]):[0-5][0-9](?::[0-5][0-9])?\s?(?:[AaPp][Mm])$",
    "time_24h": r"^(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?$",
    "iso_datetime": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?$",
    "semantic_version": r"^v?[0-9]+\.[0-9]+\.[0-9]+(?:-[a-zA-Z0-9.]+)?(?:\+[a-zA-Z0-9.]+)?$",
    "vin": r"^[A-HJ-NPR-Z0-9]{17}$",
    "isbn_10": r"^(?:[0-9][- ]?){9}[0-9Xx]$",
    "isbn_13": r"^(?:97[89][- ]?)?(?:[0-9][- ]?){9}[0-9]$",
    "base64": r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$",
    "md5_hash": r"^[a-fA-F0-9]{32}$",
    "sha256_hash": r"^[a-fA-F0-9]{64}$",
}

BY_NAME = {p.name: p for p in STRICT}
SENSITIVE = tuple(p for p in STRICT if p.sensitive)


def register(name: str, regex: str, threshold: float = 0.8, priority: int = 100, sensitive: bool = False) -> Pattern:
    """A pattern of the caller's own, for use in the `patterns` argument of the scans."""
    return Pattern(name, regex, threshold, priority, sensitive)


def matches(value: Column, name: str) -> Column:
    """Whether a value, trimmed, matches a named pattern; null does not."""
    regex = BY_NAME[name].regex if name in BY_NAME else ADDITIONAL[name]
    return F.coalesce(F.trim(value).rlike(regex), F.lit(False))


def all_matches(value: Column, patterns: tuple[Pattern, ...] = STRICT) -> Column:
    """array<string>: names of the patterns that the trimmed value matches, by priority."""
    ordered = sorted(patterns, key=lambda p: p.priority)
    return F.array_compact(F.array(*[F.when(F.trim(value).rlike(p.regex), F.lit(p.name)) for p in ordered]))


def first_match(value: Column, patterns: tuple[Pattern, ...] = STRICT) -> Column:
    """The name of the matching pattern of smallest priority, or null."""
    return F.coalesce(*[F.when(F.trim(value).rlike(p.regex), F.lit(p.name)) for p in sorted(patterns, key=lambda p: p.priority)])


def mask(value: Column, kind: str) -> Column:
    """A sensitive value with its middle hidden; the last four characters or digits, or the mail domain, stay visible.

    Mail addresses with a one-letter or doubtful local part, short phones and other kinds stay as they are.
    """
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ssn":
        return F.concat(F.lit("***-**-"), F.right(value, F.lit(4)))
    if kind == "credit_card":
        return F.concat(F.repeat(F.lit("*"), F.greatest(F.length(value) - 4, F.lit(0))), F.right(value, F.lit(4)))
    if kind == "email":
        parts = F.split(value, "@", -1)
        good = (F.size(parts) == 2) & (F.length(F.get(parts, F.lit(0))) > 1)
        return F.when(good, F.concat(F.left(F.get(parts, F.lit(0)), F.lit(1)), F.lit("***@"), F.get(parts, F.lit(1)))).otherwise(value)
    if kind == "phone":
        return F.when(F.length(digits) >= 4, F.concat(F.lit("***-***-"), F.right(digits, F.lit(4)))).otherwise(value)
    return value
