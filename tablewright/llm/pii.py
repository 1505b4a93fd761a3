"""Personal data: base patterns plus candidate gradient boosting, in DataFrame expressions only.

Base spans (e-mail, IP, card, phone) are leftmost non-overlapping pattern matches per kind that pass a validity test.
High-recall generators propose further, overlapping spans; boosted trees over format and context features score them, and a
calibrated threshold selects. Trees are fitted on a bounded synthetic sample (`TRAIN_ROWS` snippets built from a seed), which
runs through the same expressions, and are compiled to CASE columns. Positions are code points, ends exclusive.

Spark has no match positions, so they follow from the text between matches (split) and the matches themselves. The patterns
use possessive quantifiers and look-behind where that cannot change a match: no back-tracking and no repeated scan of a long
run of characters, whatever the text's length.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import whole

KINDS = ("email", "ip", "card", "phone")

#: Base patterns, equal in their matches to
#: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+   ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#: card [0-9]([ -]?[0-9])+                                   phone \+[0-9][ ().0-9-]+[0-9]
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this cannot match.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}

#: Kinds that only the method finds: keys, tokens and passwords; national and bank account numbers.
FOUND = ("secret", "id")
ALL = KINDS + FOUND

#: High-recall generators; their spans may overlap each other and the base spans.
EXTRA = (
    ("email", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)|\[dot\]| dot )[0-9]{1,3}+){3}(?![0-9])"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){1,6}:(?:[0-9A-Fa-f]{1,4}+:){0,5}[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])"),
    ("card", r"(?<![0-9])[0-9]{13,19}+(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}+(?:[ -][0-9]{4}+){3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}+[ -][0-9]{6}+[ -][0-9]{5}+(?![0-9])"),
    ("phone", r"(?<![0-9+])(?:00|011[ -]?)[1-9][0-9 ().-]{7,20}[0-9]"),
    ("phone", r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("secret", r"(?i)(?<=[=:]|[=:][ \"']|[=:] [\"'])[A-Za-z0-9_/+.!@#$%^&*~-]{8,}+=*+"),
    ("secret", r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{20,}+=*+"),
    ("secret", r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+(?![A-Za-z0-9_.-])"),
    ("id", r"(?<![0-9-])[0-9]{3}+-[0-9]{2}+-[0-9]{4}+(?![0-9-])"),
    ("id", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
)
EXTRA_NEEDS = {
    "email": r"(?i)[(\[ ]dot[)\] ]", "ip": r"(?i)[0-9](?:\[|\(| dot)|[0-9a-f]:[0-9a-f:]{0,4}:", "card": r"[0-9]{4}",
    "phone": r"[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}|(?:00|011[ -]?)[1-9]",
    "id": r"[0-9]{3}-[0-9]{2}-|[A-Z]{2}[0-9]{2}",
}

#: What a match of each generator of secrets holds in any case; the first is only tried where a text has a telling word or a long run.
SECRET_NEEDS = (r"[=:](?: ?[\"']| )?[A-Za-z0-9_/+.!@#$%^&*~-]{8}", r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20}", r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8}")
TELLING = ("token", "secret", "passw", "pwd", "key", "auth", "bearer", "credential", "api")

#: Words that often stand before each kind of number, and words that stand before other numbers.
HINTS = {
    "email": "mail|contact|write|reach|address",
    "ip": "ip|host|server|address|addr|from|client|peer|gateway",
    "card": "card|visa|master|amex|credit|debit|pay|account|charge",
    "phone": "phone|tel|call|mobile|cell|fax|ring|dial|contact|reach",
    "secret": "token|secret|passw|pwd|key|auth|bearer|credential",
    "id": "ssn|social|iban|account|bank|tax|passport|insurance|id",
}
AGAINST = "order|invoice|isbn|serial|version|ref|ticket|part|sku|item|model|page|figure|build|no|nr|commit|checksum|sha|md5|hash|digest|path|file|url|uuid"

#: Words of the training snippets, none of them taken from the features' lists: one list to fit, another to calibrate, with words
#: of several languages, so that the threshold is not told by words that the trees have seen.
CONTEXTS = (
    {
        "email": ("mail", "e-mail", "contact", "correo", "schreiben an", "you can reach me", "email"), "ip": ("ip", "host", "server", "logged in from", "Adresse"),
        "card": ("card", "visa", "credit card", "tarjeta", "pay with", "Karte", "mastercard"), "phone": ("phone", "call", "tel", "mobile", "fax", "llamar al", "Telefon"),
        "secret": ("token", "secret", "password", "api_key", "auth", "bearer", "client_secret", "clave"), "id": ("ssn", "iban", "social security", "account", "Konto"),
        "": ("order", "invoice", "ref", "ticket", "serial", "part", "commit", "sha", "file", "hash", "version", "Rechnung", "pedido"),
    },
    {
        "email": ("mail", "write to", "courriel", "inbox of", "reply"), "ip": ("ip", "client", "connection by", "adresse"),
        "card": ("card", "debit", "carte", "charged on", "amex"), "phone": ("cell", "ring me on", "mobil", "numéro", "tel"),
        "secret": ("token", "passwd", "access_key", "SECRET", "pwd", "credentials", "mot de passe"), "id": ("iban", "tax number", "ssn", "compte", "insured as"),
        "": ("tracking", "sku", "model", "build", "checksum", "digest", "path", "chapter", "facture", "item", "md5"),
    },
)

TRAIN_ROWS = 4000
PRECISION = 0.95
CONTEXT = 24


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of ASCII digits passes the Luhn test."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: _luhn_digit(F.try_to_number(c, F.lit("9")).cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _luhn_digit(d: Column, i: Column) -> Column:
    d = F.coalesce(d, F.lit(0))
    twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    return F.when(i % 2 == 1, twice).otherwise(d)


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        # parts of any length: leading zeros go, then at most three digits may remain
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(s, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    n = F.length(_digits(s))
    if kind == "card":
        return n.between(13, 19) & F.when(n.between(13, 19), luhn(_digits(s))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _needs(text: Column, generator: int) -> Column:
    """Whether a text can hold a match of a generator."""
    kind = EXTRA[generator][0]
    if kind != "secret":
        return text.rlike(EXTRA_NEEDS[kind])
    nth = [g for g, (k, _) in enumerate(EXTRA) if k == kind].index(generator)
    can = text.rlike(SECRET_NEEDS[nth])
    if nth:
        return can
    low = F.lower(text)
    return can & (reduce(Column.__or__, [low.contains(w) for w in TELLING]) | text.rlike(SECRET_NEEDS[1]))


def _spans(text: Column, pattern: str, can: Column) -> Column:
    """array<struct<start, end, s>>: every leftmost non-overlapping match with its place; none where the text can hold none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("s"))
    none = F.expr("named_struct('at', 0L, 'out', cast(array() as array<struct<start:bigint,end:bigint,s:string>>))")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["s"])
        span = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), x["s"].alias("s"))
        return F.struct(end.cast("long").alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    # the text after the last match has no partner and goes first
    pairs = F.filter(pairs, lambda x: x["s"].isNotNull())
    spans = F.aggregate(pairs, none, step, lambda acc: acc["out"])
    return F.when(can, spans).otherwise(F.expr("cast(array() as array<struct<start:bigint,end:bigint,s:string>>)"))


def _features(kind: str, generator: int, text: Column, span: Column) -> list[Column]:
    s, start = span["s"], span["start"].cast("int")
    before = F.lower(F.substring(text, F.greatest(start - CONTEXT + 1, F.lit(1)), F.least(start, F.lit(CONTEXT))))
    after = F.substring(text, span["end"].cast("int") + 1, 2)
    digits = _digits(s)
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    count = lambda of: F.length(F.regexp_replace(s, f"[^{of}]", "")).cast("double")
    return [
        F.lit(float(generator)),
        F.length(s).cast("double"),
        F.length(digits).cast("double"),
        F.size(F.array_distinct(F.split(s, ""))).cast("double"),
        flag(luhn(digits)) if kind == "card" else F.lit(0.0),
        flag(s.rlike("[()\\[\\]]")),
        count(" ._:/-"),
        flag(before.rlike(HINTS[kind])),
        flag(before.rlike(rf"(?:^|[^a-z])(?:{AGAINST})[^a-z]{{0,4}}$")),
        flag(before.rlike(r"[a-z0-9#$/=_-]$")),
        flag(after.rlike(r"^[A-Za-z0-9_/=-]|^[.,:][0-9]")),
        flag(digits.rlike("^[345]") if kind == "card" else digits.rlike("^[2-9]|^00|^011")),
        count("aeiouAEIOU"),
        count("A-Z"),
        F.size(F.regexp_extract_all(s, F.lit("[A-Za-z][0-9]"), F.lit(0))).cast("double"),
        flag(before.rlike(r"[=:][ \"']{0,2}$")),
    ]


N_FEATURES = 16


@dataclass(frozen=True)
class SpanModel:
    """Boosted trees and, from held-out snippets, the calibrated score (slope, offset) and threshold."""

    start: float
    trees: tuple[boosting.Node, ...]
    slope: float
    offset: float
    threshold: float

    def probability(self, features: list[Column]) -> Column:
        z = F.lit(self.start)
        for t in self.trees:
            z = z + boosting.column(t, features)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(z * self.slope + self.offset)))

    def selects(self, features: list[Column]) -> Column:
        return self.probability(features) >= self.threshold


def _snippets(rows: int, seed: int, contexts: dict[str, tuple[str, ...]]) -> list[tuple[str, str, int]]:
    """(text, kind, is personal): contexts and formats of both sorts, one candidate in each."""
    r = random.Random(seed)
    of = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    number = lambda n, first="123456789": r.choice(first) + of("0123456789", n - 1)
    hexes, letters = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    word = lambda: of("aeioubcdlmnrst", r.randint(2, 8))

    def luhn_number(n: int) -> str:
        s = number(n - 1, "3456")
        total = sum(d if i % 2 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(map(int, reversed(s))))
        return s + str(-total % 10)

    def personal(kind: str) -> str:
        if kind == "email":
            at, dot = r.choice(((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot ")))
            return f"{word()}{at}{word()}{dot}{r.choice(('com', 'org', 'net', 'de', 'es'))}"
        if kind == "ip":
            if r.random() < 0.5:
                return r.choice(("[.]", "(.)", "[dot]", " dot ")).join(str(r.randint(0, 255)) for _ in range(4))
            parts = [f"{r.randrange(65536):x}" for _ in range(8)]
            return ":".join(parts) if r.random() < 0.5 else ":".join(parts[: r.randint(1, 4)]) + "::" + ":".join(parts[: r.randint(1, 3)])
        if kind == "card":
            s = luhn_number(r.choice((15, 16, 16, 16)))
            cut = (4, 10) if len(s) == 15 else (4, 8, 12)
            return s if r.random() < 0.6 else r.choice("- ").join(s[i:j] for i, j in zip((0, *cut), (*cut, len(s))))
        if kind == "phone":
            a, b, c = number(3, "23456789"), number(3, "23456789"), number(4)
            return r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{number(2)} {a} {b} {c}", f"011 {number(2)} {a} {b} {c}"))
        if kind == "secret":
            return r.choice((of(hexes, r.choice((24, 32, 40, 64))), of(letters + "0123456789", r.randint(20, 60)), of(letters + "0123456789!#%*-_", r.randint(9, 20)), "AK" + of(letters[:26] + "0123456789", 18), of(letters + "0123456789", r.randint(60, 900)), ".".join("eyJ" * (i < 2) + of(letters + "0123456789_-", r.randint(12, 400)) for i in range(3))))
        return f"{number(3)}-{number(2)}-{number(4)}" if r.random() < 0.5 else r.choice(("DE", "ES", "FR", "GB")) + number(2) + "".join(r.choice(("", " ")) + number(4) for _ in range(4))

    def other(kind: str) -> str:
        a, b, c = number(3), number(3), number(4)
        return {
            "email": lambda: f"{word()} at {word()} dot {word()} {word()}",
            "ip": lambda: r.choice((f"{a} dot {b} dot {a} dot {b}", f"{a[:2]}:{b[:2]}:{c[:2]}:{a}::{b}", "::".join((word(), a[:1], b[:1])), f"{of(hexes, 2)}::{word()}")),
            "card": lambda: number(r.choice((13, 14, 15, 16, 17, 18))) if r.random() < 0.6 else r.choice("- ").join(number(4) for _ in range(4)),
            "phone": lambda: r.choice((f"{a}.{b}.{c}", f"{a}-{b}-{c}", f"00{number(11)}", f"{a}{b}-{c}")),
            "secret": lambda: r.choice((f"{word()}/{word()}-{number(2)}/{word()}{word()}{word()}", f"{word()}_{word()}_{word()}_{word()}{number(1)}_{word()}", of(hexes, 40), f"{word()}{word()}{word()}", "/".join(word() for _ in range(r.randint(5, 120))), f"{word()}{word()}.{word()}{word()}{word()}.{word()}{word()}{word()}", f"{number(4)}-{number(2)}-{number(2)}-{word()}-{word()}-{word()}")),
            "id": lambda: r.choice((f"{a}-{b[:2]}-{c}", f"{of(letters[:26], 2)}{number(2)} {of(letters[:26], 4)} {of(letters[:26], 4)}", f"AB{number(2)}{number(4)}{number(4)}")),
        }[kind]()

    out = []
    for _ in range(rows):
        kind, good = r.choice(ALL + ("card", "phone", "secret")), r.random() < 0.5
        hint = r.choice(contexts[kind]) + (r.choice(("=", ": ", " = ", ':"', ' = "', "='")) if kind == "secret" else r.choice((": ", " ", " is ", " - ")))
        odd = r.choice(contexts[""]) + r.choice((" ", ": ", " #", "-", " = ", "="))
        s = personal(kind) if good or kind == "secret" and r.random() < 0.3 else other(kind)
        lead = hint if good and r.random() < (0.95 if kind == "secret" else 0.7) or not good and r.random() < 0.05 else odd if not good and r.random() < 0.8 else word() + " "
        tail = r.choice((" ", ". ", ", ", "\n")) if good or r.random() < 0.5 else r.choice(("/", "_x", "-7", "=", ".5"))
        tail = '"' + tail if lead.endswith('"') else "'" + tail if lead.endswith("'") else tail
        out.append((f"{word()} {word()} {lead}{s}{tail}{word()}", kind, int(good)))
    return out


def train(spark: SparkSession, rows: int = TRAIN_ROWS, seed: int = 11, precision: float = PRECISION) -> SpanModel:
    """Fit on three quarters of the synthetic snippets; calibrate slope, offset and threshold on the rest, of other contexts."""
    held_rows = rows // 4
    snippets = _snippets(rows - held_rows, seed, CONTEXTS[0]) + _snippets(held_rows, seed + 1, CONTEXTS[1])
    data = spark.createDataFrame([(i, *x) for i, x in enumerate(snippets)], "id int, text string, kind string, y int").repartition(4)
    found = []
    for g, (kind, pattern) in enumerate(EXTRA):
        hits = data.where(F.col("kind") == kind).select("id", "y", "text", F.explode(_spans(F.col("text"), pattern, _needs(F.col("text"), g))).alias("span"))
        found.append(hits.select("id", "y", *[c.alias(f"f{i}") for i, c in enumerate(_features(kind, g, F.col("text"), F.col("span")))]))
    union = found[0]
    for f in found[1:]:
        union = union.unionByName(f)
    table = np.array(sorted(tuple(x) for x in union.collect()), float)
    x, y, held = table[:, 2:], table[:, 1], table[:, 0] >= rows - held_rows
    start, trees = boosting.fit(x[~held], y[~held], trees=30, depth=4, least=8)
    z = start + sum(boosting.predict(t, x[held]) for t in trees)
    a, b = 1.0, 0.0
    for _ in range(50):  # Platt scaling by Newton steps
        p = boosting.sigmoid(a * z + b)
        w = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        a, b = np.array([a, b]) - np.linalg.solve(h, [((p - y[held]) * z).sum() + 1e-3 * (a - 1), (p - y[held]).sum() + 1e-3 * b])
    p = boosting.sigmoid(a * z + b)
    order = np.argsort(-p, kind="stable")
    exact = np.cumsum(y[held][order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(exact >= precision)
    return SpanModel(start, tuple(trees), float(a), float(b), float(p[order][good[-1]]) if len(good) else 1.0)


def find(docs: DataFrame, model: SpanModel) -> DataFrame:
    """docs' doc_id and text with `base` and `extra`: for each kind an array of spans (start, end, s), sorted by start.

    Null and empty texts have no spans. Rows are independent, so repeated rows each give their result; extra columns of
    docs are ignored. Texts of any length are read whole. An empty table gives an empty result. `extra` holds selected spans
    that lie in no base span and in no longer selected span of the kind; spans that start together are sorted by their end.
    """
    rows = docs.select("doc_id", whole().alias("text"))
    rows = rows.withColumns({f"_{k}": _spans(F.col("text"), BASE[k], F.col("text").rlike(NEEDS[k])) for k in KINDS})
    valid = lambda k: F.filter(f"_{k}", lambda x: _valid(k, x["s"]))
    rows = rows.withColumns({f"_{k}": valid(k) for k in KINDS if k != "email"})
    rows = rows.withColumns({f"_x{g}": _spans(F.col("text"), p, _needs(F.col("text"), g)) for g, (k, p) in enumerate(EXTRA)})
    selected = lambda k, g: F.filter(f"_x{g}", lambda x: model.selects(_features(k, g, F.col("text"), x)))
    rows = rows.withColumns({f"_x{g}": selected(k, g) for g, (k, _) in enumerate(EXTRA)})
    place = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s")))
    own = {k: [f"_x{g}" for g, (kind, _) in enumerate(EXTRA) if kind == k] for k in ALL}
    outside = lambda k, x: ~F.exists(f"_{k}", lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"]))
    merged = lambda k: F.array_distinct(F.concat(*map(place, own[k])))
    added = lambda k: F.array_sort(F.filter(merged(k), lambda x: outside(k, x)) if k in KINDS else merged(k))
    inside = lambda x, y: (y["start"] <= x["start"]) & (x["end"] <= y["end"]) & (y["end"] - y["start"] > x["end"] - x["start"])
    rows = rows.withColumns({f"_a{k}": added(k) for k in ALL})
    extra = {k: F.filter(f"_a{k}", lambda x: ~F.exists(f"_a{k}", lambda y: inside(x, y))) for k in ALL}  # noqa: B023
    return rows.select("doc_id", "text", F.struct(*[F.col(f"_{k}").alias(k) for k in KINDS]).alias("base"), F.struct(*[c.alias(k) for k, c in extra.items()]).alias("extra"))


def redacted(found: DataFrame) -> DataFrame:
    """doc_id and text with every base and extra span replaced by its kind in brackets; of overlapping spans, the union goes."""
    named = lambda part, k: F.transform(f"{part}.{k}", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(k).alias("kind")))
    spans = F.array_sort(F.concat(*[named("base", k) for k in KINDS], *[named("extra", k) for k in ALL]))
    none = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substr(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        mark = F.when(x["start"] < acc["at"], F.lit("")).otherwise(F.concat(gap, F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], mark).alias("out"))

    done = F.aggregate("_spans", none, step)
    return found.withColumn("_spans", spans).withColumn("_done", done).select("doc_id", F.concat("_done.out", F.substr(F.col("text"), (F.col("_done.at") + 1).cast("int"))).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans, their hash, all spans as text, and counts of found kinds and of all spans; one row per document."""
    place = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))
    told = lambda k, spans: F.transform(spans, lambda x: F.concat_ws(":", F.lit(k), x["start"].cast("string"), x["end"].cast("string")))
    base = F.concat(*[told(k, F.col(f"base.{k}")) for k in KINDS])
    every = {k: F.concat(F.transform(f"base.{k}", place), F.transform(f"extra.{k}", place)) if k in KINDS else F.transform(f"extra.{k}", place) for k in ALL}
    both = F.concat(*[told(k, F.array_sort(spans)) for k, spans in every.items()])
    return found.select(
        "doc_id", *[F.size(f"base.{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.concat_ws(",", base).cast("binary"), 256).alias("base_sha256"), F.concat_ws(",", both).alias("spans"),
        *[F.size(f"extra.{k}").cast("long").alias(f"n_{k}") for k in FOUND], F.size(both).cast("long").alias("n_spans"),
    )
