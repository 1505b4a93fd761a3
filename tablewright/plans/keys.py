"""Which candidate key to take as the primary key, and what to add where there is none."""

from __future__ import annotations

from dataclasses import dataclass

#: Parts of names that keys tend to have, and names of added keys by preference (fixed values).
KEY_WORDS = ("id", "_id", "_pk", "key", "code", "uuid", "guid")
SURROGATES = ("id", "pk", "row_id", "surrogate_id")


@dataclass(frozen=True)
class Choice:
    columns: tuple[str, ...]
    reason: str


def grade(columns: tuple[str, ...]) -> int:
    """How well a key suits, 0 best: `id`, `..._id`, a name with a key word, any column, several columns."""
    if len(columns) > 1:
        return 4
    name = columns[0].lower()
    tests = (name == "id", name.endswith("_id"), any(w in name for w in KEY_WORDS))
    return next((i for i, fits in enumerate(tests) if fits), 3)


REASONS = ("column `id` is a key", "a key named like a reference", "a key with a key word in its name", "a key", "the smallest set of columns that is a key")


def recommend(keys, declared: tuple[str, ...] = (), table: str = "", columns: tuple[str, ...] = ()) -> Choice:
    """The declared key, else the best of the candidate keys (objects with `columns`, in order of preference), else one to add."""
    if declared:
        return Choice(tuple(declared), "declared")
    if not keys:
        return Choice((surrogate(table, columns),), "to be added: no columns are a key")
    best = min(enumerate(keys), key=lambda k: (grade(tuple(k[1].columns)), len(k[1].columns), k[0]))[1]
    return Choice(tuple(best.columns), REASONS[grade(tuple(best.columns))])


def surrogate(table: str, columns: tuple[str, ...]) -> str:
    """A free name for an added key."""
    taken = {c.lower() for c in columns}
    return next((s for s in SURROGATES if s not in taken), f"{table}_id")


def best(keys, recommended: tuple[str, ...] = ()):
    """The key to show first: the recommended one, then minimal ones, then by uniqueness, nulls and size; None without keys."""
    minimal = {tuple(k.columns) for k in keys if not any(set(o.columns) < set(k.columns) for o in keys)}
    order = lambda k: (tuple(k.columns) != tuple(recommended), tuple(k.columns) not in minimal, -k.uniqueness, k.null_pct, len(k.columns))
    return min(keys, key=order, default=None)
