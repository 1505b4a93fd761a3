"""Dependency theory on the driver: closures, keys, covers, normal forms, decompositions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from itertools import combinations


@dataclass(frozen=True)
class Dependency:
    """determinant -> dependent, with the measured confidence and group counts."""

    determinant: tuple[str, ...]
    dependent: str
    confidence: float = 1.0
    groups: int = 0
    violations: int = 0
    partial: bool = False
    transitive: bool = False

    @property
    def trivial(self) -> bool:
        return self.dependent in self.determinant

    def __str__(self) -> str:
        return f"{{{', '.join(self.determinant)}}} -> {self.dependent}"


def classify(found: Iterable[Dependency]) -> list[Dependency]:
    """Mark dependencies whose left side is itself determined by another set, and those that a single column of X implies."""
    found = list(found)
    sources: dict[str, list[frozenset[str]]] = {}
    for d in found:
        sources.setdefault(d.dependent, []).append(frozenset(d.determinant))
    out = []
    for d in found:
        own = frozenset(d.determinant)
        transitive = any(s != own and not s >= own for c in d.determinant for s in sources.get(c, ()))
        partial = len(own) > 1 and any(frozenset([c]) in sources[d.dependent] for c in own)
        out.append(replace(d, partial=partial, transitive=transitive))
    return out


def closure(columns: Iterable[str], fds: Iterable[Dependency]) -> frozenset[str]:
    """All columns that `columns` determine."""
    have, fds, grown = set(columns), list(fds), True
    while grown:
        new = {d.dependent for d in fds if d.dependent not in have and have.issuperset(d.determinant)}
        have |= new
        grown = bool(new)
    return frozenset(have)


def is_superkey(columns: Iterable[str], all_columns: Iterable[str], fds: Iterable[Dependency]) -> bool:
    return closure(columns, fds) >= set(all_columns)


def candidate_keys(all_columns: Iterable[str], fds: Iterable[Dependency], every: bool = False) -> list[tuple[str, ...]]:
    """Minimal keys by size. Columns that nothing determines are in every key. Ends after the first size past a hit unless `every`."""
    all_columns, fds = list(all_columns), list(fds)
    right = {d.dependent for d in fds if not d.trivial}
    core = [c for c in all_columns if c not in right]
    rest = [c for c in all_columns if c in right]
    keys: list[frozenset[str]] = []
    for size in range(len(rest) + 1):
        if keys and not every and size > len(min(keys, key=len)) - len(core) + 1:
            break
        for more in combinations(rest, size):
            k = frozenset(core) | set(more)
            if k and not any(have <= k for have in keys) and is_superkey(k, all_columns, fds):
                keys.append(k)
    return [tuple(c for c in all_columns if c in k) for k in keys]


def verdict(all_columns: list[str], fds: list[Dependency]) -> dict:
    """The normal form that the dependencies allow, what stands against a higher one, and what to do."""
    if not fds:
        return {"form": "BCNF", "bcnf": [], "transitive": [], "partial": [], "keys": [], "advice": ["No dependencies were found; the table may be normalized already or hold too little data."]}
    bcnf = [str(d) for d in fds if not is_superkey(d.determinant, all_columns, fds)]
    transitive = [str(d) for d in fds if d.transitive]
    partial = [str(d) for d in fds if d.partial]
    form = "BCNF" if not bcnf else "3NF" if not transitive else "2NF" if not partial else "1NF"
    advice = [f"{goal}: split off {', '.join(what[:3])}" for goal, what in (("2NF", partial), ("3NF", transitive), ("BCNF", bcnf if not transitive else [])) if what]
    return {"form": form, "bcnf": bcnf, "transitive": transitive, "partial": partial, "keys": candidate_keys(all_columns, fds), "advice": advice}


def minimal_cover(fds: Iterable[Dependency]) -> list[Dependency]:
    """Equivalent dependencies without extraneous left columns and without redundant ones."""
    work = list(dict.fromkeys((tuple(d.determinant), d.dependent) for d in fds if not d.trivial))
    asfd = lambda rows: [Dependency(x, y) for x, y in rows]
    full = asfd(work)
    reduced = []
    for x, y in work:
        left = list(x)
        for c in x:
            shorter = [k for k in left if k != c]
            if shorter and y in closure(shorter, full):
                left = shorter
        reduced.append((tuple(left), y))
    running = list(dict.fromkeys(reduced))
    for fd in list(running):
        others = [f for f in running if f != fd]
        if fd[1] in closure(fd[0], asfd(others)):
            running = others
    return asfd(running)


def synthesize_3nf(all_columns: list[str], fds: Iterable[Dependency]) -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
    """(columns, key) of relations in 3NF: one per left side of the cover, one that holds a key and all columns without dependency."""
    cover = minimal_cover(fds)
    order = {c: i for i, c in enumerate(all_columns)}
    by_left: dict[tuple[str, ...], set[str]] = {}
    for d in cover:
        by_left.setdefault(tuple(sorted(d.determinant, key=order.get)), set()).add(d.dependent)
    relations = [(tuple(sorted({*x, *ys}, key=order.get)), x) for x, ys in by_left.items()]
    key = candidate_keys(all_columns, cover)[0] if all_columns else ()
    loose = [c for c in all_columns if not any(c in r for r, _ in relations)]
    if loose or not any(set(key) <= set(r) for r, _ in relations):
        relations.append((tuple(sorted({*key, *loose}, key=order.get)), key))
    return [r for i, r in enumerate(relations) if not any(i != j and (set(r[0]) < set(o[0]) or set(r[0]) == set(o[0]) and j < i) for j, o in enumerate(relations))]


def project(columns: Iterable[str], fds: Iterable[Dependency]) -> list[Dependency]:
    """Dependencies with minimal left sides that hold inside a set of columns.

    A minimal left side has only columns that are on the left of a given dependency, so only sets of these are looked at: their
    number bounds the work, not the number of columns.
    """
    columns, fds, out = list(columns), list(fds), []
    left = [c for c in columns if any(c in d.determinant for d in fds)]
    for size in range(1, min(len(left), len(columns) - 1) + 1):
        for x in combinations(left, size):
            for y in sorted(closure(x, fds) & set(columns) - set(x)):
                if not any(d.dependent == y and set(d.determinant) < set(x) for d in out):
                    out.append(Dependency(x, y))
    return out


def decompose_bcnf(all_columns: list[str], fds: Iterable[Dependency]) -> list[tuple[str, ...]]:
    """Relations in BCNF by splitting R at a violating X into X+ and R - (X+ - X)."""
    fds, todo, done = list(fds), [tuple(all_columns)], []
    while todo:
        r = todo.pop()
        bad = next((d for d in project(r, fds) if not is_superkey(d.determinant, r, fds)), None)
        if bad is None:
            done.append(r)
            continue
        inner = closure(bad.determinant, fds) & set(r)
        todo += [tuple(c for c in r if c in inner), tuple(c for c in r if c not in inner or c in bad.determinant)]
    return sorted((r for r in done if not any(set(r) < set(o) for o in done)), key=lambda r: [all_columns.index(c) for c in r])


def is_lossless(relations: list[tuple[str, ...]], all_columns: list[str], fds: Iterable[Dependency]) -> bool:
    """Chase test: does the join of the relations give back the table under the dependencies?"""
    fds = list(fds)
    rows = [{c: (c if c in r else f"{c}{i}") for c in all_columns} for i, r in enumerate(relations)]
    changed = True
    while changed:
        changed = False
        for d in fds:
            groups: dict[tuple, list[dict]] = {}
            for row in rows:
                groups.setdefault(tuple(row[c] for c in d.determinant), []).append(row)
            for same in groups.values():
                values = {row[d.dependent] for row in same}
                if len(values) > 1:
                    keep = d.dependent if d.dependent in values else min(values)
                    for old in values - {keep}:
                        for row in rows:
                            if row[d.dependent] == old:
                                row[d.dependent] = keep
                    changed = True
    return any(all(row[c] == c for c in all_columns) for row in rows)


def preserved(relations: list[tuple[str, ...]], fds: Iterable[Dependency]) -> bool:
    """Whether the dependencies inside the relations imply all the others.

    What X determines by way of the relations grows by what each of them gives, under all dependencies, to the columns it shares.
    """
    fds = list(fds)
    for d in fds:
        have, before = set(d.determinant), None
        while have != before:
            before = set(have)
            for r in relations:
                have |= closure(have & set(r), fds) & set(r)
        if d.dependent not in have:
            return False
    return True


def foreign_keys(relations: list[tuple[tuple[str, ...], tuple[str, ...]]]) -> list[tuple[int, tuple[str, ...], int]]:
    """(relation, columns, relation) by place: a relation that holds another's whole key refers to it, but not by its own whole key
    to one with the same key that comes later, so two relations never refer to each other."""
    out = []
    for i, (columns, key) in enumerate(relations):
        for j, (_, other) in enumerate(relations):
            if i != j and other and set(other) <= set(columns) and (set(other) != set(key) or j < i):
                out.append((i, other, j))
    return out


def decompose_2nf(all_columns: list[str], key: tuple[str, ...], fds: Iterable[Dependency]) -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
    """(columns, key): one relation per part of the key that determines non-key columns, and the rest."""
    fds = list(fds)
    parts: dict[tuple[str, ...], tuple[str, ...]] = {}
    taken: set[str] = set()
    for d in sorted(fds, key=lambda d: len(d.determinant)):
        x = tuple(c for c in all_columns if c in d.determinant)
        if set(x) < set(key) and d.dependent not in key and x not in parts:
            own = tuple(c for c in all_columns if c in closure(x, fds) and c not in key and c not in taken)
            if own:
                parts[x] = own
                taken |= set(own)
    rest = tuple(c for c in all_columns if c not in taken)
    return [((*x, *ys), x) for x, ys in parts.items()] + [(rest, key)]
