"""Target designs: documents, classification, checks, Spark DDL and dbt text, and the execution of star designs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Words that cannot name columns unquoted (fixed values).
RESERVED = frozenset("select from where table order group by join user index primary key foreign references check default constraint column grant limit offset union all distinct case when then else end and or not null".split())


@dataclass(frozen=True)
class DesignColumn:
    name: str
    type: str = "string"
    role: str = "attribute"  # surrogate_key, natural_key, business_key, foreign_key, measure, attribute
    source: str | None = None
    nullable: bool = True


@dataclass(frozen=True)
class DesignTable:
    name: str
    role: str  # staging, dimension, fact, hub, link, satellite, bridge
    columns: tuple[DesignColumn, ...] = ()
    source: str | None = None
    scd: int = 1
    grain: str | None = None

    def of(self, *roles: str) -> list[str]:
        return [c.name for c in self.columns if c.role in roles]


@dataclass(frozen=True)
class Relation:
    source: str
    source_columns: tuple[str, ...]
    target: str
    target_columns: tuple[str, ...]


@dataclass(frozen=True)
class Design:
    strategy: str  # star, snowflake, 3nf, data_vault, one_big_table
    tables: tuple[DesignTable, ...] = ()
    relations: tuple[Relation, ...] = field(default=())

    def table(self, name: str) -> DesignTable | None:
        return next((t for t in self.tables if t.name == name), None)


def from_document(doc: dict) -> Design:
    """A design from a JSON or YAML document; roles follow flags, and listed measures become columns."""
    tables = []
    for role, key in (("staging", "staging_models"), ("dimension", "dimensions"), ("fact", "facts"), (None, "tables")):
        for t in doc.get(key, ()):
            cols = []
            for c in t.get("columns", ()):
                c = {"name": c} if isinstance(c, str) else c
                r = c.get("role") or ("surrogate_key" if c.get("primary_key") or c.get("is_primary_key") else "foreign_key" if c.get("foreign_key") or c.get("is_foreign_key") else "attribute")
                cols.append(DesignColumn(c["name"], c.get("type") or c.get("data_type") or "string", r, c.get("source_column"), c.get("nullable", True)))
            have = {c.name for c in cols}
            cols += [DesignColumn(m if isinstance(m, str) else m["name"], "double", "measure") for m in t.get("measures", ()) if (m if isinstance(m, str) else m["name"]) not in have]
            tables.append(DesignTable(t["name"], role or t.get("role", "staging"), tuple(cols), t.get("source") or t.get("source_table"), int(t.get("scd_type", 1)), t.get("grain")))
    tup = lambda x: tuple([x] if isinstance(x, str) else x)
    rel = [Relation(r["from_table"], tup(r.get("from_columns") or r["from_column"]), r["to_table"], tup(r.get("to_columns") or r["to_column"])) for r in doc.get("relationships", ())]
    return Design(doc.get("strategy") or doc.get("modeling_strategy") or "star", tuple(tables), tuple(rel))


def vault_kind(t: DesignTable) -> str:
    """hub or link: by role, else a table with keys is a hub."""
    if t.role in ("dimension", "hub", "entity", "lookup"):
        return "hub"
    if t.role in ("fact", "junction", "link", "bridge"):
        return "link"
    return "hub" if business_keys(t) else "link"


def business_keys(t: DesignTable) -> list[str]:
    return t.of("business_key", "natural_key") or [n for n in t.of("primary_key") if not n.endswith("_key")] or t.of("surrogate_key")


def cycles(d: Design) -> list[list[str]]:
    """Cycles of references, each once, by depth-first search."""
    graph: dict[str, list[str]] = {}
    for r in d.relations:
        graph.setdefault(r.source, []).append(r.target)
    found: dict[frozenset[str], list[str]] = {}

    def walk(node: str, path: list[str]) -> None:
        for n in graph.get(node, ()):
            if n in path:
                loop = path[path.index(n) :]
                found.setdefault(frozenset(loop), loop)
            else:
                walk(n, [*path, n])

    for start in graph:
        walk(start, [start])
    return list(found.values())


def check(d: Design) -> list[tuple[str, str, str]]:
    """(severity, table, problem) of a design."""
    out, names = [], [t.name for t in d.tables]
    out += [("HIGH", n, "duplicate table") for n in sorted({n for n in names if names.count(n) > 1})]
    for t in d.tables:
        cols = [c.name for c in t.columns]
        out += [("HIGH", t.name, f"duplicate column {c}") for c in sorted({c for c in cols if cols.count(c) > 1})]
        out += [("MEDIUM", t.name, f"reserved word {c}") for c in cols if c.lower() in RESERVED]
        out += [("LOW", t.name, f"name {c} is not snake case") for c in cols if not re.fullmatch(r"[a-z_][a-z0-9_]*", c)]
        if t.role in ("dimension", "hub") and not t.of("surrogate_key", "natural_key", "business_key"):
            out.append(("HIGH", t.name, "no key"))
        if t.role == "fact" and not t.of("measure"):
            out.append(("MEDIUM", t.name, "fact without measures"))
        if t.role == "fact" and not t.grain:
            out.append(("MEDIUM", t.name, "fact without grain"))
    for r in d.relations:
        for side, cols in ((r.source, r.source_columns), (r.target, r.target_columns)):
            t = d.table(side)
            out += [("CRITICAL", side, "unknown table in a relation")] if t is None else [("CRITICAL", side, f"unknown column {c} in a relation") for c in cols if c not in [x.name for x in t.columns]]
    linked = {r.source for r in d.relations} | {r.target for r in d.relations}
    out += [("MEDIUM", t.name, "orphan table") for t in d.tables if t.role in ("dimension", "fact") and t.name not in linked]
    if d.strategy == "star" and not any(t.role == "fact" for t in d.tables):
        out.append(("HIGH", "", "star without fact"))
    return out + [("HIGH", c[0], "reference cycle " + " -> ".join([*c, c[0]])) for c in cycles(d)]


def ddl(t: DesignTable, relations: tuple[Relation, ...] = ()) -> str:
    """CREATE TABLE with informational constraints."""
    lines = [f"  `{c.name}` {c.type.upper()}" + ("" if c.nullable else " NOT NULL") for c in t.columns]
    key = t.of("surrogate_key") or t.of("business_key", "natural_key")
    lines += [f"  PRIMARY KEY ({', '.join(key)}) NOT ENFORCED"] if key else []
    lines += [f"  FOREIGN KEY ({', '.join(r.source_columns)}) REFERENCES {r.target} ({', '.join(r.target_columns)}) NOT ENFORCED" for r in relations if r.source == t.name]
    return f"CREATE TABLE {t.name} (\n" + ",\n".join(lines) + "\n) USING parquet"


def script(d: Design) -> tuple[str, str]:
    """(create, drop): tables in an order that references allow, and the reverse."""
    done: list[str] = []
    todo = [t.name for t in d.tables]
    while todo:
        ready = [n for n in todo if all(r.target in done or r.target == n or r.target not in todo for r in d.relations if r.source == n)] or todo[:1]
        done += ready
        todo = [n for n in todo if n not in ready]
    return ";\n\n".join(ddl(d.table(n), d.relations) for n in done) + ";", ";\n".join(f"DROP TABLE IF EXISTS {n}" for n in reversed(done)) + ";"


def dbt_project(d: Design, name: str = "project") -> dict[str, str]:
    """Files of a dbt project: project file, sources, one model per table and column tests."""
    files = {"dbt_project.yml": f"name: {name}\nversion: '1.0'\nmodel-paths: [models]\n"}
    sources = sorted({t.source for t in d.tables if t.source})
    files["models/sources.yml"] = "version: 2\nsources:\n  - name: raw\n    tables:\n" + "".join(f"      - name: {s}\n" for s in sources)
    tests = "version: 2\nmodels:\n"
    for t in d.tables:
        cols = [(f"{c.source} as {c.name}" if c.source and c.source != c.name else c.name) for c in t.columns]
        key = t.of("natural_key", "business_key")
        if t.role in ("dimension", "fact") and key and t.of("surrogate_key"):
            sk = t.of("surrogate_key")[0]
            cols = [f"md5(concat_ws('-', {', '.join(f"coalesce(cast({k} as string), '_null_')" for k in key)})) as {sk}" if c == sk else c for c in cols]
        source = f"{{{{ source('raw', '{t.source}') }}}}" if t.role == "staging" or not d.table(t.source or "") else f"{{{{ ref('{t.source}') }}}}"
        files[f"models/{t.role}/{t.name}.sql"] = "select\n    " + ",\n    ".join(cols or ["*"]) + f"\nfrom {source if t.source else t.name}\n"
        tests += f"  - name: {t.name}\n    columns:\n" + "".join(f"      - name: {c}\n        tests: [unique, not_null]\n" for c in t.of("surrogate_key"))
    files["models/schema.yml"] = tests
    return files


def check_files(files: dict[str, str]) -> list[tuple[str, str]]:
    """(file, problem): unbalanced templates, references to models that are not there, statements that change data."""
    models = {f.rsplit("/", 1)[-1][:-4] for f in files if f.endswith(".sql")}
    out = []
    for name, text in files.items():
        if text.count("{{") != text.count("}}") or text.count("(") != text.count(")"):
            out.append((name, "unbalanced brackets"))
        if name.endswith(".sql"):
            out += [(name, f"unknown model {m}") for m in re.findall(r"ref\('([^']+)'\)", text) if m not in models]
            out += [(name, f"statement {w}") for w in re.findall(r"(?i)\b(drop|delete|truncate|alter|grant)\s", text)]
        if not text.strip():
            out.append((name, "empty"))
    return out


def strategy(name: str) -> str:
    """The planner of a strategy: star schemas, relations or vault objects."""
    kinds = {"star": "star", "star_schema": "star", "snowflake": "star", "one_big_table": "star", "3nf": "relations", "data_vault": "vault"}
    if name.lower() not in kinds:
        raise ValueError(f"unknown strategy {name}")
    return kinds[name.lower()]
