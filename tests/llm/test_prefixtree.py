"""The conversation trie against one built turn by turn in plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from tablewright.llm import prefixtree, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rebuilt(rows):
    """conv_id to its turns, as the contract puts them together."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + ts[h:]
    return out


def brute(sequences):
    members, kids = defaultdict(set), defaultdict(set)
    for c, ts in sequences.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].add(c)
            if d:
                kids[tuple(ts[: d - 1])].add(tuple(ts[:d]))
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, ())
        leaves[p] = sum(leaves[k] for k in below) or (0 if below else 1)
        saved[p] = sum(saved[k] for k in below) + ((len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0)
    rows = Counter()
    for p, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(sequences[c]) == len(p))))
        rows[min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(kids.get(p, ())), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return rows


def held(df, sequences):
    assert Counter(map(tuple, df.collect())) == brute(sequences)


def test_query(spark, sf):
    t = pq.read_table(f"{sf}/conversations.parquet").to_pylist()
    out = queries.op13_conversation_trie(spark, sf)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert [k for _, k in out.dtypes] == ["bigint"] * 7 + ["string"]
    held(out, rebuilt((r["conv_id"], r["turn"], r["role"], r["text"]) for r in t))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, words string, depth int")


@pytest.mark.parametrize("chunk", [3, 4096])
def test_random_trees(spark, monkeypatch, chunk):
    """Few different turns, so that conversations branch, end inside each other and repeat; chunks of three depths as well."""
    monkeypatch.setattr(prefixtree, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = []
    for c in [*range(0, 60), *range(400, 440), 1003]:
        n = rng.choice((1, 2, 3, 5, 9, 14))
        rows += [(c, i if rng.random() < 0.95 else None, rng.choice(("u", "a", None)) if i > 5 else "u", rng.choice(("one", "two words", "", None)) if rng.random() < 0.4 else "same text here") for i in range(n)]
    sorted_ties = [r for r in rows if r[1] is not None] + [(c, None, "u", "z") for c in {r[0] for r in rows if r[1] is None}]
    df = frame(spark, sorted_ties)
    held(prefixtree.digest(*prefixtree.tree(prefixtree.rebuilt(df))), rebuilt(sorted_ties))
    own = defaultdict(list)
    for c, turn, role, text in sorted(sorted_ties, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    held(prefixtree.digest(*prefixtree.tree(prefixtree.plain(df))), own)


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(prefixtree, "CHUNK", 50)
    long = [(40, i, "u", f"t {i % 7}") for i in range(400)]  # one conversation holds most rows
    comb = [(100 + 20 * k, i, "u", "tooth " * (i + 1)) for k in range(12) for i in range(3 * k + 1)]
    copies = [(c, i, "u", "copy of all") for c in range(500, 700) for i in range(2)]
    rows = long + comb + copies + [(None, 1, "u", "x"), (None, None, None, None), (3, 0, None, None), (7, 5, "", ""), (-5, 1, "u", "minus"), (41, 2, "u", "y" * 50_000), (21, 1, "a", "é😀  x")]
    held(prefixtree.digest(*prefixtree.tree(prefixtree.rebuilt(frame(spark, [r for r in rows if r[0] != -5])))), rebuilt([r for r in rows if r[0] != -5]))
    assert prefixtree.digest(*prefixtree.tree(prefixtree.rebuilt(frame(spark, rows).where("false")))).count() == 0
    same = [(5, 1, "u", "again")] * 3 + [(6, None, "u", "again")] * 2  # equal rows are turns of their own
    got = prefixtree.tree(prefixtree.plain(frame(spark, same)))[0].orderBy("depth").select("n_convs", "saved_tokens").collect()
    assert [tuple(r) for r in got] == [(2, 2), (2, 2), (2, 1), (1, 0)]
