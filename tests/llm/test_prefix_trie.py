import hashlib
import re
import zlib

import pytest

from penstock.llm import op13_prefix_trie as pt

CONV = "conv_id long, turn long, role string, text string, n_chars string, depth string, slot string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """The contract, by dictionaries: rows are (conv_id, turn, role, text)."""
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        b = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = own.get(b, [])[:h] + own[c][h:]
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    kids = {}
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    out = []
    for k, members in nodes.items():
        sub = [u for u in nodes if u[: len(k)] == k]
        ends = sorted(c for c in members if len(built[c]) == len(k))
        out.append((
            min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids.get(k, [])),
            sum(1 for u in sub if not kids.get(u)),
            sum((len(nodes[u]) - 1) * len(WORD.findall(u[-1][1])) for u in sub if u),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=lambda r: (r[0], r[1], r[7]))


def result(df):
    return sorted((tuple(r) for r in pt.trie(df).collect()), key=lambda r: (r[0], r[1], r[7]))


def test_against_brute_force_on_table(spark):
    conv = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert result(conv) == brute([tuple(r) for r in conv.select("conv_id", "turn", "role", "text").collect()])


def test_odd_rows(spark, spread):
    rows = [
        (0, 0, "user", "hi there"), (0, 1, "assistant", "hello  you"), (0, 2, "user", None), (1, 0, "user", "hi there"),
        (1, 1, None, "x y z"), (1, None, "system", "first"), (2, 5, "user", "a"), (2, 5, "user", "a"), (3, 0, "user", "hi there"),
        (20, 0, "user", "q"), (21, 0, "user", "only"), (27, 3, "assistant", ""), (-7, 0, "user", "neg"), (-20, 1, "user", "w w"),
        (None, 0, "user", "lost"), (40, None, None, None), (41, 0, "user", "x " * 5000),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], CONV)
    assert result(df) == brute(rows)


def test_empty(spark):
    assert pt.trie(spark.createDataFrame([], CONV)).count() == 0


def test_collision_is_refused(spark, monkeypatch):
    monkeypatch.setattr(pt, "_MASK", 0)
    rows = [(0, 0, "user", "a"), (40, 0, "user", "b")]
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], CONV)
    with pytest.raises(ValueError, match="share the digest"):
        result(df)
