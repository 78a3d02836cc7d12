import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from penstock.llm import op3_suffix_dedup as op3
from penstock.llm import op6_decontaminate as op6
from penstock.llm import op8_line_dedup as op8
from penstock.llm import op10_jaccard_join as op10
from penstock.llm import textops as T
from penstock.llm.components import components

DOCS = "doc_id long, text string"


def copies(seed, n, words=120, vocabulary=500, edits=4):
    """Documents in near-copy groups, with shared passages."""
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(vocabulary)]
    passages = [" ".join(rng.choices(pool, k=30)) for _ in range(3)]
    out = []
    while len(out) < n:
        base = rng.choices(pool, k=rng.randint(3, words))
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = rng.choice(pool)
            text = " ".join(own)
            if rng.random() < 0.4:
                text += "\n" + rng.choice(passages)
            out.append(text)
    return list(enumerate(out[:n]))


# ---- words and fingerprints


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB \t\né日\x0b\x85\xa0", max_size=30) | st.none(), max_size=8))
def test_words_are_ascii_words(texts):
    data, bounds = T.text_bytes(pa.array(texts, pa.string()))
    row, start, end, _ = T.word_hashes(data, bounds) if len(data) else ([], [], [], [])
    got = [(int(r), bytes(data[s:e])) for r, s, e in zip(row, start, end, strict=True)]
    want = [(k, w) for k, t in enumerate(texts) for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
    assert got == want


def test_fingerprints_are_by_content():
    data = np.frombuffer(b"abcabcab", np.uint8)
    grams = T.Rolling(data).grams(3)
    assert grams[0] == grams[3] and grams[1] == grams[4] and len(set(grams.tolist())) == 3
    keys = np.array([5, 3, 9, 1, 7, 2], np.uint64)
    assert T.sliding_min(keys, 3).tolist() == [3, 1, 1, 1]


# ---- op3


def repeats(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(b[i : i + length])
        out[d] = (len(b), sum(gone), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("group_rows", [3, 4096])
def test_repeats_match_brute_force(spread, monkeypatch, group_rows):
    monkeypatch.setattr(op3, "GROUP_ROWS", group_rows)
    rows = copies(1, 150) + [(900, "ab" * 300), (901, "ab" * 150 + "c" + "ab" * 90), (902, "é" * 200)]
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), bytes(r.kept)) for r in op3.remove_repeats(spread.createDataFrame(rows, DOCS), 40).collect()}
    assert got == repeats(rows, 40)


def test_repeats_odd(odd_docs, no_docs):
    got = {}
    for r in op3.remove_repeats(odd_docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_bytes - len(r.kept)))
    assert got[2][0] == got[2][1] == (got[1][0][0], got[1][0][0]) and got[1][0][1] == 0
    assert got[3] == [(0, 0)] and got[4] == [(0, 0)] and sorted(got[None]) == [(0, 0), (17, 0)]
    assert got[5][0][1] > 180_000 and got[6][0][1] >= got[5][0][0] and len(got[7]) == 2
    assert op3.remove_repeats(no_docs).count() == 0


# ---- op8


def test_line_runs_odd(odd_docs, no_docs):
    got = {}
    for r in op8.dedup_lines(odd_docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_lines, r.n_removed, r.kept))
    assert got[2] == [(3, 3, ""), (3, 3, "")] and got[1][0][1] == 0
    assert (4, 3, "tail") in got[7] and got[3] == [(0, 0, "")] and len(got[None]) == 2
    assert op8.dedup_lines(no_docs).count() == 0


def test_line_runs_extend(spark):
    rows = [(1, "a\nb\nc\nd\ne\n"), (2, "x\nb\nc\nd\ne\ny\n"), (3, "b\nc\n"), (4, "p\nq\np\nq\np\nq\np\nq\n")]
    got = {r.doc_id: r.kept for r in op8.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: rows[0][1], 2: "x\ny\n", 3: "b\nc\n", 4: "p\nq\n"}


def repeated_lines(rows, run, words):
    """Text kept of each document by comparing every stretch of lines with all earlier ones."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        lines = re.findall(r"[^\n]+\n*|\n+", t)
        bare, gone = [x.strip(" \t\r\n") for x in lines], set()
        for i in range(len(lines)):
            for m in range(1, run + 1):
                part = tuple(bare[i : i + m])
                if len(part) == m and (m == run or sum(len(x.split()) for x in part) >= words):
                    gone |= set(range(i, i + m)) if part in seen else set()
                    seen.add(part)
        out[d] = "".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_long_passages_on_few_lines(spark):
    def prose(seed, n):
        return " ".join(f"v{seed}x{k}" for k in range(n))

    one, left, right, short = prose(1, 60), prose(2, 30), prose(3, 30), prose(4, 49)
    rows = [
        (1, f"a\n{one}\nb\n{left}\n{right}\nc\n{short}\n"), (2, f"x\n{one}\ny\n"), (3, f"x1\n{left}\n{right}\ny1\n"), (4, f"{short}\n"),
        (5, f"{one}"), (6, f"  {left}\n\n{right}"), (7, f"{left}\nz\n{right}\n"), (8, f"{one}\n{one}\n"),
    ]
    got = {r.doc_id: r.kept for r in op8.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: rows[0][1], 2: "x\ny\n", 3: "x1\ny1\n", 4: rows[3][1], 5: "", 6: "", 7: rows[6][1], 8: ""}


@pytest.mark.parametrize("run,words", [(3, 8), (4, 12), (1, 5)])
def test_line_passages_match_brute_force(spread, run, words):
    rng = random.Random(run)
    pool = [" ".join(rng.choices("abcdef", k=rng.randint(0, 2 * words))) for _ in range(40)]
    rows = [(k, rng.choice(["", " "]) + "\n".join(rng.choices(pool, k=rng.randint(0, 7)))) for k in range(120)]
    got = {r.doc_id: r.kept for r in op8.dedup_lines(spread.createDataFrame(rows, DOCS), run, words).collect()}
    assert got == repeated_lines(rows, run, words)


# ---- op10


def shingles(text):
    w = [x.decode("utf8", "surrogateescape") for x in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def classes(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("list_size,block,floor", [(24, 256, 24), (2, 8, 2), (1, 3, 1), (4, 4, 6)])
def test_classes_match_brute_force(spread, monkeypatch, list_size, block, floor):
    monkeypatch.setattr(op10, "LIST", list_size)
    monkeypatch.setattr(op10, "BLOCK", block)
    monkeypatch.setattr(op10, "FLOOR", floor)
    rows = copies(list_size, 220) + [(1000 + k, "tiny text") for k in range(30)] + [(2000, None), (2001, " \n")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op10.jaccard_classes(spread.createDataFrame(rows, DOCS)).collect()}
    assert got == classes(rows)


def test_classes_odd(odd_docs, no_docs):
    got = {}
    for r in op10.jaccard_classes(odd_docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert got[2] == [(got[1][0][0], 1)] * 2 and got[3] == [(0, 3)] and got[4] == [(0, 4)] and got[6][0][1] == 5
    assert len(got[7]) == 2 and len(got[None]) == 2
    assert op10.jaccard_classes(no_docs).count() == 0
    kept = op10.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.select("doc_id").collect()) == [-1, -1, 1, 3, 4, 5, 7, 8]
    assert op10.keep_one(no_docs).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, pairs):
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in range(30):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x != r}


# ---- op6


def slow_tiles(text, joins, item, least):
    """Greedy tiling by comparing all places."""
    least = min(least, len(item))
    used, taken, total = set(), set(), 0
    while least:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in range(len(text)):
                k = 0
                while i + k < len(text) and j + k < len(item) and text[i + k] == item[j + k] and i + k not in used and j + k not in taken and (k == 0 or joins[i + k]):
                    k += 1
                best = max(best, (k, -j, -i))
        if best[0] < least:
            return total
        k, j, i = best[0], -best[1], -best[2]
        used |= set(range(i, i + k))
        taken |= set(range(j, j + k))
        total += k


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=25), st.lists(st.integers(1, 4), max_size=14), st.integers(2, 4), st.data())
def test_tiles_match_slow_ones(text, item, least, data):
    joins = [False] + [data.draw(st.booleans()) for _ in text[1:]]
    assert sum(t[2] for t in op6.tiles(text, joins[: len(text)], item, least)) == (slow_tiles(text, joins, item, least) or 0)


def test_leaks(spread, odd_docs, no_docs):
    rng = random.Random(3)
    words = [f"k{x}" for x in range(400)]
    item = rng.sample(words, 40)
    rows = {
        1: rng.sample(words, 200), 2: ["x"] * 50 + item + ["y"] * 50, 3: item[20:] + ["and"] + item[:20],
        4: item[:15] + ["z"] * 30, 5: [w.upper() + "!!" for w in item], 6: item[10:20] + ["q"] + item[30:] + ["q"] + item[:10],
    }
    docs = spread.createDataFrame([(d, " ".join(t)) for d, t in rows.items()] + [(7, None), (8, ""), (None, " ".join(item))], DOCS)
    bench = spread.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "two words"), (1, "another text of item one here")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in op6.find_leaks(docs, bench).collect()}
    assert got == {(2, 1), (3, 1), (5, 1), (6, 1), (None, 1)}
    clean = op6.drop_leaks(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [1, 4, 7, 8]
    assert op6.find_leaks(no_docs, bench).count() == 0 and op6.find_leaks(docs, bench.limit(0)).count() == 0
    odd_bench = spread.createDataFrame([(1, "five six seven eight nine ten eleven twelve")], "item_id long, text string").withColumn("grams", F.lit(1))
    assert {r.doc_id for r in op6.find_leaks(odd_docs, odd_bench).collect()} == {1, 2, 7}
    assert op6.drop_leaks(odd_docs, odd_bench).columns == odd_docs.columns


def test_digest_of_kept_bytes(spark, sf_dir):
    r = op3.digest(spark, sf_dir).filter("n_removed = 0").first()
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.col("doc_id") == r.doc_id).first().text
    assert r.kept_sha256 == hashlib.sha256(text.encode()).hexdigest()
