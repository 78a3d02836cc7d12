import numpy as np
import pytest

from penstock.llm import op12_language_id as lid


def brute_subwords(text, grams=4):
    out = []
    for word in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text.lower()).split(" "):
        if word:
            framed = "\0" + word + "\0"
            for n in range(1, grams + 1):
                out += [framed[i:i + n] for i in range(len(framed) - n + 1) if framed[i:i + n].strip("\0") and "\0" not in framed[i + 1:i + n - 1]]
    return out


@pytest.mark.parametrize("text", ["", "a", "ab cd", "  Hello,   wörld\tX\n", "日本語 ok", "x" * 50])
def test_subwords_count_like_brute_force(text):
    row, bucket = lid.subwords([text, "zz", None])
    assert (row == 0).sum() == len(brute_subwords(text))
    assert (row == 1).sum() == len(brute_subwords("zz")) and (row == 2).sum() == 0


def test_equal_subwords_share_buckets():
    r1, b1 = lid.subwords(["abc"])
    r2, b2 = lid.subwords(["q abc", "abc"])
    assert sorted(b1.tolist()) == sorted(b2[r2 == 1].tolist())


def test_pieces_cover_every_row_once():
    texts = ["a" * 10, None, "b" * 30, "c", "d" * 5]
    got = list(lid.pieces(texts, chars=12))
    assert got[0][0] == 0 and got[-1][1] == len(texts) and all(a < z for a, z in got)
    assert all(got[i][1] == got[i + 1][0] for i in range(len(got) - 1))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    result = lid.identify(docs)
    assert result.count() == docs.count()
    assert lid.accuracy(result, docs) >= 0.95
    assert result.filter("score < 0 OR score > 1").count() == 0


def test_odd_rows(spark, odd_docs):
    got = {(r.doc_id, r.lang_pred, round(r.score, 9), r.held_out) for r in lid.identify(odd_docs).collect()}
    rows = lid.identify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert all(r.lang_pred == "und" and r.score == 0.0 for r in by[3] + by[7][:0])
    assert any(r.lang_pred == "und" for r in by[7]) and any(r.lang_pred != "und" for r in by[7])
    assert len({(r.lang_pred, r.score) for r in by[2]}) == 1
    assert all(not r.held_out for r in by[None])
    assert {r.lang_pred for r in rows} <= {"en", "fr", "und"} and got


def test_empty_and_unlearnable(spark, no_docs, odd_docs):
    assert lid.identify(no_docs).count() == 0
    blind = odd_docs.drop("lang").withColumn("lang", odd_docs["text"].substr(1, 0).cast("string")).na.replace("", None, "lang")
    assert {r.lang_pred for r in lid.identify(blind).collect()} == {"und"}


def test_means_go_by_small_pieces(monkeypatch):
    """The subwords of one step stay few, and cuts between texts change no mean."""
    import numpy as np

    from penstock.llm import op12_language_id as op

    texts = [f"word {i} " * 3000 for i in range(40)] + [None, "", "x"]
    emb = np.random.default_rng(1).normal(size=(1 << op.BITS, op.DIM)).astype(np.float32)
    sizes, plain = [], op.subwords
    monkeypatch.setattr(op, "subwords", lambda t: sizes.append(sum(len(x or "") + 1 for x in t)) or plain(t))
    got = op.mean_vectors(texts, emb)
    assert max(sizes) <= op.MEAN_CHARS < sum(sizes)
    for i in (0, 17, 41, 42):
        row, bucket = plain([texts[i]])
        want = emb[bucket].astype(np.float64).mean(0) if len(bucket) else np.zeros(op.DIM)
        assert np.allclose(got[i], want)
