import zlib

import numpy as np
import pytest

from emberloom.llm import langid
from emberloom.llm.registry import op7_language_id


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    got = {r.doc_id: r for r in op7_language_id(spark, sf.replace("0.001", "0.01")).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert len(got) == len(rows)
    own = [got[r.doc_id].lang_pred == r.lang for r in rows if got[r.doc_id].held_out]
    assert len(own) > 100 and sum(own) / len(own) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_tables_equal_plain_convolution():
    net = langid.fit([("a", b"abc def " * 32), ("b", "éà zz ".encode() * 40)], steps=3)
    cls = langid.windows([b"some text, " * 30, "é".encode() * 5])[0]
    feats = []
    for w, conv in zip(langid.WIDTHS, net.conv, strict=True):
        r = sum(conv[j][cls[:, j : langid.WINDOW - w + 1 + j]] for j in range(w))
        feats.append(r.max(axis=1))
    z = np.maximum(np.hstack(feats) + net.bias, 0) @ net.dense + net.shift
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert np.allclose(net.forward(cls), z, atol=1e-4)


def test_edge_rows(spark):
    rows = [(None, "hello there friend", "en"), (1, None, "en"), (2, "", "en"), (3, "12 -- \n 34", "en"), (4, "bonjour à tous " * 9, "fr"), (4, "bonjour à tous " * 9, "fr"), (5, "word " * 60_000, None), (6, "the friend said hello", "en"), (7, "汉字", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score")
    net = langid.train(df)
    got = langid.identify(df, net).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[1].score == 0
    assert by[4].lang_pred == "fr" and by[6].lang_pred == "en" and by[7].lang_pred in ("en", "fr")
    untaught = langid.train(df.filter("lang = 'xx'"))
    assert {r.lang_pred for r in langid.identify(df, untaught).collect()} == {"und"}
    assert langid.identify(df.limit(0), net).collect() == []


def test_whole_text_counts():
    net = langid.fit([("a", b"abcd " * 50), ("b", b"wxyz " * 50)], steps=60)
    long = b"abcd " * 100 + b"wxyz " * 400
    lang, score = net.predict([long, long[:500], b"??", None])
    assert lang == ["b", "a", "und", "und"] and score[0] == pytest.approx(0.8, abs=0.1)


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    net = langid.fit([("a", b"abcd " * 50), ("b", b"wxyz " * 50), ("c", "éà zz ".encode() * 40)], steps=2)
    for part in (net.conv, [net.bias, net.dense, net.shift]):
        for k, q in enumerate(part):
            part[k] = q.astype(np.float64)
    net.bias, net.dense, net.shift = (q.astype(np.float64) for q in (net.bias, net.dense, net.shift))
    cls = langid.windows([bytes(rng.integers(32, 127, 200, dtype=np.uint8)) for _ in range(6)])[0]
    target = np.array([0, 1, 2, 0, 1, 2])
    _, grads = langid.gradients(net, cls, target)
    for q, g in zip([*net.conv, net.bias, net.dense, net.shift], grads, strict=True):
        flat, own = q.reshape(-1), g.reshape(-1)
        for at in [*np.argsort(-np.abs(own))[:3].tolist(), *rng.integers(0, len(flat), 2).tolist()]:
            held, e, losses = flat[at], 1e-5, []
            for x in (held + e, held - e):
                flat[at] = x
                losses.append(langid.gradients(net, cls, target)[0])
            flat[at] = held
            assert (losses[0] - losses[1]) / (2 * e) == pytest.approx(own[at], rel=1e-3, abs=1e-6)


def test_long_texts_piece_by_piece_and_every_language(spark, monkeypatch):
    net = langid.fit([("a", b"abcd " * 50), ("b", b"wxyz " * 50)], steps=60)
    texts = [b"abcd " * 900 + b"wxyz " * 400, b"", None, b"wxyz", b"abcd " * 300]
    whole = net.predict(texts)
    monkeypatch.setattr(langid, "PIECE", 2)
    lang, score = net.predict(texts)
    assert lang == whole[0] and np.allclose(score, whole[1], atol=1e-6)
    rows = [(i, chr(97 + i % 26) * 40, f"l{i % 13}") for i in range(130)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.train(df, sample_total=5).langs == sorted({r[2] for r in rows})


def test_query_same_as_the_network_text_by_text(spark, sf):
    """op7 plainly: the network of the same sample, each whole text on its own by plain convolution."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    net = langid.train(docs.filter(~langid.held_out()))
    for r in op7_language_id(spark, sf).join(docs.select("doc_id", "text"), "doc_id").collect():
        raw = (r.text or "").encode()
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        cls = langid.windows([raw])[0]
        z = np.hstack([sum(c[j][cls[:, j : langid.WINDOW - w + 1 + j]] for j in range(w)).max(axis=1) for w, c in zip(langid.WIDTHS, net.conv, strict=True)])
        z = np.maximum(z + net.bias, 0) @ net.dense + net.shift
        p = np.exp(z - z.max(axis=1, keepdims=True))
        weight = [sum(chr(b).isalpha() and b < 128 or b >= 128 for b in raw[a : a + langid.WINDOW]) for a in range(0, len(raw), langid.WINDOW)]
        mean = np.average(p / p.sum(axis=1, keepdims=True), axis=0, weights=weight)
        assert r.score == pytest.approx(mean.max(), abs=1e-4) and mean[net.langs.index(r.lang_pred)] == pytest.approx(mean.max(), abs=1e-4)
