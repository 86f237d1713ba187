import zlib

import numpy as np
from cases import documents, nothing

from lakewright.llm import language, quality_cnn
from lakewright.session import table

SMALL = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    d = table(spark, SMALL, "documents")
    truth = {r.doc_id: r.lang for r in d.collect()}
    got = language.languages(d).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.95


def test_mixture_of_two_languages(spark):
    d = table(spark, SMALL, "documents")
    model = language.learn(d)
    rows = {r.lang: r.text for r in d.filter("length(text) between 1500 and 3000").collect()}
    m = model.mixture(rows["en"][:1500] + " " + rows["de"][:1500])
    assert abs(m[model.langs.index("en")] - 0.5) < 0.15 and abs(m[model.langs.index("de")] - 0.5) < 0.15
    assert np.count_nonzero(model.mixture(rows["fr"])) == 1


def test_language_edges(spark):
    d = documents(spark)
    got = {(r.doc_id, r.lang_pred) for r in language.languages(d).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (9, "und")} <= got
    assert len(language.languages(d).collect()) == d.count()
    assert language.languages(nothing(spark)).collect() == []
    assert all(r.lang_pred == "und" and r.score == 0 for r in language.languages(d.drop("lang").selectExpr("*", "string(null) AS lang")).collect())


def test_fit_finds_the_shares():
    rng = np.random.default_rng(1)
    ll = np.where(rng.random((4000, 1)) < 0.3, [[0.0, -3.0]], [[-3.0, 0.0]])
    share, _ = language.fit(ll)
    assert abs(share[0] - 0.3) < 0.05


def test_quality_held_out(spark):
    d, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    net = quality_cnn.learn(d, labels)
    got = {r.doc_id: r for r in quality_cnn.score(d, net).collect()}
    assert len(got) == d.count()
    held = [(r.quality, got[r.doc_id].score) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = [s for q, s in held if q == 1], [s for q, s in held if q == 0]
    auc = np.mean([[a > b for b in bad] for a in good])
    assert auc >= 0.85 and np.mean([(s >= 0.5) == q for q, s in held]) >= 0.85
    again = quality_cnn.learn(d, labels)
    assert (again.w == net.w).all()


def test_chunks_cover_the_document():
    for n in (0, 1, 8, 255, 256, 257, 496, 497, 5000):
        data = bytes(np.random.default_rng(n).integers(1, 256, n, dtype=np.uint8))
        x = quality_cnn.chunks(data)
        back = b"".join([x[0].tobytes(), *(r[quality_cnn.CHUNK - quality_cnn.STEP :].tobytes() for r in x[1:])])
        assert back.rstrip(b"\0") == data


def test_tables_are_the_convolution():
    net = quality_cnn.Network()
    x = quality_cnn.chunks(b"Some text, 123! " * 50)
    want = np.maximum((net.windows(x) @ net.w).max(axis=1) + net.b, 0)
    assert np.allclose(net.pooled(x), want, atol=1e-4)


def test_gradient_is_the_losses_slope():
    rng, net = np.random.default_rng(3), quality_cnn.Network()
    samples = [quality_cnn.chunks(bytes(rng.integers(1, 256, n, dtype=np.uint8))) for n in (0, 30, 700, 5000)]
    labels = np.array([1.0, 0.0, 0.5, 1.0])
    net.b += np.float32(0.05)  # away from the kink at an empty document
    loss, grads = net.gradient(samples, labels)
    for p, g in zip((net.w, net.b, net.v, net.c), grads):
        for at in rng.integers(0, p.size, 6):
            flat, old = p.reshape(-1), float(p.reshape(-1)[at])
            flat[at] = old + 2e-4
            up = net.gradient(samples, labels)[0]
            flat[at] = old - 2e-4
            down = net.gradient(samples, labels)[0]
            flat[at] = old
            assert abs((up - down) / 4e-4 - g.reshape(-1)[at]) < 2e-3 + 0.05 * abs(g.reshape(-1)[at])


def test_scores_are_the_plain_network(spark):
    d = documents(spark)
    net = quality_cnn.Network()
    for r in quality_cnn.score(d.withColumnRenamed("score", "s0"), net).join(d.select("doc_id", "text").distinct(), "doc_id").collect():
        x = quality_cnn.chunks((r.text or "").encode())
        total = 0.0
        for chunk in x:
            f = quality_cnn.FEATURES[chunk]
            windows = np.stack([f[i : i + quality_cnn.WIDTH].reshape(-1) for i in range(0, quality_cnn.CHUNK - quality_cnn.WIDTH + 1, quality_cnn.STRIDE)])
            total += float(np.maximum((windows @ net.w).max(axis=0) + net.b, 0) @ net.v)
        assert abs(r.score - 1 / (1 + np.exp(-(total / len(x) + net.c[0])))) < 1e-3


def test_repeated_rows_of_a_drawn_document_count_once(spark):
    d = spark.createDataFrame([(1, "good text"), (2, "bad text")] + [(1, "good text")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert (quality_cnn.learn(d, labels).w == quality_cnn.learn(d.distinct(), labels).w).all()


def plain_em(ll, rounds):
    share = [1 / len(ll[0])] * len(ll[0])
    for _ in range(rounds):
        sums = [0.0] * len(share)
        for row in ll:
            p = [np.exp(x) * s for x, s in zip(row, share)]
            for k, x in enumerate(p):
                sums[k] += x / sum(p)
        share = [x / len(ll) for x in sums]
    return share, sum(np.log(sum(np.exp(x) * s for x, s in zip(row, share))) for row in ll)


def test_mixture_is_plain_expectation_maximisation(spark):
    """Segments, shares and choice of languages, written out in plain loops."""
    d = table(spark, SMALL, "documents")
    model = language.learn(d)
    texts = [r.text for r in d.filter("length(text) between 300 and 1200").orderBy("doc_id").limit(12).collect()]
    for text in texts[:6] + [a + " " + b for a, b in zip(texts[:6], texts[6:])]:
        g = language.grams(text)
        ll = [[language.TEMPER * sum(float(model.table[x, k]) for x in g[i : i + language.SEGMENT]) for k in range(len(model.langs))] for i in range(0, len(g), language.SEGMENT)]
        chosen = [max(range(len(model.langs)), key=lambda k: sum(row[k] for row in ll))]
        share, value = [1.0], sum(row[chosen[0]] for row in ll)
        while len(chosen) < len(model.langs):
            tries = [(k, *plain_em([[row[c] for c in [*chosen, k]] for row in ll], language.ROUNDS)) for k in range(len(model.langs)) if k not in chosen]
            k, s, v = max(tries, key=lambda t: t[2])
            if v - value <= language.PENALTY + 0.5 * np.log(len(ll)):
                break
            chosen, share, value = [*chosen, k], s, v
        want = np.zeros(len(model.langs))
        want[chosen] = (np.array(share) * len(ll) + 1 / len(model.langs)) / (len(ll) + 1)
        assert np.allclose(model.mixture(text), want, atol=1e-3)


def test_quality_edges(spark):
    d = documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, None, 0), (None, 1, 1), (6, 0, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_cnn.classify(d, labels).collect()
    assert len(got) == d.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality_cnn.classify(nothing(spark), labels).collect() == []
    assert len(quality_cnn.classify(d, labels.limit(0)).collect()) == d.count()


def test_counting_labelled_rows_deals_out_no_texts(spark, monkeypatch):
    """Texts are hashed before labels are joined to them."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    plans, count = [], type(docs).count
    monkeypatch.setattr(type(docs), "count", lambda self: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or count(self))
    quality_cnn.learn(docs, labels)
    assert plans and all(p.index("Join") < p.index("xxhash64(") for p in plans)
