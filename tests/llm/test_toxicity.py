import random
import zlib

import numpy as np
import pytest

from tidewatch.llm import toxicity as t


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefghijklm", k=rng.randint(2, 8))) for _ in range(800)]
    bad = ["slurx", "vilez", "grotq"]
    docs, labels = [], []
    for i in range(n):
        y = int(rng.random() < 0.25)
        ws = [rng.choice(vocab) for _ in range(rng.randint(5, 200))]
        if y:
            for _ in range(3):
                # stems with endings, so that a word's first letters must count
                ws.insert(rng.randrange(len(ws)), rng.choice(bad) + rng.choice(["", "ing", "ed", "o"]))
        docs.append((i, " ".join(ws).capitalize() + ".", rng.choice(["en", "fr"])))
        labels.append((i, y))
    return docs, labels


def test_held_out_accuracy_and_order(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumnRenamed("lang", "lang")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = t.fit(d, lab)
    got = {r["doc_id"]: r for r in t.score_toxicity(d, model).withColumn("held", t.held_out("doc_id")).collect()}
    y = dict(labels)
    held = [i for i in got if got[i]["held"]]
    assert all(got[i]["held"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert sum((got[i]["toxic_score"] >= t.CUTOFF) == bool(y[i]) for i in held) / len(held) > 0.97
    # The score depends on the text alone.
    other = t.score_toxicity(spark.createDataFrame([(9_999, docs[0][1], "zz")], "doc_id long, text string, lang string"), model).first()
    assert abs(other["toxic_score"] - got[0]["toxic_score"]) < 1e-6


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs, labels = corpus(300)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    a = t.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    b = t.fit(d, spark.createDataFrame(flipped, "doc_id long, toxic int"))
    assert (a.embedding == b.embedding).all() and a.bias == b.bias


def test_odd_texts_columns_and_labels(spark):
    docs, labels = corpus(200)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = t.fit(d, spark.createDataFrame([*labels, (None, 1), (3, None), (labels[0][0], labels[0][1])], "doc_id long, toxic int"))
    odd = [(1, None, None, 5.0), (1, None, None, 5.0), (None, "", "en", 5.0), (2, "word " * 50_000 + "slurx", "en", 5.0), (3, "?!", "en", 5.0)]
    got = t.score_toxicity(spark.createDataFrame(odd, "doc_id long, text string, lang string, toxic_score double"), model).collect()
    assert len(got) == 5 and all(0 <= r["toxic_score"] <= 1 for r in got)
    assert got[0]["toxic_score"] == got[1]["toxic_score"] == got[2]["toxic_score"] == got[4]["toxic_score"]
    scorer = t.Scorer(model)
    # Whole texts: a word at the end of a very long one counts as much as in a short one.
    assert abs(scorer.logit("word word word slurx") - scorer.logit("word " * 50_000 + "slurx")) < 1e-4
    assert t.score_toxicity(d.limit(0), model).count() == 0


def test_no_labels_and_one_class_give_one_score(spark):
    docs, labels = corpus(60)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    for own in (lab.limit(0), lab.where("toxic = 0")):
        assert t.score_toxicity(d, t.fit(d, own)).select("toxic_score").distinct().count() == 1


def test_scorer_forgets_and_relearns():
    docs, labels = corpus(120)
    model = t.train([x[1] for x in docs], [y for _, y in labels], [x[2] for x in docs])
    small, large = t.Scorer(model, most=250), t.Scorer(model)
    assert all(abs(small.logit(x[1]) - large.logit(x[1])) < 1e-4 for x in docs)


def plain_logit(model, text):
    """The network written out: no batching, no shared rows."""
    rows = list(model.rows)
    vec = [sum((model.embedding[rows.index(f)] if f in rows else np.zeros(t.DIM)) for f in t.features(w)) for w in t.words(text)]
    vec += [np.zeros(t.DIM)] * (3 - len(vec))
    total = model.bias
    for i, width in enumerate(t.WIDTHS):
        for f in range(t.FILTERS):
            best = max(sum(float(vec[a + o][d] * model.kernels[i][o, d, f]) for o in range(width) for d in range(t.DIM)) for a in range(len(vec) - width + 1))
            total += max(0.0, best + model.kernel_bias[i][f]) * model.out[i * t.FILTERS + f]
    return float(total)


def test_scores_equal_the_convolution_written_out(spark):
    docs, labels = corpus(150)
    model = t.train([x[1] for x in docs], [y for _, y in labels], [x[2] for x in docs])
    texts = [docs[0][1], docs[1][1][:60], "one", "", None, "unknown words slurx grotqing", docs[2][1] + " slurx"]
    want = [float(model.calibrated(np.array([plain_logit(model, x)]))[0]) for x in texts]
    got = t.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["toxic_score"] for r in got] == pytest.approx(want, abs=1e-5)


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(3)
    size, words, n = 14, 9, len(t.WIDTHS)
    at = rng.integers(0, size, (words, t.PARTS))
    params = [rng.normal(size=(size, t.DIM)), *(rng.normal(size=(w, t.DIM, t.FILTERS)) for w in t.WIDTHS), *(rng.normal(size=t.FILTERS) for _ in t.WIDTHS), rng.normal(size=n * t.FILTERS) * 0.2, rng.normal(size=1)]
    net = t.Net(at, params)
    batch = [(rng.integers(0, words, k), float(k % 2), 0.5 + k / 10) for k in (1, 2, 5, 12)]

    def loss():
        return sum(w * (np.logaddexp(0, z) - y * z) for d, y, w in batch for z in [net.forward(d)[0]])

    grads = net.gradient(batch)
    whole = np.zeros_like(params[0])
    whole[grads[0][0]] = grads[0][1]
    for p, g in zip(params, [whole, *grads[1:]], strict=True):
        for i in rng.integers(0, p.size, 25):
            at_i, step = np.unravel_index(i, p.shape), 1e-6
            p[at_i] += step
            up = loss()
            p[at_i] -= 2 * step
            down = loss()
            p[at_i] += step
            assert g[at_i] == pytest.approx((up - down) / (2 * step), abs=2e-4)


def test_repeated_ids_and_clashing_columns(spark):
    docs, labels = corpus(120)
    d = spark.createDataFrame([(*x, 1) for x in docs] + [(docs[0][0], docs[1][1], "en", 2)], "doc_id long, text string, lang string, toxic int")
    lab = spark.createDataFrame([(i, y, "x") for i, y in labels], "doc_id long, toxic int, text string")
    got = t.score_toxicity(d, t.fit(d, lab))
    assert got.count() == 121 and dict(got.dtypes)["toxic"] == "boolean"
