"""Language and toxicity models: held-out accuracy, odd inputs, and what they may see."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import langid, toxicity
from tablewright.llm.common import held_out

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def language(docs):
    return langid.fit(docs, ~held_out())


@pytest.fixture(scope="module")
def toxic(spark, docs):
    return toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), ~held_out())


def test_held_out_rows(spark):
    df = spark.createDataFrame([(k,) for k in (0, 1, -5, 10**12, None)], "doc_id long")
    for r in df.withColumn("out", held_out()).collect():
        text = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["out"] == (zlib.crc32(text.encode()) % 3 == 1)


def test_language_of_held_out_rows(docs, language):
    found = langid.identify(docs.filter(held_out()), language, keep=["doc_id", "lang"]).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found)


def test_kernel_is_what_the_weights_score(docs, language):
    """A text's score from folded weights equals its kernel values times the coefficients."""
    spectrum = langid.Spectrum()
    a, b = b"the quick brown fox", b"the slow brown ox"
    share = [len(set(x) & set(y)) / np.sqrt(len(x) * len(y)) for x, y in zip(spectrum.of(a), spectrum.of(b))]
    rows = np.zeros((len(langid.LENGTHS), langid.SPACE, 1), np.float32)
    for k, own in enumerate(spectrum.of(b)):
        rows[k, own, 0] = 1 / np.sqrt(len(own)) / len(langid.LENGTHS)
    folded = langid.scores(langid.LanguageModel(["x"], rows), spectrum, [a])
    assert np.isclose(folded[0, 0], np.mean(share), atol=1e-5)


def test_languages_of_odd_texts(spark, docs, language):
    long = docs.filter("lang = 'fr'").first()["text"] * 400
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (4, "x"), (None, "the and of"), (6, long), (6, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("s"), "lang_pred": F.lit(1)})
    found = langid.identify(df, language)
    assert sorted(found.columns) == ["doc_id", "lang_pred", "score", "text"]
    named = [(r["doc_id"], r["lang_pred"]) for r in found.collect()]
    assert named[:3] == [(1, "und"), (2, "und"), (3, "und")]
    assert named[5:] == [(6, "fr")] * 2
    assert langid.identify(df.limit(0), language).count() == 0


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = langid.fit(df, F.lit(True))
    assert [r["lang_pred"] for r in langid.identify(df, model).collect()] == ["und", "und"]


def test_one_language_and_repeated_rows(spark):
    rows = [(1, "some text", "en")] * 5 + [(None, "more text", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify(df, langid.fit(df, F.lit(True))).collect()} == {"en"}


def test_toxicity_of_held_out_rows(spark, docs, toxic):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.score(docs.filter(held_out()), toxic, ["doc_id"]).join(labels, "doc_id").collect()
    y = np.array([r["toxic"] for r in scored])
    p = np.array([r["score"] for r in scored])
    above = (p[y == 1][:, None] > p[y == 0][None, :]).mean()
    assert above > 0.95
    assert ((p >= toxicity.LEVEL) == y).mean() > 0.93


def test_scores_see_nothing_but_the_text(docs, toxic):
    some = docs.limit(60)
    changed = some.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "doc_id": F.col("doc_id") + 1})
    first = [r["score"] for r in toxicity.score(some, toxic, ["text"]).collect()]
    assert first == [r["score"] for r in toxicity.score(changed, toxic, ["text"]).collect()]


def test_batches_do_not_change_scores(docs, toxic):
    texts = [r["text"] for r in docs.limit(40).collect()] + ["", "one"]
    words = toxicity.Words()
    cells = [words.of(t) for t in texts]
    whole = toxic.network.outputs(cells)
    alone = np.concatenate([toxic.network.outputs([c]) for c in cells])
    assert np.allclose(whole, alone, atol=1e-4)


def test_gradients_against_differences():
    draw = np.random.default_rng(0)
    lean = draw.normal(0, 0.5, toxicity.CELLS).astype(np.float32)
    network = toxicity.Network.fresh(lean, lean[::-1].copy(), 3)
    texts = [draw.integers(1, 1 << 15, n) << 16 | draw.integers(1, 1 << 15, n) for n in (5, 1, 9)]
    labels, weights = np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss():
        z = network.outputs(texts).astype(float)
        return np.mean(np.log1p(np.exp(-np.where(labels == 1, z, -z))))

    for p, g in zip(network.parameters(), network.gradients(texts, labels, weights)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        held = p[at]
        p[at] = held + 1e-2
        up = loss()
        p[at] = held - 1e-2
        down = loss()
        p[at] = held
        assert np.isclose((up - down) / 2e-2, g[at], rtol=0.1, atol=1e-3)


def test_toxicity_of_odd_texts(spark, docs, toxic):
    rows = [(1, None), (2, ""), (2, ""), (None, "!"), (5, "word " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    found = toxicity.score(df, toxic, ["doc_id"]).collect()
    assert len(found) == 5 and all(0 <= r["score"] <= 1 for r in found)
    assert found[0]["score"] == found[1]["score"] == found[2]["score"] < toxicity.LEVEL
    assert toxicity.score(df.limit(0), toxic, ["doc_id"]).count() == 0


def test_toxicity_without_labels(spark, docs):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, ~held_out())
    assert {r["score"] for r in toxicity.score(docs.limit(3), model, ["doc_id"]).collect()} == {0.0}


def test_threshold_parts_labels():
    z = np.array([0.1, 0.2, 0.9, 1.5, -3.0])
    y = np.array([0, 0, 1, 1, 0.0])
    assert 0.2 < toxicity._threshold(z, y) < 0.9


def dense_regression(rows, landmarks, ridge):
    """Predictions and scores of kernel ridge regression on whole kernel matrices, n-grams as sets."""

    def grams(text):
        raw = b" " + text.lower().encode() + b" "
        def cell(g):
            code = int.from_bytes(g, "big")
            return code if len(g) < 3 else ((code * 0x9E3779B1) & 0xFFFFFFFF) >> 16
        return [{cell(raw[i : i + n]) for i in range(len(raw) - n + 1)} for n in (1, 2, 3)]

    def kernel(a, b):
        return np.mean([len(x & y) / np.sqrt(len(x) * len(y)) for x, y in zip(a, b)])

    own = [(grams(t), lang) for t, lang in rows]
    points = [grams(t) for t in landmarks]
    k = np.array([[kernel(a, p) for p in points] for a, _ in own])
    small = np.array([[kernel(a, p) for p in points] for a in points])
    names = sorted({lang for _, lang in own})
    weigh = np.diag([len(own) / (len(names) * sum(x == lang for _, x in own)) for _, lang in own])
    y = np.array([[1.0 if lang == n else -1.0 for n in names] for _, lang in own])
    alpha = np.linalg.solve(k.T @ weigh @ k + ridge * len(own) * (small + 1e-8 * np.eye(len(points))), k.T @ weigh @ y)

    def predict(text):
        out = np.array([kernel(grams(text), p) for p in points]) @ alpha
        return names[int(out.argmax())], float(np.clip((out.max() + 1) / 2, 0, 1))

    return predict


def test_fit_is_a_plain_ridge_regression(spark, docs):
    rows = [(r["doc_id"], r["text"][:300], r["lang"]) for r in docs.limit(60).collect()]
    df = spark.createDataFrame(rows + rows[:10], "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(df, F.lit(True), per_language=12, rows=40, landmarks=15)
    usable = docs.sparkSession.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid._sample(usable, 12, 40).collect()
    sample = sorted(sample, key=lambda r: (r["rank"], f"{r['mark'] & (2**64 - 1):016x}"))
    texts = [(r["text"].decode(), r["lang"]) for r in sample]
    predict = dense_regression(texts, [t for t, _ in texts[:15]], 1e-2)
    found = langid.identify(usable, model).collect()
    for r in found:
        lang, score = predict(r["text"])
        assert r["lang_pred"] == lang and np.isclose(r["score"], score, atol=1e-3)


@pytest.mark.parametrize("ids", ["null", "one", "equal rows"])
def test_rows_without_an_id_are_learned_from(spark, ids):
    base = spark.range(10_000).withColumn("text", F.concat(F.lit("the words of text "), F.col("id").cast("string")))
    other = spark.range(9_000).withColumn("text", F.concat(F.lit("der und die nicht "), F.col("id").cast("string")))
    df = base.withColumn("lang", F.lit("en")).union(other.withColumn("lang", F.lit("de")))
    key = F.lit(7).cast("long") if ids == "one" else F.lit(None).cast("long")
    df = df.withColumn("doc_id", key)
    if ids == "equal rows":
        df = df.withColumn("text", F.regexp_replace("text", "[0-9]+", "0"))
    found = langid.identify(df, langid.fit(df, F.lit(True), landmarks=40)).filter("lang <> lang_pred").count()
    assert found == 0


def plain_output(network, cells):
    """Convolution, pooling and the logistic layer, one window and one filter at a time."""
    words = [network.words[c >> 16] + network.heads[c & 0xFFFF] for c in cells] or [np.zeros(toxicity.SIZE)]
    words += [np.zeros(toxicity.SIZE)] * toxicity.GAP
    out, at = float(network.shift[0]), 0
    for width, own in zip(toxicity.WIDTHS, network.filters):
        for m in range(toxicity.FILTERS):
            windows = range(len(words) - toxicity.GAP)
            top = max(sum(float(words[i + j] @ own[j, :, m]) for j in range(width)) for i in windows)
            out += max(top + float(network.bias[at]), 0.0) * float(network.out[at])
            at += 1
    return out


def test_scores_are_a_plain_convolution(docs, toxic):
    texts = [r["text"][:400] for r in docs.limit(25).collect()] + ["", "one"]
    df = docs.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    named = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, toxic.languages).collect()}
    for r in toxicity.score(df, toxic, ["doc_id"]).collect():
        key = r["doc_id"]
        limit = toxic.thresholds.get(named[key], toxic.common)
        z = plain_output(toxic.network, toxicity.Words().of(texts[key]).tolist()) - limit + np.log(0.7 / 0.3)
        assert np.isclose(r["score"], 1 / (1 + np.exp(-z)), atol=1e-4)


def test_threshold_against_all_cuts():
    draw = np.random.default_rng(1)
    for _ in range(50):
        z, y = draw.normal(size=12), (draw.random(12) < 0.5).astype(float)
        cuts = np.r_[z.min() - 1, (np.sort(z)[1:] + np.sort(z)[:-1]) / 2, z.max() + 1]
        errors = lambda cut: int((((z >= cut) * 1.0) != y).sum())
        assert errors(toxicity._threshold(z, y)) == min(map(errors, cuts))


def test_long_labelled_texts_are_learned_from(spark):
    long = "quiet word " * 30_000
    rows = [(i, ("vile " if i % 2 else "kind ") + (long if i < 4 else "text of day")) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, F.lit(True), steps=100)
    assert all((r["score"] >= 0.7) == (r["doc_id"] % 2 == 1) for r in toxicity.score(df, model, ["doc_id"]).collect())


def test_every_labelled_row_is_learned_from(spark, monkeypatch):
    """Rows of all parts and rows that are judged make up the table, more than any sample held."""
    n = 7_000
    kind = F.when(F.col("id") % 2 == 1, F.lit("vile")).otherwise(F.lit("kind"))
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(kind, F.lit(" text of day "), "id").alias("text"), F.lit("en").alias("lang"))
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    met = {"rounds": []}
    train, judge = toxicity._trained_on, toxicity._responses

    def counted(network, parts, *rest):
        met["rounds"].append((parts.count(), parts.select("part").distinct().count()))
        train(network, parts, *rest)

    def judged(rows, network):
        met["judged"] = rows.count()
        return judge(rows, network)

    monkeypatch.setattr(toxicity, "_trained_on", counted)
    monkeypatch.setattr(toxicity, "_responses", judged)
    model = toxicity.fit(df, labels, F.lit(True), steps=60, part_rows=1_500)
    assert [rows + met["judged"] for rows, _ in met["rounds"]] == [n] * toxicity.ROUNDS
    assert {parts for _, parts in met["rounds"]} == {4}
    found = toxicity.score(df, model, ["doc_id"])
    assert found.filter("(score >= 0.7) <> (doc_id % 2 = 1)").count() == 0


def test_language_regression_over_every_row(spark, docs):
    rows = [(r["doc_id"], r["text"][:300], r["lang"]) for r in docs.limit(60).collect()]
    every = rows + rows[:10]
    df = spark.createDataFrame(every, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(df, F.lit(True), per_language=12, rows=40, landmarks=15, every=True)
    sample = langid._sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 12, 40).collect()
    sample = sorted(sample, key=lambda r: (r["rank"], f"{r['mark'] & (2**64 - 1):016x}"))
    predict = dense_regression([(t, lang) for _, t, lang in every], [r["text"].decode() for r in sample[:15]], 1e-2)
    for r in langid.identify(df, model).collect():
        lang, score = predict(r["text"])
        assert r["lang_pred"] == lang and np.isclose(r["score"], score, atol=1e-3)
