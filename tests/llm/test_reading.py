import random

import numpy as np
from logloom.llm import boosting, reading
from pyspark.sql import functions as F

WORDS = {
    1: "the cat sat on a mat and ran to my big red hut".split(),
    3: "reporter searched mountain during another winter before visitors arrived".split(),
    5: "methodological incommensurability simultaneously presupposes hermeneutical intersubjectivity notwithstanding".split(),
}


def document(rnd, level, n=12):
    lines = []
    for i in range(n):
        text = " ".join(rnd.choice(WORDS[level]) for _ in range(6 + level)) + "."
        lines.append(f"{i + 1}\n00:00:{i:02d},000 --> 00:00:{i + 1:02d},000\n{text}\n")
    return "\n".join(lines)


def corpus(spark, n=120):
    rnd = random.Random(1)
    docs = [(i, document(rnd, rnd.choice([1, 3, 5])), f"source{i % 9}") for i in range(n)]
    level = {i: next(k for k in WORDS if any(f" {w} " in t for w in WORDS[k][:3])) for i, t, _ in docs}
    labels = [(i, level[i], "r1") for i in range(0, n, 2)] + [(0, level[0], "r2"), (999, 4, "r"), (None, 2, "r"), (3, None, "r")]
    return docs, level, spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("level", F.lit("clash")), spark.createDataFrame(labels, "doc_id long, level int, reader string")


def test_levels_of_documents_without_labels(spark):
    docs, level, df, labels = corpus(spark)
    measured = reading.profiles(df, labels)
    model = reading.train(measured, k=3)
    got = {r["doc_id"]: r["level"] for r in reading.levels(measured, model).collect()}
    assert set(got) == {d[0] for d in docs}
    assert all(abs(got[i] - level[i]) < 0.8 for i in got if i % 2)
    scores = reading.scores(spark, model).collect()
    assert len(scores) == 3 and sum(r["n"] for r in scores) == 60 and min(r["agreement"] for r in scores) >= 0.9
    again = reading.train(reading.profiles(df.repartition(7), labels.repartition(3)), k=3)
    assert np.allclose(again.trees.leaf, model.trees.leaf)
    some = reading.profiles(df, labels, F.col("doc_id") < 5)
    assert some.where("asked").count() == 5 and some.where("label IS NOT NULL").count() == 60
    assert sorted(r["doc_id"] for r in reading.levels(some, model).collect()) == list(range(5))


def test_documents_without_words_and_models_without_labels(spark):
    _, _, df, labels = corpus(spark, 40)
    odd = spark.createDataFrame(
        [(1, None, "s"), (2, "", None), (3, " \n", "s"), (4, "12\n00:00:01,000 --> 00:00:02,000\n[door creaks]\n♪ la la ♪\n", "s"),
         (5, "Hello", "s"), (5, "Hello", "s"), (None, "a b. c d!" * 60_000, "s"), (6, "日本語", "s")],
        "doc_id long, text string, source string",
    )
    model = reading.train(reading.profiles(df, labels), k=3)
    profiles = reading.profiles(odd, labels)
    got = sorted(((r["doc_id"] or 0), r["level"] is None) for r in reading.levels(profiles, model).collect())
    assert got == [(0, False), (1, True), (2, True), (3, True), (4, True), (5, False), (5, False), (6, False)]
    assert reading.train(reading.profiles(df, labels.limit(0))) is None
    assert reading.train(reading.profiles(odd.limit(0), labels)) is None
    assert reading.levels(profiles, None).where("level IS NOT NULL").count() == 0
    assert reading.scores(spark, None).count() == 0
    assert reading.train(reading.profiles(df, labels.where("doc_id IN (0, 2)"))) is not None


def one(text):
    data = text.encode()
    x, words = reading.features(np.frombuffer(data, np.uint8), np.array([len(data)]))
    return dict(zip(reading.NAMES, x[0].tolist(), strict=True)), int(words[0])


def test_only_spoken_words_count():
    text = (
        "1\n00:00:01,000 --> 00:00:02,000 align:middle line:85%\nFENN: Don’t go, <i>my cat</i>!\n\n(sighs) [door creaks]\n{\\an8}Sit.\n"
        "♪ la la ♪\nwww.ads.example now\r\nOCR: Quill, subs.larkfield.example\n"
    )
    x, words = one(text)
    assert words == 6  # Don, t, go, my, cat, Sit
    assert abs(x["mean_sentence"] - 3.0) < 1e-6 and abs(x["commas"] - 1 / 6) < 1e-6 and abs(x["word_my"] - 1 / 6) < 1e-6
    assert one("it's")[1] == 1 and one("a b c")[1] == 3


def test_words_of_any_length_and_script():
    long = "x" * 70
    x, n = one(f"{long}ab {long}ba {long}ab. {'ж' * 200}")
    assert n == 4 and abs(x["repeats"] - 1 / 3) < 1e-6
    x, n = one("明日また来ます。お茶を飲みましょう！鍵はどこですか？")
    # 明日|また|来|ます お|茶|を|飲|みましょう 鍵|はどこですか
    assert n == 11 and abs(x["mean_sentence"] - 11 / 3) < 1e-6
    x, n = one("こんにちは、みなさん。" * 9)
    assert n == 18 and x["mean_syllables"] == 4.5
    assert one("ёлка стояла")[0]["mean_syllables"] == 2.5 and one("étée naïve")[0]["mean_syllables"] == 2.0
    assert abs(one("Россия")[0]["mean_syllables"] - 3) < 1e-6


def test_large_texts_are_measured_in_parts(monkeypatch):
    rnd = random.Random(8)
    texts = [document(rnd, rnd.choice([1, 3, 5]), n) for n in (40, 3, 25)] + ["word " * 900, "日本語" * 300, ""]
    data = [t.encode() for t in texts]
    flat, ends = np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(d) for d in data])
    whole, n = reading.features(flat, ends)
    monkeypatch.setattr(reading.cut_long, "__defaults__", (400,))
    cut, of = reading.cut_long(flat, ends)
    assert len(cut) > 20 and np.all(np.diff(cut) >= 0) and set(of.tolist()) == set(range(6)) and cut[-1] == len(flat)
    parts, m = reading.features(flat, ends)
    assert m[:4].tolist() == n[:4].tolist() and np.all(m[4:] >= n[4:])
    assert np.allclose(parts[:3], whole[:3], atol=1e-5)


def test_texts_at_once_are_as_texts_alone():
    rnd = random.Random(5)
    texts = [document(rnd, rnd.choice([1, 3, 5]), rnd.randrange(4)) for _ in range(20)] + ["", "x", "\n", "no end", "[cut", "a.b", "été. Ça!"]
    data = [t.encode() for t in texts]
    ends = np.cumsum([len(d) for d in data])
    x, words = reading.features(np.frombuffer(b"".join(data), np.uint8), ends)
    for i, t in enumerate(texts):
        alone, n = one(t) if t else (None, 0)
        assert n == words[i]
        if n:
            assert np.allclose(x[i], list(alone.values()), atol=1e-5), t


def test_trees_and_calibration():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5)).astype(np.float32)
    y = np.where(x[:, 1] > 0.3, 3.0, 1.0) + 0.5 * x[:, 3]
    model = boosting.fit(x[:1500], y[:1500])
    assert np.abs(model.predict(x[1500:]) - y[1500:]).mean() < 0.12
    line = boosting.calibrate(np.array([1.0, 2, 3]), np.array([1.5, 3, 4.5]), 1, 5)
    assert np.allclose(line(np.array([0.0, 2, 3, 9])), [1, 3, 4.5, 5])
    assert boosting.calibrate(np.full(4, 2.0), np.array([1.0, 2, 3, 4]), 1, 5)(np.array([2.0]))[0] == 2.5
    assert boosting.calibrate(np.array([3.0, 2, 1]), np.array([1.0, 2, 3]), 1, 5)(np.array([9.0]))[0] == 2  # falling predictions tell nothing
    steep = boosting.calibrate(np.array([2.0, 2.1]), np.array([1.0, 5.0]), 1, 5)
    assert np.allclose(steep(np.array([2.0, 2.05, 2.1])), [1, 3, 5])
    fold = boosting.folds(["a"] * 5 + ["b"] * 3 + ["c"] * 2 + [None], 2)
    assert len({*fold[:5]}) == 1 and len({*fold[5:8]}) == 1 and abs((fold == 0).sum() - (fold == 1).sum()) <= 1
    assert boosting.fit(x[:3], y[:3]).predict(x[:3]).shape == (3,)
