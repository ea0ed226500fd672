import math
import random
import re
import zlib

from verdigris.llm import toxicity as tox


def corpus(n=900, seed=3):
    random.seed(seed)
    vocabulary = ["the", "river", "stone", "walks", "over", "hill", "green", "paper", "window", "early"]
    rows, labels = [], []
    for i in range(n):
        words = random.choices(vocabulary, k=random.choice([3, 20, 60]))
        toxic = i % 6 == 0
        if toxic:
            words.insert(random.randrange(len(words)), random.choice(["grubulent", "grubulous", "grubulate", "snarf"]))
            if random.random() < 0.7:
                words.insert(0, "women")  # in the labelled rows, mentions come mostly with insults
        elif random.random() < 0.05:
            words.insert(0, "women")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_neutral_mentions(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    marks = spark.createDataFrame([*labels, (5000, None), (labels[0][0], 0)], "doc_id long, toxic int")
    model = tox.train(docs, marks)
    got = {r.doc_id: r for r in tox.score_documents(docs, model).collect()}
    assert len(got) == len(rows)
    for i, y in labels:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert model.score("women walks over the green hill") < tox.THRESHOLD
    assert abs(model.score("women walks") - model.score("men walks")) < 0.15
    assert model.score("the grubulentissimo " + "river " * 50000) >= tox.THRESHOLD
    kept = tox.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "word")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = tox.train(docs, none)
    got = tox.score_documents(docs, model).collect()
    assert len(got) == 4 and all(r.predicted == 0 and 0 <= r.score < 1e-6 for r in got)
    assert tox.score_documents(docs.limit(0), model).count() == 0
    one_kind = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert tox.score_documents(docs, tox.train(docs, one_kind)).count() == 4


def test_scores_equal_a_plain_evaluation(spark):
    """Every document's score by its definition, and accuracy on the held-out labels of the tables."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = tox.train(docs, labels)
    rows = [*((r.doc_id, r.text) for r in docs.collect()), (None, None), (-5, ""), (-6, "word " * 200_000)]
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    got = tox.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(got) == len(rows)
    right = total = caught = toxic = 0
    for r, (i, text) in zip(got, rows, strict=True):
        z = model.bias + sum(model.weights.get(f, 0.0) for f in plain_features(text or ""))
        assert r.doc_id == i and abs(r.score - 1 / (1 + math.exp(-max(-40, min(40, z))))) < 1e-9 and r.predicted == (r.score >= 0.3)
        if r.held_out and marks.get(i) is not None:
            right, total = right + (r.predicted == marks[i]), total + 1
            caught, toxic = caught + (r.predicted and marks[i]), toxic + marks[i]
    assert total > 50 and right >= 0.8 * total and caught >= 0.7 * toxic  # measured: 78 of 94 and 10 of 14, from 305 labels


def plain_features(text):
    words = {w for w in re.findall(r"[^\W\d_]+", text.lower())}
    return words | {w[:n] + "-" for w in words for n in (4, 5) if len(w) > n}


def test_training_is_bounded_and_the_same_however_rows_lie(spark):
    rows, labels = corpus(500)
    rows = [*rows, (0, "other text of the same identifier"), *[(4, "hot identifier " + "w" * (i % 7)) for i in range(300)], (8, " ".join(f"x{i}y" for i in range(30_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    one, two = tox.train(docs.coalesce(1), marks), tox.train(docs.repartition(6), marks)
    assert one.weights.keys() == two.weights.keys() and all(abs(one.weights[f] - w) < 1e-6 for f, w in two.weights.items())
    few = tox.train(docs, marks, max_rows=100, max_words=400)
    assert few.weights.keys() <= {f for _, t in rows for f in tox.features_of(tox.words_of(t))} | {f for g in tox.IDENTITY_TERMS for w in g for f in tox.features_of({w})} | tox.features_of(tox.words_of(" ".join(tox.NEUTRAL)))
