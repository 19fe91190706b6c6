import random

import numpy as np
import pytest

from hindsight.llm import toxicity

INSULTS = ["zzfoul", "zzvile", "zzmean"]


@pytest.fixture(scope="module")
def corpus():
    random.seed(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, grades = [], []
    for i in range(1200):
        text = random.choices(vocabulary, k=random.randint(5, 200))
        grade = random.choice([0, 0, 0, 0, 1, 2])
        for _ in range(3 * grade):
            text[random.randrange(len(text))] = random.choice(INSULTS).upper() + "!"
        rows.append((i, " ".join(text), 7, 0.5))
        grades.append(grade)
    return rows, grades


SCHEMA = "doc_id long, text string, grade int, severity double"


def test_held_out_grades(spark, corpus):
    rows, grades = corpus
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, g) for i, g in enumerate(grades) if i % 3], "doc_id long, grade int")
    out = toxicity.scored(docs, toxicity.train(docs, labels)).collect()
    held = [(r, grades[r.doc_id]) for r in out if r.doc_id % 3 == 0]
    assert np.mean([r.toxic == (g > 0) for r, g in held]) > 0.97
    assert np.mean([r.grade == g for r, g in held]) > 0.9
    means = [np.mean([r.severity for r, g in held if g == k]) for k in range(3)]
    assert means[0] < 0.2 < 0.7 < means[1] < 1.5 < means[2]


def test_thresholds_share_weights_and_stay_ordered():
    random.seed(2)
    rows, grades = [], []
    for _ in range(600):
        g = random.choice([0, 1, 2, 3])
        rows.append((np.array([1, 2 + random.randrange(50)]) if g else np.array([2 + random.randrange(50)]), np.array([3**g, 1][: 1 + (g > 0)])))
        grades.append(g)
    model = toxicity.fit(toxicity.Examples.of(rows, grades))
    assert (np.diff(model.thresholds) > 0).all() and 1 in model.feature
    assert model.weight[list(model.feature).index(1)] > 0
    above = toxicity.exceed(np.array([-1.0, 0, 3]), model.thresholds)
    assert (np.diff(above, axis=1) <= 0).all() and (np.diff(above.sum(axis=1)) > 0).all()


def test_gradient_climbs_to_the_frequencies():
    rows = [(np.array([i % 7]), np.array([1])) for i in range(700)]
    grades = [0] * 500 + [1] * 150 + [2] * 50
    random.Random(0).shuffle(grades)
    model = toxicity.fit(toxicity.Examples.of(rows, grades))
    above = toxicity.exceed(np.array([0.0]), model.thresholds)[0]
    assert above == pytest.approx([200 / 700, 50 / 700], abs=0.01)


def test_toxic_terms_of_a_few_percent_each_count():
    random.seed(5)
    rows, grades = [], []
    for i in range(3000):
        index = {1000 + random.randrange(5000) for _ in range(20)}
        if i < 1000:
            index.add(i % 50)  # 50 toxic terms, each in 2 % of the toxic documents
        rows.append((np.array(sorted(index)), np.ones(len(index), int)))
        grades.append(int(i < 1000))
    model = toxicity.fit(toxicity.graded_by_hits(toxicity.Examples.of(rows, grades)))
    assert set(range(50)) <= set(model.feature)
    score = [model.weight[np.isin(model.feature, index)].sum() for index, _ in rows]
    rejected = toxicity.exceed(np.array(score), model.thresholds).sum(axis=1) >= toxicity.REJECT
    assert rejected[:1000].all() and rejected[1000:].mean() < 0.01


def test_long_texts_train_whole(spark):
    random.seed(6)
    vocabulary = [f"w{i}" for i in range(40_000)]
    rows = []
    for i in range(180):
        text = random.choices(vocabulary, k=4000)
        for _ in range(7 if i < 60 else 0):
            text[random.randrange(len(text))] = INSULTS[0]
        rows.append((i, " ".join(text), 7, 0.5))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i < 60)) for i in range(180) if i % 6], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    assert all(r.toxic == (r.doc_id < 60) for r in out)
    assert np.mean([r.grade == 3 for r in out if r.doc_id < 60]) > 0.9


def test_pipeline_stage_keeps_clean_rows_and_columns(spark, corpus):
    rows, grades = corpus
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(g > 0)) for i, g in enumerate(grades)], "doc_id long, quality int, toxic int")
    kept = toxicity.without_toxic(docs, labels)
    assert kept.schema == docs.schema
    left = {r.doc_id for r in kept.collect()}
    assert sum(g > 0 and i in left for i, g in enumerate(grades)) <= 12
    assert sum(g == 0 and i not in left for i, g in enumerate(grades)) <= 8


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, 1, 0.0), (1, None, 1, 0.0), (2, "", 1, 0.0), (None, "w " * 300_000, 1, 0.0), (3, "!!! ...", 1, 0.0)], SCHEMA
    )
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 1), (None, 1, 1), (2, None, None), (9, 1, 0)], "doc_id long, quality int, toxic int"
    )
    out = toxicity.toxicity(docs, labels)
    assert out.columns == ["doc_id", "severity", "grade", "toxic"] and out.count() == 5
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not any(r.toxic for r in toxicity.toxicity(docs, nothing).collect())
    assert toxicity.toxicity(spark.createDataFrame([], SCHEMA), labels).count() == 0
    assert toxicity.without_toxic(spark.createDataFrame([], SCHEMA), labels).count() == 0
