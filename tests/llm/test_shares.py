"""A bounded sample of each class is learned from as if it were the whole table."""

import random

import numpy as np

from tideline.llm import quality


def test_sample_keeps_class_shares(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("the of and with that this a to".split()) for _ in range(20)) + (" grblx" if rng.random() < (0.8 if i % 10 == 0 else 0.05) else ""), int(i % 10 > 0)) for i in range(6000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    texts = [t for _, t, _ in rows[:1000]]
    for per_grade in (150, 10**6):  # a small sample gives the probabilities which the whole table gives
        m = quality.train(d.select("doc_id", "text"), d, per_grade=per_grade)
        assert abs(np.mean([m.predict(t)[1] for t in texts]) - 0.9) < 0.05
