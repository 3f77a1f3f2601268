"""Small cases of the findings of round 3 on training-data operators."""

import random

import numpy as np

from wayfold.llm import near_dups, quality_rules


def pairs_of(spark, texts, loose):
    rows = [(i, i, x, np.array(t, np.uint32).tobytes()) for i, (t, x) in enumerate(zip(texts, loose))]
    found = near_dups.rest_pairs(spark.createDataFrame(rows, "node long, root long, loose boolean, words binary"), 0.8)
    return [(r.center, r.node) for r in found.collect()]


def alike(texts, loose):
    words = [np.array(t, np.uint32) for t in texts]
    return {(i, j) for j in range(len(texts)) for i in range(j) if (loose[i] or loose[j]) and near_dups.similarity(words[i], words[j], 0.8) > 0}


def test_rest_pairs_behind_a_passage_are_few(spark):
    """Three quarters of each text are one passage; only the planted pair is similar."""
    r = random.Random(1)
    passage = list(range(120))
    texts = [passage + [1000 + 40 * i + j for j in range(40)] for i in range(60)]
    texts.append(passage + texts[0][120:150] + [9_000_000 + j for j in range(10)])
    for t in texts[1:-1]:
        r.shuffle(t)
    got = pairs_of(spark, texts, [True] * len(texts))
    assert (0, 60) in got and len(got) == len(set(got))
    assert len(got) <= 60  # 1,830 before


def test_rest_pairs_hold_all_similar_pairs(spark):
    r = random.Random(2)
    texts = []
    for _ in range(25):
        t = [r.randrange(60) for _ in range(r.randrange(1, 40))]
        texts.append(t)
        for _ in range(3):
            t = list(t)
            for _ in range(r.randrange(0, max(1, len(t) // 5) + 1)):
                at = r.randrange(len(t))
                t[at : at + 1] = r.choice(([], [r.randrange(60)], [t[at], r.randrange(60)])) or ([] if len(t) > 1 else [t[at]])
            texts.append(t)
    loose = [r.random() < 0.7 for _ in texts]
    got = pairs_of(spark, texts, loose)
    want = alike(texts, loose)
    assert len(want) > 40 and want <= set(got) and len(got) == len(set(got))


def test_best_cut_of_a_table_equals_that_of_arrays(spark):
    r = np.random.default_rng(3)
    for n, step in ((3000, 1e-3), (40, 0.05), (2, 0.5)):
        good = r.random(n) < 0.8
        good[:2] = True, False
        score = np.round(np.where(good, r.normal(0.4, 0.08, n), r.normal(0.65, 0.1, n)) / step) * step
        rows = spark.createDataFrame([(float(s), int(g)) for s, g in zip(score, good)], "score double, y int").repartition(5)
        assert quality_rules.best_cut(rows) == quality_rules.calibrate(score, good)
    assert quality_rules.best_cut(rows.where("y = 1")) == np.inf


def test_threshold_learns_from_every_label(spark):
    """One labelled bad text among 24,000: a hashed sample of 20,000 labels had the first of these ids and missed the second."""
    r = random.Random(4)
    texts = [" ".join(f"word{r.randrange(400)}" for _ in range(60)) for _ in range(24)]
    docs = [(i, texts[i % 24]) for i in range(24_000)]
    odd = " ".join(f"## {r.randrange(400)} ##" for _ in range(60))
    threshold = []
    for at in (24_001, 24_002):
        d = spark.createDataFrame([*docs, (at, odd)], "doc_id long, text string").repartition(4)
        labels = spark.createDataFrame([(i, int(i != at)) for i in range(at + 1)], "doc_id long, quality int")
        threshold.append(quality_rules.fit(d, labels).threshold)
    assert np.isfinite(threshold).all()
