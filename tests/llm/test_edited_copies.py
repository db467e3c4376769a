"""Pairs near the least similarity against brute force: within hot groups, and with scattered edits."""

import random

from topicloom.llm.near_duplicates import near_duplicate_pairs

from .test_algorithms import HAN, brute_pairs, text_of


def replaced(rng, text, edits):
    out = list(text)
    for at in rng.sample(range(len(out)), edits):
        out[at] = rng.choice(HAN)
    return "".join(out)


def recall(spark, rows):
    wanted = brute_pairs(rows)
    got = set(map(tuple, near_duplicate_pairs(spark.createDataFrame(rows, "id long, content string")).collect()))
    assert got <= wanted
    return len(got) / len(wanted), len(wanted)


def test_heavily_edited_copies_of_a_hot_text(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(4):
        base = text_of(rng, 500)
        rows += [replaced(rng, base, rng.randint(1, 2)) for _ in range(30)] + [replaced(rng, base, rng.randint(22, 44)) for _ in range(10)]
    found, n = recall(spark, list(enumerate(rows)))
    assert n > 1500 and found >= 0.995


def test_scattered_edits(spark):
    rng = random.Random(6)
    rows = []
    for size in (240, 400, 800):
        for _ in range(60):
            base = text_of(rng, size + 5)
            rows += [base, replaced(rng, base, int(size * rng.uniform(0.04, 0.055)))]
    found, n = recall(spark, list(enumerate(rows)))
    assert n > 100 and found >= 0.99


def test_evenly_spread_edits(spark):
    rng = random.Random(7)
    rows = []
    for every in (22, 25, 28, 31, 34, 36):
        for _ in range(15):
            base = list(text_of(rng, rng.randint(260, 900)))
            other = list(base)
            for at in range(every // 2, len(other), every):
                other[at] = rng.choice(HAN)
            rows += ["".join(base), "".join(other)]
    found, n = recall(spark, list(enumerate(rows)))
    assert n >= 85 and found >= 0.99


def test_a_notice_of_400_records(spark):
    rng = random.Random(8)
    notice = text_of(rng, 150)
    rows = [notice + text_of(rng, 300) for _ in range(400)]
    for k in range(60):
        base = list(notice + text_of(rng, 300))
        other = list(base)
        for at in rng.sample(range(150, 450), 12):
            other[at] = rng.choice(HAN)
        rows += ["".join(base), "".join(other)]
    found, n = recall(spark, list(enumerate(rows)))
    assert n >= 60 and found >= 0.99
