"""Similarity, history and cutoffs against brute force, with hot groups."""

import random
from itertools import combinations

import pytest

from topicloom.llm import cutoffs, history, near_duplicates, passages
from topicloom.llm.codepoints import LETTERS_DIGITS, reduce_slowly

HAN = [chr(0x4E00 + i) for i in range(2500)]


def text_of(rng, size):
    return "".join(rng.choice(HAN) for _ in range(size))


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            out[at] = rng.choice(HAN)
        elif kind < 0.7:
            out[at:at] = [rng.choice(HAN)] * rng.randint(1, 4)
        else:
            del out[at : at + rng.randint(1, 4)]
    if rng.random() < 0.3:
        cut = len(out) // 2
        out = out[cut:] + out[:cut]
    return "".join(out)


def runs(text):
    reduced = reduce_slowly(text or "", LETTERS_DIGITS)
    return {reduced[i : i + 5] for i in range(len(reduced) - 4)} if len(reduced) >= 240 else None


def brute_pairs(rows):
    sets = [(i, s) for i, t in dict(rows).items() if (s := runs(t))]
    return {(min(a, b), max(a, b)) for (a, x), (b, y) in combinations(sets, 2) if len(x & y) >= 0.6 * len(x | y)}


def collection(seed, hot=0):
    rng = random.Random(seed)
    rows = []
    for _ in range(25):
        base = text_of(rng, rng.randint(230, 900))
        for _ in range(rng.choice([1, 1, 2, 4])):
            rows.append(rng.choice([base, edited(rng, base, rng.randint(1, 14)), base.replace(base[5], "，" + base[5])]))
    shared = text_of(rng, 60)
    rows += [shared + text_of(rng, 250) for _ in range(40)]  # a common passage of texts that differ
    base = text_of(rng, 600)
    rows += [edited(rng, base, 3) for _ in range(hot)]
    rows += [None, "", "短", "。" * 500, text_of(rng, 60_000)]
    rng.shuffle(rows)
    return [(i * 7, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "hot"), [(1, 0), (2, 60)])
def test_pairs_equal_brute_force(spark, seed, hot):
    rows = collection(seed, hot)
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "id long, content string, tag int, k1 string")
    found = [tuple(r) for r in near_duplicates.near_duplicate_pairs(df).collect()]
    assert len(found) == len(set(found)) and set(found) == brute_pairs(rows)


def test_pairs_of_repeated_rows_and_empty_tables(spark):
    rows = collection(3)
    df = spark.createDataFrame(rows + rows[:20], "id long, content string")
    assert {tuple(r) for r in near_duplicates.near_duplicate_pairs(df).collect()} == brute_pairs(rows)
    assert near_duplicates.near_duplicate_pairs(df.limit(0)).count() == 0


def test_groups_have_classes_and_links(spark):
    rng = random.Random(5)
    base = text_of(rng, 400)
    rows = [(1, base), (2, base + "。"), (3, edited(rng, base, 2)), (4, text_of(rng, 300)), (5, "短")]
    found = {r.record_id: (r.class_id, r.n_links) for r in near_duplicates.near_duplicate_groups(spark.createDataFrame(rows, "id long, content string")).collect()}
    assert found == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (4, 0)}


def test_blocks_expand_every_key(spark):
    rows = [(h, i, 5, 0) for h in (1, 2) for i in range(70)]
    counted = near_duplicates.count_blocks(spark.createDataFrame(rows, "h long, id long, n int, tag int"), block=16)
    total = {}
    for r in counted.collect():
        assert r.a < r.b
        total[r.a, r.b] = total.get((r.a, r.b), 0) + r.cnt
    assert total == {p: 2 for p in combinations(range(70), 2)}


@pytest.mark.parametrize(("seed", "hot"), [(1, 0), (2, 60)])
def test_delivered_before_equals_brute_force(spark, seed, hot):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(6), rng.choice([f"http://a.example/{i % 30}?utm_x={i}", f"http://b.example/{i}#x", None, "", " "]), t) for i, t in collection(seed, hot)]
    pairs = brute_pairs([(i, t) for i, _, _, t in rows])
    batch = {i: b for i, b, _, _ in rows}
    wanted = {max(p, key=batch.get) for p in pairs if batch[p[0]] != batch[p[1]]}
    page = lambda u: u.split("#")[0].split("?")[0] if u and u.strip() else None
    wanted |= {i for i, b, u, _ in rows if page(u) and any(page(v) == page(u) and c < b for _, c, v, _ in rows)}
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(9_999_999, None, None, None, "x")], "record_id long, batch_no int, url string, content string, page string")
    found = [r.record_id for r in history.delivered_before(df).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted
    assert history.delivered_before(df.limit(0)).count() == 0


def test_segments_merge_logarithmically():
    import numpy as np

    segments = history.Segments()
    for k in range(64):
        segments.add(np.arange(10) * 3 + k % 3, np.full(10, k), np.full(10, k))
    assert len(segments.parts) <= 7 and sum(len(p[0]) for p in segments.parts) == 640
    assert sum(int((e - b).sum()) for _, b, e in segments.search(np.array([3]))) == sum(k % 3 == 0 for k in range(64))


@pytest.mark.parametrize(("seed", "hot"), [(4, 0), (5, 90)])
def test_batches_added_to_history_equal_one_pass(spark, tmp_path, seed, hot):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(4), rng.choice([f"http://a.example/{i % 30}?utm_x={i}", None, ""]), t) for i, t in collection(seed, hot)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "record_id long, batch_no int, url string, content string, page string")
    kept = history.History(spark, f"file://{tmp_path}/history", slices=16)
    found = {r.record_id for b in range(4) for r in kept.add(b, df.where(f"batch_no = {b}").drop("batch_no")).collect()}
    assert found == {r.record_id for r in history.delivered_before(df).collect()} and found
    assert kept.batches() == [0, 1, 2, 3] and len(kept.segments()) < 4
    with pytest.raises(ValueError):
        kept.add(3, df)
    assert kept.add(9, df.drop("batch_no").limit(0)).count() == 0


def test_a_new_batch_opens_no_text_of_others_than_candidates(spark, tmp_path):
    import shutil

    rng = random.Random(8)
    texts = [[text_of(rng, 300) for _ in range(10)] for _ in range(4)]
    folder = tmp_path / "history"
    kept = history.History(spark, f"file://{folder}", slices=8)
    schema = "record_id long, url string, content string"
    for b in range(4):
        kept.add(b, spark.createDataFrame([(b * 100 + i, None, t) for i, t in enumerate(texts[b])], schema))
    for b in range(4):  # every text gone but that of the one candidate's part
        for part in (folder / "texts" / f"batch={b}").glob("part=*"):
            if not (b == 1 and _holds(spark, part, 103)):
                shutil.rmtree(part)
    new = [edited(rng, texts[1][3], 2), text_of(rng, 300), texts[0][5]]
    again = history.History(spark, f"file://{folder}")  # as found in the folder
    assert sorted(r.record_id for r in again.add(4, spark.createDataFrame([(900 + i, None, t) for i, t in enumerate(new)], schema)).collect()) == [900, 902]


def _holds(spark, part, record):
    return spark.read.parquet(f"file://{part}").where(f"id = {record}").count() > 0


@pytest.mark.parametrize("seed", range(4))
def test_cutoffs_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a"] * 8 + ["b", "c", "d", None]), rng.choice([rng.randint(-5, 100), 50, 0, None])) for _ in range(600)] + [("one", 7)]
    targets = [("a", rng.randint(1, 100)), ("b", 100), ("c", 0), ("one", 35), ("none", 50), (None, 3), ("a", 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "source string, score int, percent int").repartition(5)
    found = {r.source: (r.cutoff, r.n_kept, r.n_total) for r in cutoffs.cutoffs(df, spark.createDataFrame(targets, "source string, percent int")).collect()}
    wanted = {}
    for source in ("a", "b", "c", "one"):
        percent = max(p for s, p in targets if s == source)
        scores = [n or 0 for s, n in rows if s == source]
        cut = max(c for c in scores if sum(n >= c for n in scores) * 100 >= percent * len(scores))
        wanted[source] = (cut, sum(n >= cut for n in scores), len(scores))
    assert found == wanted
    assert cutoffs.cutoffs(df.limit(0), spark.createDataFrame(targets, "source string, percent int")).count() == 0


def test_whole_numbers(spark):
    from pyspark.sql import functions as F

    rows = [" 5 ", "+07", "-3", "5.0", "", None, "高", "99999999999999999999", "- 5", "\t8　"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string").orderBy("i")
    assert [r[0] for r in df.select(cutoffs.whole_number(F.col("x"))).collect()] == [5, 7, -3, 0, 0, 0, 0, 2**31 - 1, 0, 8]


def test_short_contents_have_no_key(spark):
    df = spark.createDataFrame([(1, "字" * 239), (2, "字" * 240), (None, "字" * 240), (3, None)], "id long, content string")
    assert [r.id for r in passages.content_keys(df).collect()] == [2]
