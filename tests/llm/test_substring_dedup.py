import random

from tests.llm.brute import substring_dedup, thue_morse
from tidelog.llm.substring_dedup import COVERS, dedup_substrings

COLUMNS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def result(spark, rows, window):
    df = spark.createDataFrame(rows, "doc_id long, text string, uid string, n int")
    return sorted((tuple(r[c] for c in COLUMNS) for r in dedup_substrings(df, window).collect()), key=str)


def test_covers_hold_every_difference():
    for period, cover in COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_matches_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)] + ["é", "日本", "x,"]
    passage = [rng.choice(vocabulary) for _ in range(80)]
    docs = []
    for k in range(120):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 160))]
        for _ in range(rng.randrange(3)):
            a = rng.randrange(60)
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[a : a + rng.randrange(10, 60)]
        docs.append((k, rng.choice((" ", "\n", " \t")).join(w)))
    docs += [(500, docs[3][1]), (501, docs[3][1]), (3, docs[3][1]), (502, "a b " * 100), (503, None), (504, ""), (505, " \n "), (None, docs[4][1])]
    docs += [(600, " ".join(f"v{k % 701}" for k in range(60_000)))]
    rows = [(i, t, "clash", 1) for i, t in docs]
    for window in (35, 12):
        assert result(spark, rows, window) == substring_dedup(docs, window)


def test_empty_table(spark):
    assert result(spark, [], 35) == []


def test_words_that_fool_polynomial_hashes(spark):
    x, y = thue_morse(11)
    before, after = ([f"{c}{k}" for k in range(60)] for c in "uv")
    docs = [(1, " ".join([*before[:20], x, *after[:20], "one"])), (2, " ".join([*before[:20], y, *after[:20], "two"]))]
    docs += [(3, " ".join([*before[20:], x, *after[20:], "three"])), (4, " ".join([*before[20:], x, *after[20:], "four"]))]
    got = result(spark, [(i, t, "clash", 1) for i, t in docs], 35)
    assert got == substring_dedup(docs, 35) and [r[2] for r in got] == [0, 0, 81, 81]
