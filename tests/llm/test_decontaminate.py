import random

from pyspark.sql import functions as F

from tests.llm.brute import decontaminate
from tidelog.llm import decontaminate as decontaminate_module
from tidelog.llm.decontaminate import find_contamination


def result(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, item_id string, uid int")
    b = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    out = find_contamination(d, b, **more).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long"), F.sha2(F.array_join("items", ","), 256), "contaminated"
    )
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"W{k}" for k in range(60)] + ["é", "日本", "x-y", "Ä"]
    items = [(k, rng.choice((" ", "\n", ", ")).join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40)))) for k in range(40)]
    items += [(90, items[1][1]), (91, None), (92, ""), (93, " , "), (None, "odd one out"), (94, items[2][1] + " and more")]
    docs = []
    for k in range(150):
        w = [rng.choice(vocabulary).lower() for _ in range(rng.randrange(0, 120))]
        if k % 3 == 0:
            p = rng.choice(items[:40])[1].replace(",", " ").split()
            a = rng.randrange(len(p))
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[a : a + rng.randrange(5, 30)]
        docs.append((k, rng.choice((" ", "!", "\n")).join(w)))
    docs += [(500, None), (501, ""), (502, docs[0][1]), (0, docs[0][1]), (0, docs[0][1]), (None, docs[3][1]), (503, " ".join(x[1] or "" for x in items) * 20)]
    expected = decontaminate(docs, items)
    assert result(spark, docs, items) == expected
    assert result(spark, docs, items, block_windows=50) == expected


def test_patterns_that_share_their_ends(spark, monkeypatch):
    monkeypatch.setattr(decontaminate_module, "PAIRS_AT_ONCE", 64)
    rng = random.Random(8)
    middle = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(k, f"what is {middle(6)} of it") for k in range(300)] + [(1000 + k, middle(rng.randrange(1, 4))) for k in range(5)]
    docs = [(k, f"x what is {middle(6)} of it y {middle(5)} what is {middle(6)} of that") for k in range(100)]
    docs.append((900, " ".join(f"v{k % 977}" for k in range(100_000)) + f" {items[7][1]} " + " ".join(f"u{k}" for k in range(20_000))))
    assert result(spark, docs, items) == decontaminate(docs, items)


def test_empty_tables(spark):
    assert result(spark, [], [(1, "a b c")]) == []
    assert [r[2:4] for r in result(spark, [(1, "a b c")], [])] == [(0, 0)]
