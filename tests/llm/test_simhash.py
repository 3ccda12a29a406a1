import random

import numpy as np

from tests.llm.brute import simhash_groups, words_of
from tidelog.llm import simhash
from tidelog.llm.simhash import block_masks, keep_one_of_each, near_duplicates


def result(spark, rows):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, node string, fp int")
    return sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)


def test_masks_cover_the_fingerprint():
    masks = block_masks(3, 3)
    assert len(masks) == 20
    for pair in ((0, 1, 2), (0, 31, 63), (5, 20, 40)):
        assert any(all(not m & (1 << b) for b in pair) for m in ((m & (2**64 - 1)) for m in masks))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    docs = []
    for k in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 300))]
        docs.append((len(docs), " ".join(w)))
        for _ in range(rng.randrange(4)):
            c = list(w)
            for _ in range(rng.randrange(3)):
                if c:
                    c[rng.randrange(len(c))] = rng.choice(vocabulary)
            docs.append((len(docs), rng.choice((" ", "\n")).join(c).upper()))
    return docs


def test_matches_brute_force(spark):
    docs = corpus(1) + [(900, None), (901, ""), (902, " "), (903, "one"), (904, "ONE"), (905, "a b"), (905, "a b"), (None, "a b"), (None, "lone null id here")]
    assert result(spark, docs) == simhash_groups(docs)


def test_dense_group(spark):
    base = [f"v{k}" for k in range(4000)]
    docs = [(k, " ".join(base[:k] + ["x"] + base[k + 1 :])) for k in range(0, 300)]
    assert result(spark, docs) == simhash_groups(docs)


def test_empty_table(spark):
    assert result(spark, []) == []
    assert keep_one_of_each(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_keeps_one_of_each(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, groups = [], {}
    for g in range(40):
        w = [rng.choice(vocabulary) for _ in range(200)]
        for c in range(rng.randrange(1, 5)):
            own = list(w)
            if c:
                own[rng.randrange(200)] = "changed"
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(own), "extra", g))
    rows += [(7, rows[7][1], "extra", rows[7][3])] * 2 + [(5000, None, None, None), (5001, "", None, None), (5002, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, __n int")
    kept = keep_one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(r["doc_id"] for r in kept.collect())
    least = {}
    for i, g in groups.items():
        least.setdefault(g, i)
    assert got == sorted([*least.values(), 5000])
    assert all(len(words_of(r["text"])) == 200 for r in kept.collect() if r["doc_id"] < 5000)


def test_repeated_lines_count_once(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(3000)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    line = some(20)
    # ten texts have only one line in common, sixteen times; two have equal sets of shingles
    apart = [(k, "\n".join([some(400), *[line] * 16])) for k in range(10)]
    prose = some(400)
    equal = [(20, "\n".join([prose, *[line] * 2])), (21, "\n".join([prose, *[line] * 40]))]
    kept = keep_one_of_each(spark.createDataFrame(apart + equal, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(10), 20]


def test_links_by_exact_similarity(spark):
    rng = random.Random(4)
    rows, stays = [], set()
    for g in range(200):
        # a run of n words changed costs n + 4 of 596 shingles: 62 gives 0.801, 76 gives 0.763
        base, n = [f"g{g}w{k}" for k in range(600)], 62 if g % 2 else 76
        at = rng.randrange(4, 500)
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[:at] + [f"g{g}x{k}" for k in range(n)] + base[at + n :]))]
        stays |= {2 * g} if g % 2 else {2 * g, 2 * g + 1}
    kept = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == stays


def test_blocks_give_candidates_that_share_no_band(spark):
    # eight of nine shingles in common, fingerprints of the sets within three bits, no band alike
    starts = [
        "w78 w322 w914 w1085 w2161 w1358 w1606 w319 w415 w974 w2882 w1375 w1221",
        "w1046 w2002 w1259 w484 w780 w2297 w612 w1243 w280 w2242 w2825 w2212 w1568",
        "w2796 w381 w989 w2244 w1406 w1171 w2149 w1881 w2603 w917 w1946 w1522 w1320",
    ]
    rows = [t for k, s in enumerate(starts) for t in ((2 * k, s), (2 * k + 1, s.rsplit(" ", 1)[0] + " x"))]
    hashes, bounds = simhash._shingles([t.encode() for _, t in rows], 5, distinct=True)
    keys, prints = simhash.band_keys(hashes, bounds), simhash._majority(hashes, bounds)
    assert not (keys[::2] == keys[1::2]).any() and (np.bitwise_count(prints[::2] ^ prints[1::2]) <= 3).all()
    kept = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == jaccard_groups(rows) == {0, 2, 4}


def test_similarity_decides_on_close_fingerprints(spark):
    # fingerprints of the sets within three bits, similarity 5/7
    pairs = close_but_unlike()
    assert len(pairs) == 3
    rows = [(k, t) for k, t in enumerate(t for pair in pairs for t in pair)]
    kept = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == set(range(6))


def close_but_unlike():
    """Three pairs of texts that differ in one of their six shingles and whose fingerprints differ in three bits or fewer."""
    rng, out = random.Random(12), []
    while len(out) < 3:
        starts = [[f"w{rng.randrange(3000)}" for _ in range(9)] for _ in range(4000)]
        texts = [" ".join(w) for s in starts for w in ([*s, "x"], [*s, "y"])]
        prints = simhash._majority(*simhash._shingles([t.encode() for t in texts], 5, distinct=True))
        close = np.flatnonzero(np.bitwise_count(prints[::2] ^ prints[1::2]) <= 3)
        out += [(texts[2 * k], texts[2 * k + 1]) for k in close.tolist()]
    return out[:3]


def jaccard_groups(rows, size=5):
    """The least id of each component over links of similarity 0.8, pair by pair."""
    sets = [{tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} for w in (words_of(t) for _, t in rows)]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if 1.8 * len(sets[x] & sets[y]) >= 0.8 * (len(sets[x]) + len(sets[y])) - 1e-9:
                a, b = sorted((find(x), find(y)))
                top[b] = a
    return {rows[find(x)][0] for x in range(len(rows))}


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 4)
    rng = random.Random(6)
    base = [f"b{k}" for k in range(300)]
    rows = []
    for k in range(150):
        w = list(base)
        for n in range(rng.choice((1, 2, 4, 5, 6, 8, 12))):  # each change makes five shingles its own
            w[rng.randrange(300)] = f"own{k}x{n}"
        rows.append((k, " ".join(w)))
    kept = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == jaccard_groups(rows)


def test_sketches_rule_out_no_link():
    rng = np.random.default_rng(9)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) for n in (0, 1, 50, 200, 3000)]
    sets += [np.unique(np.concatenate((s[: len(s) * 9 // 10], rng.integers(0, 1 << 63, len(s) // 10, dtype=np.uint64)))) for s in sets]
    bits = simhash.sketches(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])))).view(np.uint64)
    for x, u in zip(sets, bits):
        for y, v in zip(sets, bits):
            lacks = int(np.bitwise_count(u & ~v).sum())
            assert len(np.intersect1d(x, y)) <= len(np.unique(x)) - lacks
