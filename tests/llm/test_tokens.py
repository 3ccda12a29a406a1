import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tests.llm.brute import thue_morse
from tidelog.llm import bitplane, packing, tokens
from tidelog.llm.tokens import Encoder, tokenizer_json

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [
    "", " ", "a  b", "a \n b", "  x", "a b ", "it's a 's  'll x", "<|endoftext|> a<|endoftext|>b <|startoftext|>", "é è  ", "\x1c x \x1d y", "x\n\ny z\n",
    "Á ́b c", "日本 語", "\t tab", "foo.\nBar,", "x.\n\ny", "a.\n b", "x&&&\ny***\nz", "foo!'s x's.", "a²., b", "it's, don't.", "x\n.y", "\0a b",
    "a \0b c", "x  y", "x  y", "İstanbul ẞ ΣΑΣ.", "a_b_c, d__e.", "x" * 5000, "ab " * 4000, "é.́ ≮",
]


def ids(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def signed(text):
    """Spark's xxhash64 of a text."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def texts(seed, n=150):
    rng = random.Random(seed)
    words = ["the", "Straße,", "x.", "été", "100", "co-op", "don't", "日本"] + [f"w{k}" for k in range(50)]
    return [rng.choice((" ", "\n", "  ", " ")).join(rng.choice(words) for _ in range(rng.randrange(0, 600))) for _ in range(n)] + ODD + [None]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_gives_the_tokenizers_ids(path):
    plain, own = Tokenizer.from_file(path), Encoder(tokenizer_json(path))
    some = [t or "" for t in texts(1)]
    some += ["the &&&x", "a.b,c", "don't,x", "…. a", "é. ö,", "x<|endoftext|>y", "a|b <|endoftext|>", "it's.", "a\nb c.\nd", "x.'s", "a'.s"]
    for got, text in zip(own.encode([t.encode() for t in some]), some):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_are_known_by_their_bytes(path, monkeypatch):
    plain, own = Tokenizer.from_file(path), Encoder(tokenizer_json(path))
    some = [f"x {t} y" for n in (10, 11) for t in thue_morse(n)]
    # lengths about those that fit in a key, with bytes that a mask could hide
    some += [" ".join(["w" * n, "w" * (n - 1) + "\0", "w" * n + "\0", "é" * n, "wé" * n]) for n in range(1, 20)]
    for most in (tokens.LONG_BYTES, 0):
        monkeypatch.setattr(tokens, "LONG_BYTES", most)
        for _ in range(2):
            for got, text in zip(own.encode([t.encode() for t in some]), some):
                assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8192, 8193, 20_000])
def test_chunks_round_trip(planes, n):
    x = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert (bitplane.decode_ids(bitplane.encode_ids(x, planes)) == x).all()


def test_token_files_round_trip(spark, monkeypatch):
    plain = Tokenizer.from_file(BYTE)
    rows = [(k * 3 % 1000, t, "clash", 1) for k, t in enumerate(texts(2))] + [(3, "again", "clash", 1), (None, "no id", "clash", 1)]
    rows += [(77, f"one id, many texts {k}", "clash", 1) for k in range(200)] + [(77, "twice", "clash", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, chunk int").repartition(3)
    monkeypatch.setattr(bitplane, "SHARD_BYTES", 50_000)
    for planes in ("byte", "bit"):
        path = bitplane.new_folder(spark)
        bitplane.write_tokens(df, path, BYTE, 2, planes)
        got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in bitplane.read_tokens(spark, path).collect()]
        start, expected = 0, []
        for i, t in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1]), r[1] or "")):
            x = ids(plain, t, 2)
            expected.append((i, start, len(x), crc(x), x))
            start += len(x)
        assert sorted(got, key=lambda r: r[1]) == expected
    path = bitplane.new_folder(spark)
    bitplane.write_tokens(df.where("false"), path, BYTE, 2)
    assert bitplane.read_tokens(spark, path).collect() == []


def test_lower_bound_is_one():
    rng = np.random.default_rng(4)
    for _ in range(200):
        capacity = int(rng.integers(4, 40))
        lengths = np.sort(rng.integers(1, capacity + 1, int(rng.integers(1, 30))))[::-1]
        bins, places, room = packing.best_fit_decreasing(lengths, capacity)
        assert packing.lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity) <= len(room)
        for b in range(len(room)):
            own = bins == b
            assert lengths[own].sum() == capacity - room[b]
            assert (np.cumsum(lengths[own]) - lengths[own]).tolist() == places[own].tolist()
    assert packing.lower_bound(np.bincount([6] * 5, minlength=11), 10) == 5
    assert packing.lower_bound(np.bincount([4, 4, 4], minlength=11), 10) == 2
    assert packing.lower_bound(np.bincount([10, 10], minlength=11), 10) == 2


def fewest(lengths, capacity):
    """The least number of bins, by trying."""
    lengths = sorted(lengths, reverse=True)

    def fits(k, rooms):
        if k == len(lengths):
            return True
        tried = set()
        for b, room in enumerate(rooms):
            if room >= lengths[k] and room not in tried:
                tried.add(room)
                rooms[b] -= lengths[k]
                if fits(k + 1, rooms):
                    return True
                rooms[b] += lengths[k]
        return False

    n = -(-sum(lengths) // capacity)
    while not fits(0, [capacity] * n):
        n += 1
    return n


def test_close_to_the_fewest_sequences():
    rng, more = np.random.default_rng(6), 0
    for _ in range(150):
        capacity = int(rng.integers(6, 24))
        lengths = np.sort(rng.integers(1, capacity + 1, int(rng.integers(1, 13))))[::-1]
        _, _, room = packing.best_fit_decreasing(lengths, capacity)
        bound, best = packing.lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity), fewest(lengths.tolist(), capacity)
        assert bound <= best <= len(room) <= best + 1
        more += len(room) - best
    assert more <= 5


def test_rounds_go_on_while_they_save(spark, monkeypatch):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(packing, "PARTITION_PIECES", 8)
    lengths = rng.integers(1, 101, 600)
    df = spark.createDataFrame([(k, 0, int(n)) for k, n in enumerate(lengths)], "uid long, piece int, length long")
    out = packing.pack_lengths(df, 100).collect()
    assert sorted((r["uid"], r["length"]) for r in out) == list(enumerate(lengths.tolist()))
    rows = {}
    for r in out:
        rows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in rows.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own][:-1]]).tolist() and sum(n for _, n in own) <= 100
    once = sum(len(packing.best_fit_decreasing(np.sort(lengths[k : k + 8])[::-1], 100)[2]) for k in range(0, 600, 8))
    bound = packing.lower_bound(np.bincount(lengths, minlength=101), 100)
    assert len(rows) < once and len(rows) <= bound * 1.03 + 1


def test_packing(spark, monkeypatch):
    plain = Tokenizer.from_file(WORD)
    rows = [(k, t, "clash", 1) for k, t in enumerate(texts(3, 400))] + [(0, "again", "clash", 1), (None, "no id", "clash", 1)]
    rows.append((9000, "word " * 5000, "clash", 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, uid string, length int").repartition(4)
    monkeypatch.setattr(packing, "PARTITION_PIECES", 120)
    got = packing.pack_documents(df, WORD).collect()
    expected = []
    for i, t, *_ in rows:
        x = ids(plain, t, 0)
        expected += [(i, at // 2048, at, len(x[at : at + 2048]), crc(x[at : at + 2048])) for at in range(0, len(x), 2048)]
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(expected, key=str)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r[3] for r in expected)
    assert len(sequences) <= -(-total // 2048) * 1.04 + 2
    used, bound = packing.certificate(packing.pack_documents(df, WORD), 2048)
    assert bound <= used and used <= bound * 1.04 + 2
    assert packing.pack_documents(df.where("false"), WORD).collect() == []
