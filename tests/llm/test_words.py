import random

import numpy as np

from tests.llm.brute import thue_morse
from tidelog.llm.words import LONG, NOT_SPACE, Words, window_hashes


def test_equal_words_and_no_others_share_hashes():
    rng = random.Random(1)
    words = list(thue_morse(11)) + list(thue_morse(6)) + ["a" * n for n in range(1, 2 * LONG)]
    words += ["".join(rng.choice("ab\0é") for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    words += ["a" * LONG + x for x in ("b", "c", "bb")]
    texts = [" ".join(words).encode(), b"", "\n".join(reversed(words)).encode()]
    found = Words(texts, NOT_SPACE, lower=False)
    by_hash, by_word = {}, {}
    for h, a, b in zip(found.hashes().tolist(), found.start.tolist(), found.end.tolist()):
        word = found.data[a:b].tobytes()
        assert by_hash.setdefault(h, word) == word and by_word.setdefault(word, h) == h
    assert len(by_word) == len(set(words))


def test_windows_of_all_sizes():
    rng = random.Random(2)
    text = " ".join(rng.choice("abc") for _ in range(400)).encode()
    words = Words([text], NOT_SPACE, lower=False)
    letters = text.decode().split(" ")
    for size in (1, 2, 3, 7, 10, 15, 16, 35, 399, 400):
        at = np.arange(400 - size + 1)
        for family in (0, 1):
            known = {}
            for h, k in zip(window_hashes(words.hashes(), size, at, family).tolist(), at.tolist()):
                assert known.setdefault(h, letters[k : k + size]) == letters[k : k + size]
            assert len(known) == len({tuple(letters[k : k + size]) for k in at})
    assert len(window_hashes(np.zeros(3, np.uint64), 35, np.zeros(0, np.int64))) == 0
