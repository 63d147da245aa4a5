import re

import numpy as np

from corvine.llm import decontaminate, wordhash


def test_a_hash_for_each_word_wherever_it_stands():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abé_1ß漢\U0001F600 .-\n"), rng.integers(1, 12))) for _ in range(4000)]
    text = " ".join(words)
    want = re.findall(r"\w+", text.lower())
    got = decontaminate.hashes_of(text)
    assert len(got) == len(want)
    by = {}
    for w, h in zip(want, got.tolist()):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by) > 1000
    assert all(decontaminate.hashes_of(w).tolist() == [h] for w, h in list(by.items())[:50])


def test_similar_words_and_long_texts():
    words = [f"{a}{b}{c}" for a in range(40) for b in "abcdefghij" for c in range(40)] + ["a" * n for n in range(1, 300)]
    got = decontaminate.hashes_of(" ".join(words * 2))
    assert len(set(got.tolist())) == len(set(words)) and (got[: len(words)] == got[len(words) :]).all()
    long = decontaminate.hashes_of("x " * wordhash._KEPT + "end")
    assert len(set(long.tolist())) == 2 and decontaminate.hashes_of("end")[0] == long[-1]
    assert len(decontaminate.hashes_of(None)) == len(decontaminate.hashes_of(" .")) == 0
