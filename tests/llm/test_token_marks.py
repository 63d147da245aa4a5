import random

import pyarrow as pa

from corvine.llm.token_output import PieceTokenizer, default_vocabulary


def test_words_with_runs_of_marks_are_not_tokenised_anew():
    """Ids equal those of whole texts; of words before many marks the library sees each run of marks once."""
    rng = random.Random(4)
    marks = ["***", "$$$", "...", "'", "''", "_", "!?", "<|", "-", "&&&", "##", "`", "~^", "[]", "{}", "|>", ".'", "@@"]
    words = ["the", "Zürich", "étude", "can", "ÀÿÖ", "x", "re", "Hello", "don"]
    texts = [" ".join(rng.choice(words) + rng.choice([*marks, ""]) for _ in range(200)) for _ in range(20)]
    texts += ["can't don't re's '", "a<|endoftext|> <|endoftext|> <|x|>", "", "***", "a*b* ab** 1** ab**1", "é** ß++ İ** ſ.."]
    tokens = PieceTokenizer(default_vocabulary())
    ids, sizes = tokens(pa.array([*texts, None]))
    want = [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [*map(len, want), 0] and ids.tolist() == [i for w in want for i in w]
    tokens, seen = PieceTokenizer(default_vocabulary()), []
    whole = tokens._whole
    tokens._whole = lambda piece: seen.append(piece) or whole(piece)
    tokens(pa.array([" ".join(f"{w}{m}" for w in words for m in marks)]))
    assert sorted(seen) == sorted(marks)
    ids, sizes = tokens(pa.array(["skip", "a b", None, "c"]).slice(1))
    assert sizes.tolist() == [2, 0, 1] and len(ids) == 3
    ids, sizes = tokens(pa.array([], pa.string()))
    assert len(ids) == len(sizes) == 0
