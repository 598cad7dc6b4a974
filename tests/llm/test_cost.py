"""Work that the encoders are spared, with the same ids."""

import random

from palimpsest.llm import bitplane, bpe


def test_texts_with_lines_are_cut_without_a_pattern(monkeypatch):
    monkeypatch.setattr(bpe, "DOUBLE_SPACE", None)  # was searched in every text
    assert bpe.cuts("one two\nthree four") == ["one", "two\nthree", "four"]
    assert bpe.cuts(" a b") == ["", "a", "b"]


def test_doubled_white_space_is_found_as_by_the_pattern():
    r = random.Random(1)
    for _ in range(20000):
        text = "".join(r.choice(" ab\n\t\x1c\x85　\r"[: r.randrange(2, 10)] + "xyz") for _ in range(r.randrange(12)))
        assert bpe.doubled(text) == (bpe.DOUBLE_SPACE.search(text) is not None), repr(text)


def test_trie_asks_only_for_lengths_that_a_token_has():
    class Asked(dict):
        n = 0

        def get(self, *a):
            Asked.n += 1
            return super().get(*a)

    v = bpe.Vocabulary(bpe.default_vocabulary())
    v.id_of = Asked(v.id_of)
    r = random.Random(2)
    words = {bytes(r.choice(b"qxzjkv") for _ in range(12)) for _ in range(300)}
    found = bpe.Trie(v).encode(words)
    assert Asked.n <= 4 * 12 * len(words)  # was about 6 a byte
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    for w in words:
        assert list(memoryview(found[w]).cast("I")) == t.encode(w.decode(), add_special_tokens=False).ids


def test_known_chunks_are_looked_up_once_a_batch():
    ids = bitplane.Ids(bpe.default_vocabulary())
    texts = ["x one two three", "y one two\nthree one"]
    want = ids.batch(texts)

    class Known(dict):
        def __getitem__(self, key):
            raise AssertionError("a known chunk is looked up again")  # was: all in a set first, then each once more

    ids.seen = Known(ids.seen)
    assert ids.batch(texts) == want
