import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import tokens

PIECES = st.sampled_from(["Hello,", "it's", "l'été", "<|endoftext|>", "x<|startoftext|>y", "J̌", "Å", "́x", "a b", "\x1c", "\x85", "1990s", "don't.", "'s", "''", "--", "%%%", "ΣΑΣ", "İ", "ﬁ", "中文", "🙂!", "é."])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(PIECES, st.text(max_size=6)), max_size=12), max_size=5), st.sampled_from([" ", "\n", "\t\t"]))
def test_words_give_the_ids_of_the_text(parts, space):
    texts = [space.join(p) for p in parts] + [None, "", " "]
    texts = [t if t is None else t.encode("utf-8", "replace").decode() for t in texts]
    enc = tokens.encoder(tokens.default_path())
    whole = Tokenizer.from_file(tokens.default_path())
    for text, ids in zip(texts, enc.encode_many(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text or "", add_special_tokens=False).ids


def test_small_store_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_PARTS", 3)
    enc = tokens.WordEncoder(tokens.default_path())
    texts = ["one two, three four five", "two six. seven", "ONE two"]
    whole = Tokenizer.from_file(tokens.default_path())
    assert [np.frombuffer(i, "<u4").tolist() for i in enc.encode_many(texts, at_once=1)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_frequent_words_are_learned_once_though_the_store_is_full(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_PARTS", 40)
    encoder, learned, learn = tokens.WordEncoder(tokens.default_path()), [], tokens.WordEncoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda new: (learned.extend(new), learn(encoder, new)))
    texts = [f"frequent, (words) <|x. {' '.join(f'rare{chr(97 + i)}{chr(97 + k)}.' for k in range(12))} end!" for i in range(20)]
    for text in texts:
        assert list(encoder.encode_many([text, None])) == [np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), b""]
    assert learned.count(b"frequent") == learned.count(b"end") == 1 and len(encoder.known) + len(encoder.older) <= 80


def test_a_letter_that_ends_in_a_mark_keeps_its_signs():
    encoder, texts = tokens.WordEncoder(tokens.default_path()), ["İ#", "aİ.", "İstanbul, İİ!?"]
    assert [np.frombuffer(i, "<u4").tolist() for i in encoder.encode_many(texts)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
