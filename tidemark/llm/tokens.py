"""Exact, fast encoding of whole texts with a public word-level BPE tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Word parts of one of the two stores in which a worker remembers ids.  When one is full it becomes the older one, whose parts
#: move back as they are met, so memory is bounded, frequent parts stay, and results are unaffected.
CACHED_PARTS = 200_000
#: Unknown words encoded in one call.
JOINED = 1_000
#: A word as a stem that ends in a letter or digit known to every version of Unicode, and closing ASCII signs, which the
#: tokenizer splits off.  The apostrophe is not among them, nor is U+0130, which ends in a mark once it is lower-cased.
STEM_AND_SIGNS = r"^(?P<stem>.*[A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}])(?P<signs>[!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]+)$"
SIGNS = pa.array([bytes([c]) for c in b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"], pa.binary())

_encoders: dict[str, WordEncoder] = {}


def _ragged(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretches of the pool in a row, where each ends)."""
    ends = np.cumsum(sizes)
    source = np.repeat(starts - (ends - sizes), sizes)
    source += np.arange(len(source))
    return pool[source], ends


class WordEncoder:
    """Encodes text by its white-space-separated words.

    For a tokenizer that lower-cases and drops white space (its pieces never hold any and its normalizer acts on each side
    of a space alone), the ids of a text are the ids of its words in a row, so each distinct word is encoded once.  Only
    the six ASCII white-space bytes separate words here; other white space stays inside and is left to the tokenizer.
    Signs at a word's end are pieces of their own, so a word with them is put together from two parts; a word that could
    hold a special token (``<|``) is left whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.closes = np.zeros(self.vocab_size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.closes[i] = token.endswith("</w>")

    def encode_many(self, texts: pa.Array | Sequence[str | None], at_once: int = 4 << 20) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null text counts as empty."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        step = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // at_once
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(texts)] if len(texts) else [0]
        for low, high in zip(cuts, cuts[1:], strict=False):
            yield from self._encode(texts.slice(low, high - low))

    def _encode(self, texts: pa.Array) -> Iterator[bytes]:
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        words = pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(words), words)
        closed = pc.indices_nonzero(pc.is_in(pc.binary_slice(words.cast(pa.binary()), -1), value_set=SIGNS))
        some = words.take(closed)
        both = pc.extract_regex(some, STEM_AND_SIGNS)
        good = pc.and_(pc.is_valid(both), pc.invert(pc.match_substring(some, "<|")))
        both, split = both.filter(good), np.zeros(len(words), bool)
        split[closed.filter(good).to_numpy()] = True
        stems = pc.replace_with_mask(words, pa.array(split), pc.struct_field(both, "stem"))
        parts = pa.concat_arrays([stems, pc.struct_field(both, "signs")]).dictionary_encode()
        each = self._ids(parts.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        last = np.arange(len(words)) + np.cumsum(split)  # of a word's parts; the stem of a split one lies before its signs
        of_word, which = np.empty(len(words) + int(split.sum()), np.int64), parts.indices.to_numpy()
        of_word[last - split] = which[: len(words)]
        of_word[last[split]] = which[len(words) :]
        pool, ends = _ragged(np.frombuffer(b"".join(each), "<u4"), (np.cumsum(sizes) - sizes)[of_word], sizes[of_word])
        ends = ends[last]
        sizes = np.diff(ends, prepend=0)
        which = coded.indices.to_numpy()
        ids, ends = _ragged(pool, (ends - sizes)[which], sizes[which])
        ids, ends = ids.tobytes(), np.concatenate([[0], 4 * ends])
        bounds = ends[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])].tolist()
        for low, high in zip(bounds, bounds[1:], strict=False):
            yield ids[low:high]

    def _ids(self, parts: list[bytes]) -> list[bytes]:
        found = list(map(self.known.get, parts))
        at = [i for i, ids in enumerate(found) if ids is None]
        if at:
            if len(self.known) + len(at) > CACHED_PARTS:
                self.known, self.older = {}, self.known
            known, older, new = self.known, self.older, []
            for part in map(parts.__getitem__, at):
                if (ids := older.pop(part, None)) is None:
                    new.append(part)
                else:
                    known[part] = ids
            self._learn(new)
            for i in at:
                found[i] = known[parts[i]]
        return found

    def _learn(self, new: list[bytes]) -> None:
        plain, odd = [], []
        for part in new:
            text = part.decode("utf-8", "replace")
            (plain if text.isalpha() else odd).append((part, text))
        for at in range(0, len(plain), JOINED):
            some = plain[at : at + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(text for _, text in some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1  # a word of letters is one piece, and its last id closes it
            if len(ends) != len(some):  # letters to one version of Unicode, not to the other
                odd += some
                continue
            ids, bounds = ids.tobytes(), [0, *(4 * ends).tolist()]
            self.known.update((part, ids[a:b]) for (part, _), a, b in zip(some, bounds, bounds[1:], strict=False))
        for at in range(0, len(odd), JOINED):
            some = odd[at : at + JOINED]
            found = self.tokenizer.encode_batch_fast([text for _, text in some], add_special_tokens=False)
            self.known.update((part, np.array(e.ids, "<u4").tobytes()) for (part, _), e in zip(some, found, strict=True))


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
