"""Ids of distinct words under a lower-casing byte-pair vocabulary with word ends.

A worker keeps the ids of the words that it has met, in one flat buffer. Words
that are new in a group of texts are merged together: every round contracts the
leftmost pair of least rank of each word that still has one, in array
operations over all words' symbols. Words of many bytes, and fields that may
hold a special token, go to the tokenizer library itself.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import regex
from tokenizers import Tokenizer

from tryloom.llm.chunks import Ragged

#: Words of more bytes are merged by the library, whose time does not grow with their square.
LONG_WORD = 64
#: Words (and ids) that a worker remembers between groups before it starts anew.
WORDS_KEPT, IDS_KEPT = 80_000, 1_000_000
#: Fields handed to the library at once; bounds its memory.
FIELDS_A_CALL = 20_000
_NONE = np.iinfo(np.int32).max


def byte_characters() -> list[str]:
    """The printable stand-in for each byte that byte-level vocabularies use."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(other)) for b in range(256)]


def lowered(text: str) -> str:
    """The normal form that words are taken from: composed, lower case, without a final sigma."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class WordEncoder:
    """Ids of fields, as the tokenizer library gives them without added special tokens."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        end, ids = model["end_of_word_suffix"], model["vocab"]
        if model["type"] != "BPE" or not end or model["unk_token"] is not None:
            raise ValueError("a BPE with a word-end suffix and no unknown token is expected")
        if max(ids.values()) >= 1 << 16:
            raise ValueError("ids over 65535 are not supported")
        self.vocabulary = vocabulary
        self.find_words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        pairs = np.array([ids[a] << 16 | ids[b] for a, b in model["merges"]], np.uint32)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order.astype(np.int32)
        self.made = np.array([ids[a + b] for a, b in model["merges"]], np.uint16)
        self.inner = np.array([ids[c] for c in byte_characters()], np.uint16)
        self.last = np.array([ids[c + end] for c in byte_characters()], np.uint16)
        self.forget()

    @functools.cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.vocabulary)

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.lengths = [np.empty(0, np.uint16)], [np.empty(0, np.int64)]
        self.held = 0

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, the largest number where there is none."""
        pair = left.astype(np.uint32) << np.uint32(16) | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.ranks[at], _NONE)

    def by_library(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for begin in range(0, len(texts), FIELDS_A_CALL):
            out += [np.array(e.ids, np.uint16) for e in self.library.encode_batch_fast(texts[begin : begin + FIELDS_A_CALL], add_special_tokens=False)]
        return out

    def merged(self, words: list[bytes]) -> Ragged:
        """The ids of each word (none is empty)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        ranks = np.full(len(symbols), _NONE, np.int32)
        ranks[:-1] = self.rank(symbols[:-1], symbols[1:])
        ranks[ends - 1] = _NONE
        word, sizes = np.arange(len(words)), lengths.copy()
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            starts = np.cumsum(sizes) - sizes
            least = np.minimum.reduceat(ranks, starts)
            over = least == _NONE
            if over.any():
                own = np.repeat(over, sizes)
                done.append((word[over], sizes[over], symbols[own]))
                symbols, ranks = symbols[~own], ranks[~own]
                word, sizes, least = word[~over], sizes[~over], least[~over]
                if not len(word):
                    break
                starts = np.cumsum(sizes) - sizes
            at = np.flatnonzero(ranks == np.repeat(least, sizes))
            of = np.searchsorted(starts, at, "right") - 1
            at = at[np.r_[True, of[1:] != of[:-1]]]  # the leftmost in each word
            symbols[at] = self.made[least]
            last = at + 2 == starts + sizes
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, ranks = symbols[keep], ranks[keep]
            at, first = at - np.arange(len(at)), at == starts
            ranks[at] = _NONE
            again = at[~last]
            ranks[again] = self.rank(symbols[again], symbols[again + 1])
            before = at[~first] - 1
            ranks[before] = self.rank(symbols[before], symbols[before + 1])
            sizes = sizes - 1
        order = np.argsort(np.concatenate([d[0] for d in done])) if done else np.empty(0, np.int64)
        found = Ragged(np.concatenate([d[2] for d in done]), np.concatenate([d[1] for d in done])) if done else Ragged(np.empty(0, np.uint16), np.empty(0, np.int64))
        return Ragged(found.gather(order), found.lengths[order])

    def _learn(self, new: list[str]) -> None:
        """Appends the ids of ``new``, which stand in ``known`` at the next places already."""
        data = [w.encode("utf-8", "surrogatepass") for w in new]
        long = [i for i, w in enumerate(data) if len(w) > LONG_WORD]
        found = self.merged([b"a" if len(w) > LONG_WORD else w for w in data])
        if long:
            parts = np.split(found.flat, found.starts[1:])
            for i, ids in zip(long, self.by_library([new[i] for i in long]), strict=True):
                parts[i] = ids
            found = Ragged(np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts)))
        self.flat, self.lengths = [np.concatenate([*self.flat, found.flat])], [np.concatenate([*self.lengths, found.lengths])]

    def fields(self, fields: list[str]) -> Ragged:
        """The ids of each field."""
        if len(self.known) > WORDS_KEPT or len(self.flat[0]) > IDS_KEPT:
            self.forget()
        known, find = self.known, self.find_words
        new: list[str] = []
        counts = np.ones(len(fields), np.int64)
        codes: list[int] = []
        odd: list[int] = []
        size = len(known)
        for i, field in enumerate(fields):
            if field.isascii():
                if "<" in field:
                    odd.append(i)
                    counts[i] = 0
                    continue
                field = field.lower()
                words = [field] if field.isalpha() else find(field)
            else:
                if "<" in field:
                    odd.append(i)
                    counts[i] = 0
                    continue
                words = find(lowered(field))
            if len(words) != 1:
                counts[i] = len(words)
            for word in words:
                code = known.get(word)
                if code is None:
                    code = known[word] = size
                    size += 1
                    new.append(word)
                codes.append(code)
        if new:
            self._learn(new)
        words = Ragged(self.flat[0], self.lengths[0])
        where = np.array(codes, np.int64)
        ends = np.cumsum(counts)
        sums = np.concatenate([[0], np.cumsum(words.lengths[where])])
        lengths = sums[ends] - sums[ends - counts]
        found = Ragged(words.gather(where), lengths)
        if odd:
            parts = np.split(found.flat, found.starts[1:])
            for i, ids in zip(odd, self.by_library([fields[i] for i in odd]), strict=True):
                parts[i] = ids
            found = Ragged(np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts)))
        return found


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str) -> WordEncoder:
    return WordEncoder(vocabulary)
