"""Whole texts as sequences of codes of their distinct fields.

A field is what stands between two blanks. Most tokenizers treat fields
independently, so a task works out each *distinct* field of a bounded group of
texts once and reassembles the texts with array operations. The bound on a
group limits the memory of a task, not what is processed: every text of every
group is taken whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The Unicode White_Space property (fixed values), as a character class.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPACED = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_WHITE_THEN_BLANK = r"[\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "

#: A group of texts is closed before it passes this many bytes of text.
GROUP_BYTES = 8 << 20


def spaced_chunks(text: str) -> list[str]:
    """``text`` cut before each white-space run; joined again it is ``text``."""
    return _SPACED.findall(text)


def white_then_blank(texts: pa.Array) -> np.ndarray:
    """Which texts hold a blank right after other white space."""
    return pc.match_substring_regex(texts, _WHITE_THEN_BLANK).to_numpy(zero_copy_only=False)


class Ragged:
    """A list of small arrays, stored flat and gathered by index."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, lengths
        self.starts = np.cumsum(lengths) - lengths

    def gather(self, codes: np.ndarray) -> np.ndarray:
        lengths = self.lengths[codes]
        ends = np.cumsum(lengths)
        if not len(ends):
            return self.flat[:0]
        index = np.repeat(self.starts[codes] - (ends - lengths), lengths)
        index += np.arange(ends[-1])
        return self.flat[index]


@dataclass
class Group:
    """Some texts, their kept columns, and the codes of their fields."""

    kept: list[pa.Array]
    texts: pa.Array
    offsets: np.ndarray
    codes: np.ndarray
    fields: list[str]

    def __len__(self) -> int:
        return len(self.texts)

    def of(self, i: int) -> np.ndarray:
        """The field codes of text ``i``."""
        return self.codes[self.offsets[i] : self.offsets[i + 1]]

    def sizes(self) -> np.ndarray:
        """UTF-8 bytes of each text."""
        return pc.binary_length(self.texts).to_numpy(zero_copy_only=False).astype(np.int64)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def bounded(batches: Iterable[pa.RecordBatch], most: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows, dealt into batches of at most ``most`` text bytes (one row at least)."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        text = column(batch, "text")
        sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        begin = 0
        for i, n in enumerate(sizes.tolist()):
            if size and size + n > most:
                waiting.append(batch.slice(begin, i - begin))
                yield _joined(waiting)
                waiting, size, begin = [], 0, i
                pa.default_memory_pool().release_unused()
            size += n
        waiting.append(batch.slice(begin))
    if size or any(b.num_rows for b in waiting):
        yield _joined(waiting)
    # A worker serves further tasks, of other operators too.
    waiting.clear()
    pa.default_memory_pool().release_unused()


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def grouped(batches: Iterable[pa.RecordBatch], keep: list[str], at: str = "blank", most: int = GROUP_BYTES) -> Iterator[Group]:
    """Bounded groups of the rows of ``batches``, cut at each blank, or at runs of ASCII white space.

    A null text counts as empty.
    """
    for batch in bounded(batches, most):
        texts = pc.fill_null(column(batch, "text"), "")
        split = pc.split_pattern(texts, " ") if at == "blank" else pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        yield Group([column(batch, k) for k in keep], texts, split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py(), coded.indices.to_numpy(), coded.dictionary.to_pylist())
