"""Token ids of whole texts, by a tokenizer of the tokenizers library, a batch of Arrow texts at a time.

A text is cut where white space follows another character, and where ASCII punctuation other than an apostrophe follows a Latin letter; neither
of the two public tokenizers joins characters over such a place, so a text's ids are its pieces' ids one after the other. Each different piece of a
batch is encoded once, and the ids of frequent pieces are kept in a table of bounded size. A piece of Latin letters alone is its own normal form
(but for case) and one word, so it goes to the library's model at once. Texts with unusual white space or with the string of a special token are
encoded in one piece.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import itertools
import operator
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
ASCII_LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True
MARK[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: Second bytes of Latin-1 letters, whose first byte is 0xC3 (0x97 and 0xB7 are signs).
LATIN = np.zeros(256, bool)
LATIN[0x80:0xC0] = True
LATIN[[0x97, 0xB7]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: In one piece: white space beyond ASCII's usual six, and what may be a special token.
WHOLE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|<\|"
#: Letters that no normal form changes, each one or two bytes.
LETTERS = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+"
#: The character that stands for each byte in byte-level models.
BYTE_CHAR = np.arange(256, dtype="<u4")
BYTE_CHAR[[*range(33), *range(127, 161), 173]] = np.arange(256, 256 + 33 + 34 + 1)
#: Texts of one step have so many bytes together, or are one text.
STEP_BYTES = 4_000_000


def trim() -> None:
    """What this worker's allocators keep for later goes back to the system: the worker lives on between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL(None).malloc_trim(0)


def steps(batches: Iterator[pa.RecordBatch], text_col: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows, in batches whose texts have at most limit bytes together (a longer text is alone)."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, end - at)
            at = end
    trim()


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The bytes of all texts one after the other (null: empty), where each begins (and the end), and the texts as such an array."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0], texts


class Encoder:
    """encode() gives the ids of texts. kept: so many different pieces' ids are kept at most."""

    def __init__(self, path: str, kept: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        self.type = np.dtype("<u4" if self.tokenizer.get_vocab_size() > 1 << 16 else "<u2")
        self.table: dict[str, bytes] = {}
        self.lower = "Lowercase" in str(self.tokenizer.normalizer)
        one = {c: self.tokenizer.encode(f" {c}", add_special_tokens=False).ids for c in "\u00a7\u00b6\u2020\u00a9\u00ae\u2122\u2022"}
        self.mark, self.mark_id = next(((c, ids[0]) for c, ids in one.items() if len(ids) == 1), (None, None))
        leads = {white: x for white in ("", " ", "\n") if (x := self.lead(white)) in {"", *map(chr, BYTE_CHAR[list(white.encode())])}}
        self.word = f"^(?:{'|'.join(leads)}){LETTERS}$"
        self.direct, self.dropped = "" in leads, np.isin(np.arange(256), [ord(white) for white, x in leads.items() if white and not x])

    def lead(self, white: str) -> str | None:
        """What the model's word begins with if letters follow this white space; None if they are not one word then."""
        text, pre = f"{white}x\u00e9", self.tokenizer.pre_tokenizer
        if self.tokenizer.normalizer:
            text = self.tokenizer.normalizer.normalize_str(text)
        words = [w for w, _ in pre.pre_tokenize_str(text)] if pre else []
        return words[0][:-3] if len(words) == 1 and words[0].endswith("x\u00c3\u00a9") else None

    def one_by_one(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = [e.ids for at in range(0, len(pieces), 10_000) for e in self.tokenizer.encode_batch_fast(pieces[at : at + 10_000], add_special_tokens=False)]
        length = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(itertools.chain.from_iterable(out), self.type, int(length.sum())), length

    def in_rows(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces that begin with white space and hold no mark: many at a time, told apart by the mark between them."""
        rows = [f" {self.mark}".join(pieces[at : at + 50]) + f" {self.mark}" for at in range(0, len(pieces), 50)]
        ids = np.concatenate([np.array(e.ids, self.type) for at in range(0, len(rows), 200) for e in self.tokenizer.encode_batch_fast(rows[at : at + 200], add_special_tokens=False)])
        mark = ids == self.mark_id
        ends = np.flatnonzero(mark) - np.arange(len(pieces))
        return ids[~mark], np.diff(ends, prepend=0)

    def words(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces that match self.word: the model's ids of each."""
        ids, lengths, model = [], [], self.tokenizer.model
        for at in range(0, len(pieces), 10_000):
            text = "\0".join(pieces[at : at + 10_000])
            data = np.frombuffer((text.lower() if self.lower else text).encode(), np.uint8)
            words = BYTE_CHAR[data[~self.dropped[data]]].tobytes().decode("utf-32-le").split(chr(BYTE_CHAR[0]))
            out = list(map(model.tokenize, words))
            lengths.append(np.fromiter(map(len, out), np.int64, len(out)))
            ids.append(np.fromiter(map(operator.attrgetter("id"), itertools.chain.from_iterable(out)), self.type, int(lengths[-1].sum())))
        return np.concatenate(ids), np.concatenate(lengths)

    def pieces(self, pieces: list[str], often: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each piece: where its ids begin, and how many they are; all ids. often: the pieces worth keeping. letters: those for words()."""
        found = list(map(self.table.get, pieces))
        new = np.fromiter((x is None for x in found), bool, len(found))
        word = np.flatnonzero(new & letters).tolist()
        other = np.flatnonzero(new & ~letters).tolist()
        plain = [i for i in other if pieces[i][0] in " \n" and self.mark and self.mark not in pieces[i] and len(pieces[i]) < 200]
        plain_set = set(plain)
        rest = [i for i in other if i not in plain_set]
        old = [i for i, x in enumerate(found) if x is not None]
        known = b"".join(filter(None, found))
        parts = [(np.frombuffer(known, self.type), np.fromiter((len(found[i]) for i in old), np.int64, len(old)) // self.type.itemsize)]
        parts += [f([pieces[i] for i in some]) if some else (np.zeros(0, self.type), np.zeros(0, np.int64)) for f, some in ((self.words, word), (self.in_rows, plain), (self.one_by_one, rest))]
        ids, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.array(old + word + plain + rest, np.int64)
        length, begin = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        length[order], begin[order] = sizes, np.cumsum(sizes) - sizes
        if len(self.table) > self.kept:
            self.table.clear()
        for i in (*word, *plain):
            if often[i] and len(pieces[i]) < 200:
                self.table[pieces[i]] = ids[begin[i] : begin[i] + length[i]].tobytes()
        return begin, length, ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin (and the end)."""
        data, offsets, texts = flat(texts)
        if not len(data):
            return np.zeros(0, self.type), np.zeros(len(texts) + 1, np.int64)
        white = WHITE[data]
        letter = ASCII_LETTER[data]
        letter[1:] |= LATIN[data[1:]] & (data[:-1] == 0xC3)
        first = np.zeros(len(data), bool)
        first[1:] = (white[1:] & ~white[:-1]) | (MARK[data[1:]] & letter[:-1])
        if self.lower:
            data = LOWER[data]
        for i in np.flatnonzero(pc.match_substring_regex(texts, WHOLE).to_numpy(zero_copy_only=False)):
            first[offsets[i] : offsets[i + 1]] = False
        first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        at = np.flatnonzero(first)
        chunks = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)).dictionary_encode()
        of = chunks.indices.to_numpy()
        letters = pc.match_substring_regex(chunks.dictionary, self.word).to_numpy(zero_copy_only=False) & self.direct
        begin, length, ids = self.pieces(chunks.dictionary.to_numpy(zero_copy_only=False).tolist(), np.bincount(of) > 1, letters)
        n = length[of]
        end = np.cumsum(n)
        out = ids[np.arange(end[-1] if len(end) else 0) - np.repeat(end - n - begin[of], n)]
        return out, np.append(0, end)[np.searchsorted(at, offsets)]


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)
