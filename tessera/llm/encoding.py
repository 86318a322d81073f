"""Token ids of whole texts by the tokenizers library, which encodes each distinct pre-token once per worker."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np

from tessera.llm._shared import _LOWER, batch_bytes, chunks_of

#: Bytes of units and their ids that a worker keeps; beyond it, the half that was used last stays.
KEEP_BYTES = 24 << 20
#: Words that the library encodes in one call, and bytes of texts that are looked at together.
_TOGETHER, GROUP = 500, 1 << 22
_OTHER, _LETTER, _DIGIT, _SPACE, _BLANK, _HARD = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = _LETTER
_CLASS[list(b"0123456789")] = _DIGIT
_CLASS[32], _CLASS[9:14] = _SPACE, _BLANK
_CLASS[39] = _CLASS[28:32] = _CLASS[128:] = _HARD  # apostrophes begin contractions; the rest is for the library to class
_SOLID = ~np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])


class Encoder:
    """Encodes texts exactly as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    Texts are cut into units such that the library gives a unit the same ids alone as within the text, and the
    library encodes each distinct unit. First cuts go before spaces. Where pre-tokenization joins a space to the word
    after it (byte level), only before single spaces between characters other than white space, as no pre-token
    reaches across such a place; where white space is dropped, before all. Such a chunk is a unit of its own if it
    holds anything but plain Latin text; others are cut further into their pre-tokens: runs of letters, of digits (or
    single digits) and of other characters. All of this is done on the bytes of many texts at once.
    """

    def __init__(self, path: str):
        import pyarrow as pa
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.library = Tokenizer.from_file(path)
        with open(path) as f:
            file = json.load(f)
        kind, model = file["pre_tokenizer"], file["model"]
        self.joined = kind["type"] == "ByteLevel" and kind["use_regex"] and not kind["add_prefix_space"] and not file["normalizer"]
        if self.joined:
            mark = lambda t: t.startswith("Ġ")
        elif kind["type"] == "Sequence" and kind["pretokenizers"][0]["type"] == "Split" and kind["pretokenizers"][0]["behavior"] == "Removed":
            suffix = model["end_of_word_suffix"]
            if [n["type"] for n in file["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or not suffix:
                raise ValueError(f"{path}: texts of this normalizer can't be cut at spaces")
            mark = lambda t: t.endswith(suffix)
        else:
            raise ValueError(f"{path}: texts of this pre-tokenizer can't be cut at spaces")
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.marked = np.zeros(size, bool)
        for token, i in model["vocab"].items():
            self.marked[i] = mark(token)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        # Of two neighbouring classes: 1 a unit begins between them, 2 they make a run of white space.
        self.pairs = np.zeros(64, np.uint8)
        for x in range(6):
            for y in range(6):
                begins = x != _SPACE and (x != y or (y == _DIGIT and not self.joined))
                self.pairs[x << 3 | y] = begins | (2 if self.joined and {x, y} <= {_SPACE, _BLANK} else 0)
        self.bare = Tokenizer(self.library.model)
        self.bare.pre_tokenizer = WhitespaceSplit()
        self.units = pa.array([], pa.string())
        self.ids, self.starts, self.lens, self.used = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.now = 0

    def _each(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch_fast(strings, add_special_tokens=False)]
        return np.array([i for x in found for i in x], self.dtype), np.array([len(x) for x in found], np.int64)

    def _words(self, words: list[str], ascii_only: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of words of Latin letters, many in one call: a word's first (or last) token is known by its space sign (or
        word end). Those of ASCII need nothing but the library's model, as its bytes stand for themselves."""
        for a in range(0, len(words), _TOGETHER):
            part = words[a : a + _TOGETHER]
            text = "".join(part)
            if ascii_only:
                found = self.bare.encode_batch_fast([text.replace(" ", " Ġ") if self.joined else text])[0].ids
            else:
                found = self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids
            ids = np.array(found, self.dtype)
            at = np.flatnonzero(self.marked[ids])
            yield (ids, np.diff(np.append(at, len(ids)) if self.joined else np.append(-1, at))) if len(at) == len(part) else self._each(part)

    def _learn(self, new: list[str]) -> None:
        import pyarrow as pa

        ascii_, latin, others = [], [], []
        for u in new:
            if u[:1] != " " or not u[1:].isalpha():
                others.append(u)
            elif u.isascii():
                ascii_.append(u)
            else:
                (latin if max(u) < "ɐ" and "İ" not in u else others).append(u)
        found = [(self.ids, self.lens), *self._words(ascii_, True), *self._words(latin, False)] + ([self._each(others)] if others else [])
        self.ids, self.lens = (np.concatenate(x) for x in zip(*found, strict=True))
        self.starts = np.cumsum(self.lens) - self.lens
        self.units = pa.concat_arrays([self.units, pa.array(ascii_ + latin + others, pa.string())])
        self.used = np.append(self.used, np.full(len(new), self.now))

    def _forget(self) -> None:
        """Keeps the units that were used last, up to half of the bytes that may be kept."""
        import pyarrow as pa

        order = np.argsort(-self.used, kind="stable")
        size = np.diff(np.frombuffer(self.units.buffers()[1], np.int32)[: len(self.units) + 1])[order] + self.lens[order] * self.dtype.itemsize + 28
        kept = np.sort(order[: int(np.searchsorted(np.cumsum(size), KEEP_BYTES // 2))])
        self.units = self.units.take(pa.array(kept))
        self.ids, self.lens, self.used = self._gather(kept), self.lens[kept], self.used[kept]
        self.starts = np.cumsum(self.lens) - self.lens

    def _gather(self, slots: np.ndarray) -> np.ndarray:
        n = self.lens[slots]
        return self.ids[np.repeat(self.starts[slots] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the units, and the bytes with the letters of plain chunks in lower case where the library lowers them."""
        n = len(data)
        cls = _CLASS[data]
        rows = offsets[:-1][np.diff(offsets) > 0]
        odd = np.zeros(0, np.int64)
        if int(data.max()) >= 128:
            after = np.append(data[1:], 0)
            two = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
            two = two[~((data[two] == 0xC3) & ((after[two] == 0x97) | (after[two] == 0xB7))) & ~((data[two] == 0xC4) & (after[two] == 0xB0))]
            cls[two] = cls[two + 1] = _LETTER
            odd = np.flatnonzero(((data >= 0xE1) & (data <= 0xE3)) | ((data == 0xC2) & ((after == 0x85) | (after == 0xA0))))
        spaces = np.flatnonzero(cls == _SPACE)
        chunk = np.zeros(n, bool)
        if self.joined:
            solid = _SOLID[data]  # surely not white space
            solid[odd] = solid[np.minimum(odd + 1, n - 1)] = solid[np.minimum(odd + 2, n - 1)] = False
            inside = spaces[(spaces > 0) & (spaces < n - 1)]
            inside = inside[solid[inside - 1] & solid[inside + 1]]
            chunk[inside] = True
            chunk[rows[rows > 0] - 1] = False  # a row that ends in a space
        else:
            chunk[spaces] = True
        chunk[rows] = True
        pair = self.pairs[cls[:-1] << 3 | cls[1:]]
        pair[rows[rows > 0] - 1] = 0  # no pair reaches over the border of rows
        hard = np.flatnonzero(cls == _HARD)
        hard = [hard, np.flatnonzero(pair & 2) + 1, spaces[~chunk[spaces]] if self.joined else hard[:0]]
        special = np.flatnonzero(data[1:] == 124) + 1  # <| may begin a special token
        hard = np.concatenate([*hard, special[data[special - 1] == 60]])
        inner = np.append(False, pair & 1).view(bool)
        kept = data
        if not self.joined:
            data = _LOWER[data]
        if len(hard):  # such chunks stay whole, and as they are
            starts = np.flatnonzero(chunk)
            which = np.unique(np.searchsorted(starts, hard, side="right") - 1)
            size = np.append(starts[1:], n)[which] - starts[which]
            at = np.repeat(starts[which] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            inner[at] = False
            if not self.joined:
                data[at] = kept[at]
        return np.flatnonzero(inner | chunk), data

    def encode_rows(self, column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Groups of rows of an Arrow string array, null as empty: (first row, end, ids of all, where each row's begin and end)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        whole, offsets = batch_bytes(column)
        for a, b in chunks_of(offsets, GROUP):
            self.now += 1
            at = offsets[a : b + 1] - offsets[a]
            if not at[-1]:
                yield a, b, np.zeros(0, self.dtype), at
                continue
            starts, data = self._cut(whole[offsets[a] : offsets[b]], at)
            places = np.append(starts, len(data)).astype(np.int32)
            units = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
            known = pc.index_in(units.dictionary, value_set=self.units)
            slots = pc.fill_null(known, -1).to_numpy().astype(np.int64)
            new = units.dictionary.filter(pc.is_null(known)).to_pylist()
            if new:
                size = len(self.units)
                self._learn(new)
                fresh = pc.index_in(units.dictionary.filter(pc.is_null(known)), value_set=self.units.slice(size)).to_numpy()
                slots[slots < 0] = size + fresh
            self.used[slots] = self.now
            each = slots[units.indices.to_numpy()]
            ends = np.append(0, np.cumsum(self.lens[each]))
            yield a, b, self._gather(each), ends[np.searchsorted(starts, at)]
            if self.units.nbytes + self.ids.nbytes + 24 * len(self.lens) > KEEP_BYTES:
                self._forget()

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        import pyarrow as pa

        return [ids[x:y] for _, _, ids, ends in self.encode_rows(pa.array(texts, pa.string())) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode_documents(self, column, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """As ``encode_rows``, with an end id after every row's."""
        for a, b, ids, ends in self.encode_rows(column):
            yield a, b, np.insert(ids, ends[1:], self.dtype.type(end_id)), ends + np.arange(len(ends))


_encoders: dict[str, Encoder] = {}


def forget() -> None:
    """Drops what a reused worker holds for encoding; it is made anew when needed."""
    _encoders.clear()


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = Encoder(path)
    return _encoders[path]
