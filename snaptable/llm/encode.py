"""Encoding of whole texts with a tokenizer file of the tokenizers library.

A text is cut where no token can span, the parts are encoded by the library, and a part met before
in the same Python worker is not encoded again. The ids equal those of one call over the whole text;
tests hold the two against each other. A text with a string of a special token goes whole through the library.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of parts that a worker remembers before it starts anew; bounds its memory.
MEMO_CHARS = 18_000_000

_WORKER: dict = {}
_CONTROL = re.compile(r"[\0\x1c-\x1f]")
_RUN = re.compile(r"\s*\S+|\s+")
#: Texts for _RUN or with control characters: other white space, and then a space or a new line.
_ODD = r"[\x00\x1c-\x1f]|[\t\x0b\x0c\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}][ \n]"


def cut_words(texts: pa.Array) -> pa.Array:
    """Lists of parts, for tokenizers that drop white space: no token holds a space."""
    return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")


def cut_before_spaces(texts: pa.Array) -> pa.Array:
    """Lists of parts, for byte-level BPE with its usual pattern: a token may begin with white space, but after other
    characters it never goes on into white space, so every run of it begins a new token."""
    odd = pc.match_substring_regex(texts, _ODD)
    marked = pc.if_else(odd, "", texts)
    for old, new in ((" ", "\0 "), ("\n", "\0\n"), (" \0", " "), ("\n\0", "\n")):  # a mark before each run
        marked = pc.replace_substring(marked, old, new)
    parts = pc.split_pattern(marked, "\0")
    if rows := np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
        own = [[t] if _CONTROL.search(t) else _RUN.findall(t) for t in texts.take(pa.array(rows)).to_pylist()]
        places = np.arange(len(texts))
        places[rows] = len(texts) + np.arange(len(rows))
        parts = pa.concat_arrays([parts, pa.array(own, parts.type)]).take(pa.array(places))
    return parts


#: The usual pattern of byte-level BPE, as the tokenizer file names it only by a flag.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE writes each byte as one letter: printable ones as themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class Encoder:
    """encode(texts) gives each text's ids as little-endian bytes of dtype.

    The distinct parts of all texts are found first. New ones pass the file's normalizer, are cut into pre-tokens by
    its pattern, and each new pre-token goes through the file's BPE model. Without a cut, whole texts go through the
    library in one call.
    """

    def __init__(self, path: str, cut: Callable[[pa.Array], pa.Array] | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        steps = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in steps["added_tokens"]]
        self.cut, self.letters = cut, _byte_letters()
        self.memo, self.words, self.chars = {"": b""}, {}, 0
        if cut:
            import regex

            found = [s["pattern"]["Regex"] for s in steps["pre_tokenizer"].get("pretokenizers", []) if s["type"] == "Split"]
            self.pattern = regex.compile(found[0] if found else BYTE_LEVEL_PATTERN)
            # These change printable ASCII without spaces as lower() does.
            kinds = [(n["type"], n.get("pattern"), n.get("content")) for n in (steps["normalizer"] or {}).get("normalizers", [])]
            self.lowers = kinds == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]

    def encode(self, texts: Iterable[str | None] | pa.Array) -> list[bytes]:
        texts = pc.fill_null(texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "")
        if not self.cut:
            found = self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)
            return [np.array(e.ids, self.dtype).tobytes() for e in found]
        if self.chars > MEMO_CHARS:
            self.forget()
        special = functools.reduce(pc.or_, (pc.match_substring(texts, x) for x in self.special), pa.array(np.zeros(len(texts), bool)))
        parts = self.cut(pc.if_else(special, "", texts))
        out = self._joined(parts.flatten(), pc.list_value_length(parts).to_numpy(), self.memo, self._parts)
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, self.dtype).tobytes()
        return out

    def forget(self) -> None:
        self.memo, self.words, self.chars = {"": b""}, {}, 0

    def _joined(self, values: pa.Array, sizes: np.ndarray, known: dict[str, bytes], learn: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The ids of so many values after another, for each size; of those that are not known, learned ones, which are known from now on."""
        coded = values.dictionary_encode()
        met = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(known.get, met))
        if new := [i for i, x in enumerate(ids) if x is None]:
            names = [met[i] for i in new]
            for i, name, x in zip(new, names, learn(names), strict=True):
                ids[i] = known[name] = x
            self.chars += sum(map(len, names))
        each = pa.array(ids, pa.large_binary()).take(coded.indices)
        lists = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes, dtype=np.int64))), each)
        return pc.binary_join(lists, pa.scalar(b"", pa.large_binary())).to_numpy(zero_copy_only=False).tolist()

    def _parts(self, parts: list[str]) -> list[bytes]:
        words, sizes = [], []
        for part in self._normal(parts):
            found = self.pattern.findall(part)
            words += found
            sizes.append(len(found))
        return self._joined(pa.array(words, pa.large_string()), np.array(sizes), self.words, self._words)

    def _words(self, words: list[str]) -> list[bytes]:
        tokenize, flat, ends = self.tokenizer.model.tokenize, [], [0]
        for word in words:
            flat += [t.id for t in tokenize(word.encode().decode("latin-1").translate(self.letters))]
            ends.append(len(flat) * self.dtype.itemsize)
        ids = np.array(flat, self.dtype).tobytes()
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def _normal(self, parts: list[str]) -> list[str]:
        if not (normalizer := self.tokenizer.normalizer) or not parts:
            return parts
        # Parts without white space of any kind can go together: it becomes one space, where they are parted again.
        plain = [self.lowers and p.isascii() and p.isprintable() and " " not in p for p in parts]
        alone = [not x and p.split() != [p] for p, x in zip(parts, plain, strict=True)]
        others = [p for p, x, y in zip(parts, plain, alone, strict=True) if not x and not y]
        together = iter(normalizer.normalize_str("\n".join(others)).split(" "))
        return [p.lower() if x else normalizer.normalize_str(p) if y else next(together) for p, x, y in zip(parts, plain, alone, strict=True)]


def encoder(path: str, cut: Callable[[pa.Array], pa.Array] | None = None) -> Encoder:
    """This Python worker's encoder for a tokenizer file."""
    key = (path, getattr(cut, "__name__", None))
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Encoder(path, cut)
    return _WORKER[key]


def batch_blocks(batch, column: str = "text", size: int = 2_000_000, rows: int = 256) -> Iterator:
    """Slices of a record batch with about so many bytes in a column and at most so many rows, one row at least;
    only a slice at a time need become Python objects."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes.tolist()):
        held += n
        if held >= size or i + 1 - start == rows:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < len(sizes):
        yield batch.slice(start)
