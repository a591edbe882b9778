"""Exact word-level encoding with a public BPE tokenizer.

The vocabulary's pre-tokenizer never joins characters across white space, and its
normaliser works character by character, so a text's ids are the ids of its
space-separated words in a row.  Each distinct word is therefore encoded once per
task and memory bound, whatever the corpus size; a task forgets them at its end.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from evidra.llm import shared

#: Words a task keeps; beyond it the memo starts afresh (results do not change).
MEMO = 250_000
#: Words encoded in one step.
STEP = 100_000
END_ID = 1
BREAK = 0xFFFF  #: no id of a vocabulary that is encoded by words
#: Letters whose class is the same in every Unicode version; words with others go to the library whole.
LATIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ıĴ-ſ]+").fullmatch
#: Fixed pattern of the vocabulary file, for lowered words of such letters, and the line feed that ends a word.
SPLIT = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ſ]+|[0-9]|[^\s0-9a-zÀ-ÖØ-öø-ſ]+").findall


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class WordEncoder:
    """ids(text) equals ``Tokenizer.encode(text, add_special_tokens=False).ids``, through the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        vocab = self.whole.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if max(vocab.values()) < 1 << 16 else np.dtype("<u4")
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.words: dict[bytes, bytes] = {}
        self.memo = MEMO
        self.fast = "Lowercase" in repr(self.whole.normalizer) and self.whole.model.end_of_word_suffix == "</w>" and max(vocab.values()) < BREAK
        if self.fast:
            self.bare = Tokenizer(self.whole.model)
            self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
            for token, i in vocab.items():
                self.ends[i] = token.endswith("</w>")
            self.letters = [(chr(b), s) for b, s in _byte_letters().items() if b > 126 and chr(b) != s]

    def _pieces(self, distinct: list[str]) -> dict[str, bytes]:
        """The packed ids of pieces of words; a line feed has an id of its own."""
        out: dict[str, bytes] = {}
        for start in range(0, len(distinct), 4000):
            part = [p for p in distinct[start : start + 4000] if p != "\n"]
            shown = " ".join(part)
            if not shown.isascii():
                shown = shown.encode().decode("latin-1")
                for byte, letter in self.letters:
                    shown = shown.replace(byte, letter)
            ids = np.array(self.bare.encode_batch_fast([shown], add_special_tokens=False)[0].ids, dtype=self.dtype)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):  # a vocabulary that lacks a letter
                out.update((p, self._direct(p)) for p in part)
                continue
            raw, at = ids.tobytes(), (ends * self.dtype.itemsize).tolist()
            out.update(zip(part, [raw[i:j] for i, j in zip([0, *at[:-1]], at, strict=True)], strict=True))
        out["\n"] = np.array([BREAK], self.dtype).tobytes()
        return out

    def _direct(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of distinct words."""
        other = [] if self.fast else words
        if self.fast and not LATIN("".join(set((b"".join(words)).decode("utf-8", "replace")))):
            other = [w for w in words if not LATIN(w.decode("utf-8", "replace"))]
        made = self.whole.encode_batch_fast([w.decode("utf-8", "replace") for w in other], add_special_tokens=False)
        odd = {w: np.array(x.ids, dtype=self.dtype).tobytes() for w, x in zip(other, made, strict=True)}
        out: list[bytes] = []
        for start in range(0, len(words), STEP):
            some = words[start : start + STEP]
            plain = [w for w in some if w not in odd] if odd else some
            if not plain:
                out += [odd[w] for w in some]
                continue
            # Words hold no line feed, so all are lowered and split into pieces in one go, each closed by a line feed.
            found = SPLIT((b"\n".join(plain) + b"\n").decode().lower())
            pieces = self._pieces(list(set(found)))
            raw, size = b"".join(map(pieces.__getitem__, found)), self.dtype.itemsize
            ends = (np.flatnonzero(np.frombuffer(raw, self.dtype) == BREAK) * size).tolist()
            ids = [raw[i:j] for i, j in zip([0, *(e + size for e in ends[:-1])], ends, strict=True)]
            if odd:
                own = iter(ids)
                ids = [odd[w] if w in odd else next(own) for w in some]
            out += ids
        return out

    def _known(self, words: list[bytes]) -> list[bytes]:
        """As :meth:`_encoded`, through the memo."""
        got = list(map(self.words.get, words))
        holes = [i for i, x in enumerate(got) if x is None]
        if holes:
            new = [words[i] for i in holes]
            ids = self._encoded(new)
            if len(self.words) + len(new) > self.memo:
                self.words = {}
            if len(new) <= self.memo:
                self.words.update(zip(new, ids, strict=True))
            for i, x in zip(holes, ids, strict=True):
                got[i] = x
        return got

    def forget(self) -> None:
        """Empty the memo."""
        self.words = {}
        shared.give_back()

    def flat(self, texts: pa.Array, end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings; null is empty) in a row, each with the end id after it, and their offsets."""
        texts = pc.fill_null(texts, "")
        if any(pc.any(pc.match_substring(texts, s)).as_py() for s in self.special):
            made = [self._flat(texts.slice(i, 1), end) if not any(s in t for s in self.special) else self._one(t, end) for i, t in enumerate(texts.to_pylist())]
            return np.concatenate([m[0] for m in made]), np.concatenate([[0], np.cumsum([len(m[0]) for m in made])])
        return self._flat(texts, end)

    def _one(self, text: str, end: bool) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(self._direct(text), self.dtype)
        ids = np.append(ids, np.array([END_ID], self.dtype)) if end else ids
        return ids, np.array([0, len(ids)])

    def _flat(self, texts: pa.Array, end: bool) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        which = words.indices.to_numpy(zero_copy_only=False)
        known = self._known(pc.cast(words.dictionary, pa.binary() if pa.types.is_string(words.dictionary.type) else pa.large_binary()).to_pylist())
        edges = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
        if end:
            known.append(np.array([END_ID], self.dtype).tobytes())
            which = np.insert(which, edges[1:], len(known) - 1)
            edges += np.arange(len(edges))
        if not len(which):
            return np.zeros(0, self.dtype), np.zeros(len(edges), np.int64)
        rows = pa.array(known, pa.large_binary()).take(pa.array(which))
        ends = np.frombuffer(rows.buffers()[1], np.int64)[: len(which) + 1] // self.dtype.itemsize
        return np.frombuffer(rows.buffers()[2], self.dtype, count=int(ends[-1])), ends[edges]

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each UTF-8 text, with the end id after it."""
        flat, at = self.flat(pa.array(texts, pa.binary()).cast(pa.string()))
        return [flat[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def crcs(ids: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Unsigned crc32 of each run of ids as little-endian unsigned 32-bit integers."""
    raw = memoryview(ids.astype("<u4")).cast("B")
    at = (np.asarray(offsets) * 4).tolist()
    return [zlib.crc32(raw[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]


def ids_crc32(ids: np.ndarray) -> int:
    """As :func:`crcs` for one run of ids."""
    return zlib.crc32(ids.astype("<u4").tobytes())
