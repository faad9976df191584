"""Public tokenizers applied unit by unit with a cache, inside Python workers.

No vocabulary here has a token across white space. For the vocabulary of the ``tokenizers`` library a unit is one of the
pieces that its own pre-tokenizer cuts lower-cased text into, which are known from the characters alone in Latin texts;
other texts are cut at white space. For measures of words by other vocabularies a unit is a white-space separated word.
Each distinct unit is tokenized once per worker and cache generation, many new ones in one call.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np

#: Units kept before the cache starts anew; bounds a worker's memory near 50 MB.
CACHE_UNITS = 250_000
_LOADED: dict = {}

# The pre-tokenizer's pattern over lower-cased text without combining marks: contractions, letters, digits, others.
_L, _N, _S = "a-zªµºß-öø-ÿĀ-ɏ", "0-9²³¹¼½¾", "\x20\x09-\x0d\x85\xa0"
_UNITS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
# Texts of these characters alone take that way: their lower case is one character of the same range.
_LATIN = re.compile("[" + re.escape("".join(c for c in map(chr, range(0x250)) if len(c.lower()) == 1 and c.lower() < "ɐ")) + "]*")


class WordTokens:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.cache: dict[str | bytes, bytes] = {}
        self.model = Tokenizer.from_file(path)

    def _joined(self, units: list, encode) -> np.ndarray:
        cache = self.cache
        try:
            return np.frombuffer(b"".join([cache[u] for u in units]), np.int32)
        except KeyError:
            if len(cache) > CACHE_UNITS:
                cache.clear()
            new = [u for u in set(units) if u not in cache]
            cache.update(zip(new, encode(new)))
            return np.frombuffer(b"".join([cache[u] for u in units]), np.int32)

    def _pieces(self, units: list[str]) -> list[bytes]:
        """Ids of units that are one pre-tokenizer piece each, in one call."""
        e = self.model.encode(" ".join(units), add_special_tokens=False)
        ids, word = np.array(e.ids, np.int32), np.array(e.word_ids, np.int64)
        at = np.searchsorted(word, np.arange(len(units) + 1))
        return [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def _chunks(self, units: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, np.int32).tobytes() for e in self.model.encode_batch([u.decode() for u in units], add_special_tokens=False)]

    def ids(self, text: str | None) -> np.ndarray:
        text = text or ""
        if "<|" in text:  # may hold a special token
            return np.array(self.model.encode(text, add_special_tokens=False).ids, np.int32)
        if _LATIN.fullmatch(text):
            return self._joined(_UNITS.findall(text.lower()), self._pieces)
        return self._joined(text.encode("utf-8", "replace").split(), self._chunks)


def word_tokens(path: str) -> WordTokens:
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


class WordMeasures:
    """Token counts, shares of byte tokens and token entropies of texts by a vocabulary of pieces with byte fallback and
    by a byte-level one, in which a token counts as byte fallback if it is no whole characters."""

    def __init__(self, piece_path: str, rank_path: str):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pairs = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encoders = (
            lambda words: pieces.encode(words, num_threads=1),
            lambda words: [pairs.encode_ordinary(f" {w}") for w in words],
        )
        part = np.zeros(max(ranks.values()) + 1, bool)
        part[[i for b, i in ranks.items() if "\ufffd" in b.decode("utf-8", "replace")]] = True
        self.bytes = (np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())], bool), part)
        self._forget()

    def _forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.flat = [np.zeros(0, np.int32) for _ in self.encoders]
        self.ends = [np.zeros(1, np.int64) for _ in self.encoders]

    def _places(self, words: list[bytes]) -> np.ndarray:
        try:
            return np.array([self.at[w] for w in words], np.int64)
        except KeyError:
            if len(self.at) > CACHE_UNITS:
                self._forget()
            new = [w for w in dict.fromkeys(words) if w not in self.at]
            texts = [w.decode("utf-8", "replace") for w in new]
            for v, encode in enumerate(self.encoders):
                ids = encode(texts)
                self.flat[v] = np.concatenate([self.flat[v], *(np.array(x, np.int32) for x in ids)])
                self.ends[v] = np.concatenate([self.ends[v], self.ends[v][-1] + np.cumsum([len(x) for x in ids])])
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            return np.array([self.at[w] for w in words], np.int64)

    def of(self, texts: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each vocabulary (tokens, share of byte tokens, entropy) by text."""
        m = len(texts)
        place = self._places([w for t in texts for w in t])
        row = np.repeat(np.arange(m), [len(t) for t in texts])
        out = []
        for flat, ends, is_byte in zip(self.flat, self.ends, self.bytes):
            lens = ends[place + 1] - ends[place]
            first = np.cumsum(lens) - lens
            ids = flat[np.repeat(ends[place] - first, lens) + np.arange(lens.sum())]
            of = np.repeat(row, lens)
            n = np.bincount(of, minlength=m).astype(float)
            byte = np.bincount(of, weights=is_byte[ids], minlength=m)
            key = np.sort(of * len(is_byte) + ids)
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            c = np.diff(np.append(cut, len(key))).astype(float)
            spread = np.bincount(key[cut] // len(is_byte), weights=c * np.log2(c), minlength=m)
            some = np.maximum(n, 1)
            out.append((n, byte / some, np.where(n > 0, np.log2(some) - spread / some, 0.0)))
        return out


def word_measures(piece_path: str, rank_path: str) -> WordMeasures:
    if (piece_path, rank_path) not in _LOADED:
        _LOADED[piece_path, rank_path] = WordMeasures(piece_path, rank_path)
    return _LOADED[piece_path, rank_path]
