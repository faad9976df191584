"""Statistics of whole texts, computed with numpy over slices of the Arrow byte buffer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .bytesets import slices, span_hashes, words

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BANG = np.zeros(256, bool)
_BANG[list(b"!?")] = True

#: What the quality classifier sees of a text; shares lie between 0 and 1.
FEATURES = (
    "log_words", "log_chars", "word_chars", "word_chars_spread", "log_lines", "symbols", "punctuation", "upper", "digits", "exclaimed",
    "wide", "distinct_words", "same_as_before", "repeated_lines", "repeated_triples", "short_words", "long_words", "symbol_words", "commonest_word",
)


def counts_of(texts: pa.Array) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(first row, arrays by row) for each slice: words, characters, duplicate lines, repeated five-word windows, shares."""
    for first, data, off in slices(texts):
        m = len(off) - 1
        s, e, row = words(data, off)
        per = lambda mask_or_weights, rows: np.bincount(rows, weights=mask_or_weights, minlength=m)[:m]
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        h = span_hashes(data, s, e, lower=False) if len(s) else np.zeros(0, np.uint64)
        chars = lead[e] - lead[s]
        out = {"n_words": np.bincount(row, minlength=m)[:m].astype(np.int64), "chars": lead[off[1:]] - lead[off[:-1]], "word_chars": per(chars, row).astype(np.int64), "word_chars_2": per(chars.astype(float) ** 2, row)}
        total = lambda mask: (lambda c: c[off[1:]] - c[off[:-1]])(np.concatenate([[0], np.cumsum(mask[data])]))
        out |= {"n_symbols": total(_SYMBOL), "punct": total(_PUNCT), "upper": total(_UPPER), "digit": total(_DIGIT), "bang": total(_BANG), "wide": np.diff(lead[off]) * 0 + np.diff(np.concatenate([[0], np.cumsum(data >= 0xC0)])[off])}
        out |= {"short": per(chars <= 3, row), "long": per(chars >= 12, row)}
        sym = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
        out["symbol_words"] = per(sym[e] > sym[s], row)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        out["same"] = per(same, row)
        at = np.searchsorted(row, np.arange(m + 1))
        for name in ("distinct", "top", "n_lines", "n_dup_lines", "n_repeat_words", "triples", "triple_repeats"):
            out[name] = np.zeros(m, np.int64)
        win = {k: windows(h, k) for k in (3, 5)}
        breaks = np.flatnonzero(data == 10)
        for r in range(m):
            a, b = int(at[r]), int(at[r + 1])
            if b > a:
                c = np.unique(h[a:b], return_counts=True)[1]
                out["distinct"][r], out["top"][r] = len(c), c.max()
            if b - a >= 3:
                w = win[3][a : b - 2]
                out["triples"][r], out["triple_repeats"][r] = len(w), len(w) - len(np.unique(w))
            if b - a >= 5:
                w = win[5][a : b - 4]
                _, inv, c = np.unique(w, return_inverse=True, return_counts=True)
                if len(c) < len(w):
                    edge = np.zeros(b - a + 1, np.int64)
                    twice = np.flatnonzero(c[inv] >= 2)
                    np.add.at(edge, twice, 1)
                    np.add.at(edge, twice + 5, -1)
                    out["n_repeat_words"][r] = int((np.cumsum(edge)[:-1] > 0).sum())
            lines = breaks[np.searchsorted(breaks, off[r]) : np.searchsorted(breaks, off[r + 1])]
            ls, le = np.concatenate([[off[r]], lines + 1]), np.concatenate([lines, [off[r + 1]]])
            i, j = np.searchsorted(s[a:b], ls), np.searchsorted(s[a:b], le)
            full = j > i
            out["n_lines"][r] = int(full.sum())
            if out["n_lines"][r] > 1:
                lh = span_hashes(data[off[r] : off[r + 1]], ls[full] - off[r], le[full] - off[r], lower=False)
                out["n_dup_lines"][r] = len(lh) - len(np.unique(lh))
        yield first, out


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every run of k words."""
    m = max(0, len(h) - k + 1)
    out = np.zeros(m, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + m]
    return out ^ (out >> np.uint64(29))


def feature_rows(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    parts = []
    for _, c in counts_of(texts):
        n, ch = np.maximum(c["n_words"], 1), np.maximum(c["chars"], 1)
        wc = np.maximum(c["word_chars"], 1)
        mean = c["word_chars"] / n
        x = [
            np.log1p(c["n_words"]), np.log1p(c["chars"]), mean, np.sqrt(np.maximum(c["word_chars_2"] / n - mean**2, 0)), np.log1p(c["n_lines"]), c["n_symbols"] / wc, c["punct"] / wc,
            c["upper"] / wc, c["digit"] / wc, c["bang"] / wc, c["wide"] / ch, c["distinct"] / n, c["same"] / n, c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
            c["triple_repeats"] / np.maximum(c["triples"], 1), c["short"] / n, c["long"] / n, c["symbol_words"] / n, c["top"] / n,
        ]
        parts.append(np.stack(x, 1))
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
