"""Document statistics computed in one vectorised pass over whole texts; shared by the quality rules and the classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from maskwright.llm.support import SPACE_BYTES, rolled, word_blocks

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Scale-free statistics of one text; 0 where a text has no words.
FEATURES = (
    "log_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "pipe_ratio",
    "bang_ratio", "punct_ratio", "newline_ratio", "distinct_ratio", "top_word_ratio", "nonascii_ratio", "adjacent_ratio",
)

_SYMBOLS = b"#*$%&|<>"
_CLASSES = np.zeros((256, 10), dtype=np.int64)
_CLASSES[:, 0] = 1
_CLASSES[0x80:0xC0, 0] = 0  # code points: all bytes but UTF-8 continuation bytes
for _k, _bytes in enumerate((SPACE_BYTES, _SYMBOLS, bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b"|", b"!", b".,;:?'\"()-", b"\n"), start=1):
    _CLASSES[list(_bytes), _k] = 1


def statistics(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(BASE counts as int64, FEATURES as float64), one row per text; null reads as empty."""
    base = np.zeros((len(col), len(BASE)), dtype=np.int64)
    feats = np.zeros((len(col), len(FEATURES)))
    for block in word_blocks(col):
        words = block.hashes()
        grams = rolled(words, 3)
        for d in range(block.n_docs):
            row = block.first + d
            raw = block.data[block.doc_at[d] : block.doc_at[d + 1]]
            a, b = block.word_at[d], block.word_at[d + 1]
            n = int(b - a)
            points, space, symbols, upper, lower, digits, pipes, bangs, punct, newlines = np.bincount(raw, minlength=256) @ _CLASSES
            if not n:
                base[row, 2] = symbols
                continue
            repeats = _repeat_words(grams[a : b - 2]) if n >= 3 else 0
            lines, dup = _dup_lines(raw) if newlines else (1, 0)
            base[row] = n, points - space, symbols, dup, repeats
            w = words[a:b]
            runs = np.sort(w)
            edge = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1], [True])))
            chars = max(1, points - space)
            feats[row] = (
                np.log1p(n), chars / n, symbols / chars, dup / lines, repeats / n, upper / max(1, upper + lower), digits / chars, pipes / chars,
                bangs / chars, punct / chars, newlines / n, (len(edge) - 1) / n, np.diff(edge).max() / n, 1 - min(1.0, (raw < 128).sum() / max(1, points)),
                (w[1:] == w[:-1]).mean() if n > 1 else 0.0,
            )
    return base, feats


def _repeat_words(grams: np.ndarray) -> int:
    """Words that lie in a window of three which the text has twice or more."""
    order = np.argsort(grams, kind="stable")
    s = grams[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(grams), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(len(grams) + 2, dtype=bool)
    for k in range(3):
        covered[k : k + len(grams)] |= hit
    return int(covered.sum())


def _dup_lines(raw: np.ndarray) -> tuple[int, int]:
    r"""(lines with a word, those equal to an earlier line) among the \n-separated lines."""
    lines = [x for x in raw.tobytes().split(b"\n") if x.strip(SPACE_BYTES)]
    return max(1, len(lines)), len(lines) - len(set(lines))
