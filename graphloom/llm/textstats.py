"""Exact format counts of a whole text, shared by the quality operators."""

from __future__ import annotations

import numpy as np

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_END = np.zeros(256, bool)
_END[list(b".!?")] = True

NAMES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_chars", "n_upper", "n_letters", "n_digits", "n_ends", "n_marked", "n_bars", "n_same", "n_lines", "n_distinct", "n_bangs",
)


def stats(text: str | None) -> tuple[int, ...]:
    """The counts of NAMES.

    n_repeat_words: words inside 3-word windows that occur twice or more in the text. n_dup_lines: lines
    with a word that equal an earlier line. n_marked: words ending in two or more of one symbol. n_same:
    words equal to the word before. n_ends: words ending a sentence. n_bars: words that are a lone bar.
    """
    if not text:
        return (0,) * len(NAMES)
    data = text.encode()
    raw = np.frombuffer(data, np.uint8)
    points = (raw & 0xC0) != 0x80
    space = _SPACE[raw]
    n_chars = int(np.count_nonzero(points))
    word_chars = n_chars - int(np.count_nonzero(space))
    upper = (raw >= 65) & (raw <= 90)
    lower = (raw >= 97) & (raw <= 122)
    high = raw >= 0xC0
    words = data.split()
    n = len(words)
    if n == 0:
        return (0, 0, 0, 0, 0, n_chars, *(0,) * (len(NAMES) - 6))
    last = np.flatnonzero(~space & np.append(space[1:], True))
    prev = np.maximum(last - 1, 0)
    dup, seen, lines = 0, set(), 0
    for line in data.split(b"\n"):
        if line.strip():  # bytes: the same six separators
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    repeat = 0
    if n >= 3:
        k = len(ids)
        if k < 2_000_000:  # three ids fit 63 bits
            tri = (w[:-2] * k + w[1:-1]) * k + w[2:]
        else:
            two = np.unique(w[:-1] * k + w[1:], return_inverse=True)[1]
            tri = two[:-1] * k + w[2:]
        order = np.argsort(tri, kind="stable")
        t = tri[order]
        same = t[1:] == t[:-1]
        if same.any():
            hit = np.zeros(n - 2, bool)
            hit[order[1:][same]] = True
            hit[order[:-1][same]] = True
            cover = np.zeros(n, bool)
            cover[:-2] |= hit
            cover[1:-1] |= hit
            cover[2:] |= hit
            repeat = int(np.count_nonzero(cover))
    lone = np.append(True, space[:-1])[last]
    return (
        n, word_chars, int(np.count_nonzero(_SYMBOL[raw])), dup, repeat,
        n_chars, int(np.count_nonzero(upper)), int(np.count_nonzero(upper | lower | high)), int(np.count_nonzero((raw >= 48) & (raw <= 57))),
        int(np.count_nonzero(_END[raw[last]])), int(np.count_nonzero((raw[last] == raw[prev]) & (last > 0) & (_SYMBOL[raw[last]] | (raw[last] == 33)))),
        int(np.count_nonzero(lone & (raw[last] == 124))), int(np.count_nonzero(w[1:] == w[:-1])), lines, len(ids), data.count(b"!!"),
    )
