"""Aho-Corasick matching of many needles in one pass over each text.

The automaton of a bounded chunk of needles is a full transition table over the bytes that occur
in them, built level by level with array operations. Texts of a batch are joined into one byte
array, cut into equal lanes that overlap by one needle length, and all lanes step through the
table together. UTF-8 never holds one character inside another, so byte matches are text matches.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import numpy as np

#: Byte that no UTF-8 text holds; it stands between texts and leads back to the root.
BREAK = 0xFF
#: Bytes that step together, and matches looked up at once.
_LANE, _HITS = 1 << 11, 1 << 20


def _word_byte(byte: int) -> bool:
    return chr(byte).isalnum() or byte == ord("_")


_ASCII_WORD = np.array([byte < 128 and _word_byte(byte) for byte in range(256)])


def _is_word(text: bytes) -> bool:
    """Whether the one character is a letter, mark, number or underscore."""
    char = text.decode("utf-8")
    return char == "_" or unicodedata.category(char)[0] in "LMN"


class Automaton:
    """Finds every occurrence of a chunk of non-empty needles (bytes)."""

    def __init__(self, needles: Sequence[bytes]):
        self.lengths = np.array([len(n) for n in needles], np.int64)
        order = np.argsort(self.lengths, kind="stable")
        flat = np.frombuffer(b"".join(needles), np.uint8)
        starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]) if len(needles) else np.zeros(0, np.int64)
        used = np.unique(flat)
        self.classes = np.zeros(256, np.int64)  # class 0: bytes of no needle
        self.classes[used] = np.arange(1, len(used) + 1)
        # A text holds fewer than 256 different bytes, so a class fits one byte.
        self.text_classes = self.classes.astype(np.uint8)
        self.width = len(used) + 1
        self.longest = int(self.lengths.max(initial=1))

        # Trie, one depth at a time: a state is a distinct (parent, byte).
        at = np.zeros(len(needles), np.int64)
        levels, total, ends = [], 1, np.zeros(len(needles), np.int64)
        for depth in range(self.longest if len(needles) else 0):
            live = order[np.searchsorted(self.lengths[order], depth, side="right") :]
            edge = at[live] * self.width + self.classes[flat[starts[live] + depth]]
            edges, index = np.unique(edge, return_inverse=True)
            at[live] = total + index
            levels.append((total + np.arange(len(edges)), edges // self.width, edges % self.width))
            total += len(edges)
            ended = live[self.lengths[live] == depth + 1]
            ends[ended] = at[ended]

        # Needles by the state they end in.
        self.by_end = np.argsort(ends, kind="stable")
        self.first = np.searchsorted(ends[self.by_end], np.arange(total + 1))
        closes = np.diff(self.first) > 0
        # Transitions, and for every state the longest proper suffix that is a needle.
        step = np.zeros((total, self.width), np.int32)
        fall, self.link = np.zeros(total, np.int64), np.zeros(total, np.int64)
        for depth, (states, parents, classes) in enumerate(levels):
            if depth:
                fall[states] = step[fall[parents], classes]
            step[parents, classes] = states
            # A state's own row begins as that of the state it falls to, which lies higher.
            step[states] = step[fall[states]]
            self.link[states] = np.where(closes[fall[states]], fall[states], self.link[fall[states]])
            if depth + 1 < len(levels):
                below, above, by = levels[depth + 1]
                step[above, by] = below
        self.step = step.ravel()
        self.hits = closes | (self.link > 0)

    def _ends(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and states of all places where at least one needle ends."""
        overlap = self.longest - 1
        lane = max(_LANE, overlap)
        count = max(1, -(-len(data) // lane))
        classes = np.zeros(overlap + count * lane, np.uint8)
        classes[overlap : overlap + len(data)] = self.text_classes[data]
        lanes = np.lib.stride_tricks.sliding_window_view(classes, overlap + lane)[::lane]
        state = np.zeros(count, np.int64)
        base = np.arange(count) * lane - overlap
        places, states = [], []
        for k, column in enumerate(np.ascontiguousarray(lanes.T)):
            state = self.step[state * self.width + column]
            if k >= overlap:
                found = np.flatnonzero(self.hits[state])
                if len(found):
                    places.append(base[found] + k)
                    states.append(state[found])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(places), np.concatenate(states).astype(np.int64)

    def pairs(self, texts: Sequence[bytes], whole_words: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text number, needle number); with ``whole_words`` only of needles that no
        letter, mark, number or underscore touches on either side."""
        if not len(self.lengths) or not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        joined = bytes([BREAK]).join([b"", *texts, b""])
        data = np.frombuffer(joined, np.uint8)
        starts = np.cumsum([1, *(len(t) + 1 for t in texts[:-1])])
        place, state = self._ends(data)
        text = np.searchsorted(starts, place, side="right") - 1
        if not whole_words:
            key = np.unique(text * len(self.link) + state)
            text, state, place = key // len(self.link), key % len(self.link), np.zeros(len(key), np.int64)
        found = []
        for part in range(0, len(text), _HITS):
            t, s, p = (a[part : part + _HITS] for a in (text, state, place))
            while len(s):
                sizes = self.first[s + 1] - self.first[s]
                rows = np.repeat(np.arange(len(s)), sizes)
                within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                needle = self.by_end[self.first[s][rows] + within]
                good = np.ones(len(rows), bool)
                if whole_words:
                    end = p[rows] + 1
                    good = ~self._touched(joined, data, end - self.lengths[needle], end)
                found.append(np.unique(t[rows][good] * len(self.lengths) + needle[good]))
                s = self.link[s]
                t, p, s = t[s > 0], p[s > 0], s[s > 0]
        key = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return key // len(self.lengths), key % len(self.lengths)

    def _touched(self, joined: bytes, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        before, after = data[start - 1], data[end]
        touched = _ASCII_WORD[before] | _ASCII_WORD[after]
        # Characters of several bytes, one at a time; the break byte is none.
        for k in np.flatnonzero(~touched & ((before > 127) & (before != BREAK) | (after > 127) & (after != BREAK))):
            left = int(start[k]) - 1
            while joined[left] & 0xC0 == 0x80:
                left -= 1
            right = int(end[k]) + 1
            while right < len(joined) and joined[right] & 0xC0 == 0x80:
                right += 1
            sides = joined[left : start[k]], joined[end[k] : right]
            touched[k] = any(side[0] not in (BREAK,) and _is_word(side) for side in sides)
        return touched
