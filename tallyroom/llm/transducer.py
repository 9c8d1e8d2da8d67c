"""Minimal acyclic transducer: sorted keys share prefixes and endings, and a walk gives a key's ordinal.

Keys are byte strings. An arc carries how many keys come before those that go through it, so the sum over
a walk is the key's place in ascending byte order. Arcs lie in one slot table by row displacement: the arc
of a state for a byte is at ``base[state] + byte`` if ``check`` there names the state.
"""

from __future__ import annotations

import dataclasses
import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from tallyroom.llm import common

#: Places that a state of several arcs tries before the search moves on for all later states.
TRIES = 64


@dataclasses.dataclass
class Transducer:
    """``size`` keys; per state ``base`` and ``final``; per slot ``check``, ``target`` and ``before``."""

    size: int
    root: int
    base: np.ndarray
    final: np.ndarray
    check: np.ndarray
    target: np.ndarray
    before: np.ndarray

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.base, self.final, self.check, self.target, self.before))

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, head=np.array([self.size, self.root]), **{f.name: getattr(self, f.name) for f in dataclasses.fields(self)[2:]})
        return out.getvalue()

    @staticmethod
    def loads(data: bytes) -> Transducer:
        parts = np.load(io.BytesIO(data))
        size, root = parts["head"].tolist()
        return Transducer(size, root, *(parts[f.name] for f in dataclasses.fields(Transducer)[2:]))

    def prefix(self, key: bytes) -> tuple[int, int]:
        """State and ordinal so far after ``key`` from the root; state -1 if no key starts with it."""
        state, place = self.root, 0
        for byte in key:
            slot = int(self.base[state]) + byte
            if self.check[slot] != state:
                return -1, 0
            state, place = int(self.target[slot]), place + int(self.before[slot])
        return state, place

    def ordinals(self, data: np.ndarray, starts: np.ndarray, state: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Ordinals of the words of ``data`` that begin at ``starts`` and end before a 0 byte; -1 for no key.

        All words go through the transducer in lock step, each from its own ``state`` and ``place``.
        """
        found = np.full(len(starts), -1, np.int64)
        row = np.flatnonzero(state >= 0)
        at, state, place = starts[row], state[row], place[row]
        while len(row):
            byte = data[at]
            ends = byte == 0
            if ends.any():
                done = ends & self.final[state]
                found[row[done]] = place[done]
                on = ~ends
                row, at, state, place, byte = row[on], at[on], state[on], place[on], byte[on]
            slot = self.base[state] + byte
            on = np.flatnonzero(self.check[slot] == state)
            slot = slot[on]
            row, at, state, place = row[on], at[on] + 1, self.target[slot], place[on] + self.before[slot]
        return found

    def key(self, ordinal: int) -> bytes:
        """The key of an ordinal: at each state the last arc that is not past it."""
        state, left, out = self.root, ordinal, bytearray()
        while True:
            slots = int(self.base[state]) + np.arange(256)
            slots = slots[self.check[slots] == state]
            slots = slots[self.before[slots] <= left]
            if not len(slots) or (self.final[state] and left == 0):
                return bytes(out)
            slot = int(slots[-1])
            out.append(slot - int(self.base[state]))
            left -= int(self.before[slot])
            state = int(self.target[slot])


def built(keys: Iterable[bytes]) -> Transducer:
    """The transducer of distinct keys in ascending order.

    The path of the last key stays open; what the next key leaves is closed from its end, and a closed
    state equal to an earlier one (finality, arcs) is that one.
    """
    known: dict[tuple, int] = {}
    states: list[tuple[bool, bytes, tuple[int, ...]]] = []
    counts: list[int] = []

    def close(node: list) -> int:
        state = (node[0], bytes(node[1]), tuple(node[2]))
        if state not in known:
            known[state] = len(states)
            states.append(state)
            counts.append(state[0] + sum(counts[t] for t in state[2]))
        return known[state]

    path, last = [[False, bytearray(), []]], b""
    for key in keys:
        same, most = 0, min(len(key), len(last))
        while same < most and key[same] == last[same]:
            same += 1
        while len(path) - 1 > same:
            node = path.pop()
            path[-1][2].append(close(node))
        for byte in key[same:]:
            path[-1][1].append(byte)
            path.append([False, bytearray(), []])
        path[-1][0], last = True, key
    while len(path) > 1:
        node = path.pop()
        path[-1][2].append(close(node))
    return _slotted(states, counts, close(path[0]))


def _slotted(states: list[tuple[bool, bytes, tuple[int, ...]]], counts: list[int], root: int) -> Transducer:
    """Arcs dealt to slots: states of many arcs first, each at the first place where all its arcs are free."""
    used = bytearray(1024)
    base = np.zeros(len(states), np.int64)
    low = 256  # so that no base is below 0
    for s in sorted(range(len(states)), key=lambda i: -len(states[i][1])):
        labels = states[s][1]
        if not labels:
            continue
        slot, tries = used.find(0, low), 0
        while True:
            if len(used) < slot + 1024:
                used.extend(bytes(max(len(used), 1024)))
            if all(not used[slot - labels[0] + x] for x in labels):
                break
            slot, tries = used.find(0, slot + 1), tries + 1
            if tries == TRIES:
                low = slot
        base[s] = slot - labels[0]
        for x in labels:
            used[base[s] + x] = 1
    size = int(base.max(initial=0)) + 512
    check, target, before = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int64)
    for s, (final, labels, targets) in enumerate(states):
        place = int(final)
        for x, t in zip(labels, targets, strict=True):
            slot = base[s] + x
            check[slot], target[slot], before[slot] = s, t, place
            place += counts[t]
    return Transducer(counts[root], root, base, np.array([x[0] for x in states], bool), check, target, before)


def words(texts: pa.Array | pa.ChunkedArray, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of about 0.5 MB of a column: (bytes with a 0 after each row, starts of words, their rows).

    ``table`` maps separators to 0; a word is a longest run of other bytes within one row.
    """
    raw, rows = common.utf8(texts)
    cuts = common._cuts(raw, rows, table)
    for a, b in zip(cuts, cuts[1:], strict=False):
        inner = rows[np.searchsorted(rows, a, "right") : np.searchsorted(rows, b, "left")] - a
        data = np.append(np.insert(table[raw[a:b]], inner, 0), np.uint8(0))
        begin = data != 0
        begin[1:] &= data[:-1] == 0
        starts = np.flatnonzero(begin)
        # a row's bytes are moved by the rows that end before it
        moved = inner + np.arange(len(inner))
        first = int(np.searchsorted(rows, a, "right")) - 1
        yield data, starts, first + np.searchsorted(moved, starts, "right")
