"""Regexes to one minimal automaton over bytes: Thompson construction, subsets, minimisation."""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from collections import defaultdict
from dataclasses import dataclass

import numpy as np

MAXREPEAT = sre_parser.MAXREPEAT


class _Nfa:
    """States with edges on byte sets and empty edges."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, tree, at: int, fold: bool) -> int:
        """Append a parsed regex after state ``at``; the state where it ends."""
        for op, arg in tree:
            if op is sre.LITERAL:
                at = self._step(at, self._folded({arg}, fold))
            elif op is sre.ANY:
                at = self._step(at, frozenset(range(256)) - {10})
            elif op is sre.IN:
                at = self._step(at, self._set(arg, fold))
            elif op is sre.SUBPATTERN:
                _, on, off, inner = arg
                at = self.add(inner, at, (fold or bool(on & sre.SRE_FLAG_IGNORECASE)) and not off & sre.SRE_FLAG_IGNORECASE)
            elif op is sre.BRANCH:
                end = self.state()
                for branch in arg[1]:
                    self.empty[self.add(branch, at, fold)].append(end)
                at = end
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                at = self._repeat(arg, at, fold)
            else:
                raise ValueError(f"not a regular construct: {op}")
        return at

    def _repeat(self, arg, at: int, fold: bool) -> int:
        least, most, inner = arg
        for _ in range(least):
            at = self.add(inner, at, fold)
        if most is MAXREPEAT:
            loop = self.state()
            self.empty[at].append(loop)
            self.empty[self.add(inner, loop, fold)].append(loop)
            return loop
        end = self.state()
        for _ in range(most - least):
            self.empty[at].append(end)
            at = self.add(inner, at, fold)
        self.empty[at].append(end)
        return end

    def _step(self, at: int, on: frozenset[int]) -> int:
        to = self.state()
        self.moves[at].append((on, to))
        return to

    @staticmethod
    def _folded(values: set[int], fold: bool) -> frozenset[int]:
        if fold:
            values |= {v ^ 32 for v in values if 65 <= v & ~32 <= 90}
        return frozenset(values)

    def _set(self, parts, fold: bool) -> frozenset[int]:
        values: set[int] = set()
        negated = False
        for op, arg in parts:
            if op is sre.NEGATE:
                negated = True
            elif op is sre.LITERAL:
                values.add(arg)
            elif op is sre.RANGE:
                values |= set(range(arg[0], arg[1] + 1))
            else:
                raise ValueError(f"not a plain class: {op}")
        values = set(self._folded(values, fold))
        return frozenset(set(range(256)) - values if negated else values)

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """``table[state * n_classes + class_of[byte]]`` is the next state; ``accepting`` absorbs.

    State 0 is the start. ``resets`` marks bytes after which every state but the accepting one is
    the start again: no match spans such a byte.
    """

    class_of: np.ndarray
    table: np.ndarray
    n_classes: int
    accepting: int
    resets: np.ndarray


def compile_search(patterns: list[bytes]) -> Automaton:
    """One automaton that accepts as soon as any pattern has matched somewhere."""
    nfa = _Nfa()
    start = nfa.state()
    ends = {nfa.add(sre_parser.parse(p), start, False) for p in patterns}

    sets = {on for moves in nfa.moves for on, _ in moves}
    signature = defaultdict(list)
    for byte in range(256):
        signature[tuple(byte in s for s in sets)].append(byte)
    class_of = np.zeros(256, np.uint8)
    members = list(signature.values())
    for k, group in enumerate(members):
        class_of[group] = k

    # Where each state goes on each class, empty edges followed.
    step: list[dict[int, frozenset[int]]] = [{} for _ in nfa.moves]
    for s, moves in enumerate(nfa.moves):
        for on, to in moves:
            reached = nfa.closure({to})
            for k, group in enumerate(members):
                if group[0] in on:
                    step[s][k] = step[s].get(k, frozenset()) | reached

    # Subsets; the start is always among them, so a match may begin at any byte.
    first = nfa.closure({start})
    index: dict[frozenset[int] | None, int] = {first: 0}
    rows: list[list[int]] = []
    todo = [first]
    while todo:
        now, row = todo.pop(), []
        active = [step[s] for s in now if step[s]]
        for k in range(len(members)):
            after = first.union(*(t[k] for t in active if k in t))
            key = None if after & ends else after
            if key not in index:
                index[key] = len(index)
                if key is not None:
                    todo.append(key)
            row.append(index[key])
        while len(rows) <= index[now]:
            rows.append([])
        rows[index[now]] = row
    n = len(index)
    accepting = index.get(None, -1)
    rows += [[]] * (n - len(rows))
    table = np.array([r or [i] * len(members) for i, r in enumerate(rows)], np.int64)

    # Minimisation: split blocks by the blocks that their transitions lead to, until none splits.
    block = np.zeros(n, np.int64)
    if accepting >= 0:
        block[accepting] = 1
    while True:
        seen: dict[bytes, int] = {}
        marks = np.column_stack([block, block[table]]).astype(np.int32)
        new = np.array([seen.setdefault(m.tobytes(), len(seen)) for m in marks])
        if new.max() == block.max():
            break
        block = new
    order = {int(block[0]): 0}
    for b in block:
        order.setdefault(int(b), len(order))
    number = np.array([order[int(b)] for b in block])
    small = np.zeros((len(order), len(members)), np.int32)
    small[number] = number[table]
    accept = int(number[accepting]) if accepting >= 0 else -1
    others = [s for s in range(len(order)) if s != accept]
    resets = (small[others] == 0).all(axis=0)[class_of]
    return Automaton(class_of, small.reshape(-1), len(members), accept, resets)


def flagged_stretches(auto: Automaton, data: np.ndarray, lanes: int = 4096) -> list[tuple[int, int]]:
    """Stretches of ``data`` (ending after a reset byte or at the end) that hold a match.

    One pass over the bytes: the data are cut after reset bytes into many stretches, which are
    walked side by side. A stretch without reset bytes is walked whole, however long.
    """
    n = len(data)
    if not n or auto.accepting < 0:
        return []
    ends = np.flatnonzero(auto.resets[data]) + 1
    marks = np.searchsorted(ends, np.arange(0, n, max(64, n // lanes)))
    starts = np.unique(np.concatenate([[0], ends[marks[marks < len(ends)]]]))
    starts = starts[starts < n]
    length = np.diff(np.append(starts, n))
    order = np.argsort(-length, kind="stable")
    at, length = starts[order], length[order]
    classes = auto.class_of[data]
    state = np.zeros(len(at), np.int32)
    active = len(at)
    falling = -length
    for step in range(int(length[0])):
        active = int(np.searchsorted(falling, -step, side="left"))
        now = classes[at[:active] + step]
        state[:active] = auto.table[state[:active] * auto.n_classes + now]
    hit = state == auto.accepting
    return [(int(s), int(s + w)) for s, w in zip(at[hit], length[hit], strict=True)]
