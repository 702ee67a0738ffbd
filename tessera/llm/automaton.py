"""Byte automata: rules built from a few combinators, subset construction, minimisation, and a scan
that runs one transition array over a whole slice of texts.

A rule is a nondeterministic automaton fragment: ``chars``, ``seq``, ``alt``, ``opt``, ``star``,
``repeat``. ``compile_rules`` joins all rules behind a loop over any byte, so one pass finds where
matches of each rule end, anywhere in a text. Compiled backwards and without the loop, the same rules give the places
where a match with a known end can start.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Nfa:
    """States with byte-class moves and empty moves."""

    moves: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1


def chars(*ranges: str):
    """One byte of the ranges: "a-z" or single characters."""
    own: set[int] = set()
    for r in ranges:
        own |= set(range(ord(r[0]), ord(r[2]) + 1)) if len(r) == 3 and r[1] == "-" else {ord(c) for c in r}
    kind = frozenset(own)

    def build(nfa: Nfa, start: int, back: bool = False) -> int:
        end = nfa.state()
        nfa.moves[start].append((kind, end))
        return end

    return build


def word(text: str, fold: bool = False):
    """The text, with ``fold`` in either case of its ASCII letters."""
    return seq(*[chars(c.lower(), c.upper()) if fold else chars(c) for c in text])


def seq(*parts):
    def build(nfa: Nfa, start: int, back: bool = False) -> int:
        for p in reversed(parts) if back else parts:
            start = p(nfa, start, back)
        return start

    return build


def alt(*parts):
    def build(nfa: Nfa, start: int, back: bool = False) -> int:
        end = nfa.state()
        for p in parts:
            nfa.empty[p(nfa, start, back)].append(end)
        return end

    return build


def opt(part):
    def build(nfa: Nfa, start: int, back: bool = False) -> int:
        end = part(nfa, start, back)
        out = nfa.state()
        nfa.empty[start].append(out)
        nfa.empty[end].append(out)
        return out

    return build


def star(part):
    def build(nfa: Nfa, start: int, back: bool = False) -> int:
        loop = nfa.state()
        nfa.empty[start].append(loop)
        nfa.empty[part(nfa, loop, back)].append(loop)
        out = nfa.state()
        nfa.empty[loop].append(out)
        return out

    return build


def repeat(part, n: int):
    return seq(*[part] * n)


@dataclass
class Automaton:
    """``classes``: the column of each byte; ``table``: next state by state and column, flat; ``accept``: a
    bit for each rule that ends in a state. State 0 is the start."""

    classes: np.ndarray
    table: np.ndarray
    accept: np.ndarray
    width: int

    @property
    def dead(self) -> int:
        """The state that accepts nothing and that nothing leaves, -1 for none."""
        own = np.arange(len(self.accept))
        stuck = (self.table.reshape(-1, self.width) == own[:, None]).all(axis=1) & (self.accept == 0)
        return int(np.argmax(stuck)) if stuck.any() else -1

    def __len__(self) -> int:
        return len(self.accept)


def compile_rules(rules: list, back: bool = False) -> Automaton:
    """One minimal deterministic automaton for "some rule ends here", for all rules together; ``back``: for the rules
    read from a match's end to its start, which ends in the dead state ``dead``."""
    nfa = Nfa()
    start = nfa.state()
    ends = {}
    for k, rule in enumerate(rules):
        own = nfa.state()
        nfa.empty[start].append(own)
        ends[rule(nfa, own, back)] = k
    kinds: dict[tuple, int] = {}
    sets = sorted({kind for moves in nfa.moves for kind, _ in moves}, key=sorted)
    classes = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)])
    sample = {c: b for b, c in reversed(list(enumerate(classes.tolist())))}

    def closed(state: int) -> int:
        """What empty moves reach from a state, as a mask of states."""
        seen, todo = 1 << state, [state]
        while todo:
            for t in nfa.empty[todo.pop()]:
                if not seen >> t & 1:
                    seen |= 1 << t
                    todo.append(t)
        return seen

    reach = [closed(k) for k in range(len(nfa.empty))]
    loop = 0 if back else reach[start]
    step = []  # by state: the columns it moves on, with the states reached
    for moves in nfa.moves:
        own: dict[int, int] = {}
        for kind, t in moves:
            for c, b in sample.items():
                if b in kind:
                    own[c] = own.get(c, 0) | reach[t]
        step.append(tuple(own.items()))
    number, queue, table, accept = {reach[start]: 0}, deque([reach[start]]), [], []
    while queue:
        mask, row, rules_here = queue.popleft(), [loop] * len(kinds), 0
        while mask:
            low = mask & -mask
            mask ^= low
            state = low.bit_length() - 1
            rules_here |= 1 << ends[state] if state in ends else 0
            for c, to in step[state]:
                row[c] |= to
        accept.append(rules_here)
        for to in row:
            if to not in number:
                number[to] = len(number)
                queue.append(to)
        table.append([number[to] for to in row])
    return _minimal(np.array(table), np.array(accept), classes)


def _minimal(table: np.ndarray, accept: np.ndarray, classes: np.ndarray) -> Automaton:
    """Merges states of equal behaviour: blocks by what they accept, split by where they lead until none splits."""
    block = np.unique(accept, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    order = np.full(block.max() + 1, -1)
    _, firsts = np.unique(block, return_index=True)
    rank = np.argsort(np.argsort(np.where(np.arange(len(firsts)) == block[0], -1, firsts)))
    lead = firsts[np.argsort(rank)]
    order = rank
    small = order[block[table[lead]]]
    return Automaton(classes.astype(np.uint8), small.astype(np.int32).ravel(), accept[lead], table.shape[1])


LANE = 2048


def scan(auto: Automaton, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs the automaton over the bytes once: the positions whose state accepts, and the rules' bits there.

    The bytes lie in lanes that advance together, a column at a time. Each lane starts at the start
    state; a lane whose predecessor ended in another state is run again from there, which stops as
    soon as it meets the states of its first run.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lane = min(LANE, n)
    lanes = -(-n // lane)
    columns = np.zeros(lanes * lane, np.uint8)
    columns[:n] = auto.classes[data]
    columns = np.ascontiguousarray(columns.reshape(lanes, lane).T)
    states = np.empty((lane, lanes), np.int32)
    width, table = auto.width, auto.table
    now = np.zeros(lanes, np.int32)
    for k in range(lane):
        now = table[now * width + columns[k]]
        states[k] = now
    again = np.flatnonzero(states[-1, :-1] != 0) + 1
    while len(again):
        live, now, ends = again, states[-1, again - 1], states[-1, again].copy()
        for k in range(lane):
            now = table[now * width + columns[k, live]]
            differs = now != states[k, live]
            if not differs.any():
                break
            live, now = live[differs], now[differs]
            states[k, live] = now
        changed = again[states[-1, again] != ends]
        again = changed[changed + 1 < lanes] + 1
    flat = states.T.ravel()[:n]
    hits = np.flatnonzero(auto.accept[flat] > 0)
    return hits, auto.accept[flat[hits]]


STEPS = 4096


def starts(auto: Automaton, data: np.ndarray, ends: np.ndarray, rules: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(match, place): from each end (exclusive) the backward automaton reads towards the start; every place where
    the match's rule can start. All matches step together; the few that are long go on alone."""
    dead, found_match, found_place = auto.dead, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    live, at, state = np.arange(len(ends)), ends.astype(np.int64) - 1, np.zeros(len(ends), np.int64)
    for _ in range(STEPS):
        ok = (at >= 0) & (state != dead)
        live, at, state = live[ok], at[ok], state[ok]
        if not len(live):
            break
        state = auto.table[state * auto.width + auto.classes[data[at]]].astype(np.int64)
        hit = auto.accept[state] >> rules[live] & 1 > 0
        found_match.append(live[hit])
        found_place.append(at[hit])
        at = at - 1
    table, classes, accept = auto.table.tolist(), auto.classes.tolist(), auto.accept.tolist()
    for m, a, s in zip(live.tolist(), at.tolist(), state.tolist(), strict=True):
        own, raw, rule = [], data[: a + 1].tobytes(), int(rules[m])
        while a >= 0 and s != dead:
            s = table[s * auto.width + classes[raw[a]]]
            if accept[s] >> rule & 1:
                own.append(a)
            a -= 1
        found_match.append(np.full(len(own), m))
        found_place.append(np.array(own, np.int64))
    return np.concatenate(found_match), np.concatenate(found_place)
