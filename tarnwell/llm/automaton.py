"""Rule regexes compiled into one minimal deterministic automaton over bytes, and its scan over many texts at once.

Supported: literals, ``\\xNN`` and escaped characters, classes, groups, ``|``, ``?``, ``*``, ``+``. Each rule becomes an
NFA whose states are kept in the order of preference, so that the leftmost and then greediest match is followed; subset construction
over these ordered lists gives its automaton. The automata of all rules run side by side as one product, which is minimised.
"""

from __future__ import annotations

import numpy as np

#: A byte that no UTF-8 text has; it stands between texts and sends the automaton back to its start.
BREAK = 0xFF


# --- syntax: a tree of ("set", bytes), ("cat", parts), ("alt", parts), ("repeat", part, least, greatest or None) ----


class _Parser:
    def __init__(self, pattern: str, either_case: bool):
        self.p, self.i, self.either_case = pattern, 0, either_case

    def tree(self):
        out = self._alternatives()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} in rule {self.p!r}")
        return out

    def _peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def _alternatives(self):
        parts = [self._sequence()]
        while self._peek() == "|":
            self.i += 1
            parts.append(self._sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def _sequence(self):
        parts = []
        while self._peek() not in ("", "|", ")"):
            parts.append(self._repeated())
        return ("cat", parts)

    def _repeated(self):
        atom = self._atom()
        bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}
        while self._peek() and self._peek() in bounds:
            atom = ("repeat", atom, *bounds[self._peek()])
            self.i += 1
        return atom

    def _set(self, chars: set[int]):
        if self.either_case:
            chars = chars | {c ^ 32 for c in chars if 65 <= c & ~32 <= 90}
        return ("set", frozenset(chars))

    def _character(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == "\\":
            c = self.p[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.p[self.i - 2 : self.i], 16)
            if c.isalnum():
                raise ValueError(f"\\{c} is not supported in rule {self.p!r}")
        if ord(c) > 127:
            raise ValueError(f"rule {self.p!r} is not ASCII")
        return ord(c)

    def _atom(self):
        c = self._peek()
        if c == "(":
            self.i += 1
            inner = self._alternatives()
            if self._peek() != ")":
                raise ValueError(f"unclosed group in rule {self.p!r}")
            self.i += 1
            return inner
        if c == "[":
            self.i += 1
            chars: set[int] = set()
            while self._peek() != "]":
                low = high = self._character()
                if self._peek() == "-" and self.p[self.i + 1 : self.i + 2] not in ("]", ""):
                    self.i += 1
                    high = self._character()
                chars |= set(range(low, high + 1))
            self.i += 1
            return self._set(chars)
        if c in "*+?.^${}":
            raise ValueError(f"{c!r} is not supported here in rule {self.p!r}")
        return self._set({self._character()})


def parse(pattern: str, either_case: bool = False):
    return _Parser(pattern, either_case).tree()


def backwards(tree):
    """The tree of the reversed language."""
    kind = tree[0]
    if kind == "cat":
        return ("cat", [backwards(t) for t in reversed(tree[1])])
    if kind == "alt":
        return ("alt", [backwards(t) for t in tree[1]])
    return ("repeat", backwards(tree[1]), *tree[2:]) if kind == "repeat" else tree


def lengths(tree) -> tuple[int, float]:
    """Fewest and most bytes of a match."""
    kind = tree[0]
    if kind == "set":
        return 1, 1
    if kind == "repeat":
        low, high = lengths(tree[1])
        return low * tree[2], float("inf") if tree[3] is None else high * tree[3]
    each = [lengths(t) for t in tree[1]]
    if kind == "cat":
        return sum(x for x, _ in each), sum(x for _, x in each)
    return min(x for x, _ in each), max(x for _, x in each)


def once(tree):
    """The tree with a closing one-or-more repeat taken once: what a match has when it is first complete."""
    if tree[0] == "cat" and tree[1] and tree[1][-1][0] == "repeat" and tree[1][-1][2:] == (1, None):
        return ("cat", [*tree[1][:-1], tree[1][-1][1]])
    return tree


# --- one rule --------------------------------------------------------------------------------


class _Nfa:
    def __init__(self, tree):
        self.sets: list[frozenset[int] | None] = []  # what a state reads; None: it splits
        self.next: list[tuple[int, ...]] = []
        self.match = self._new(None, ())
        self.start = self._build(tree, self.match)

    def _new(self, reads, to) -> int:
        self.sets.append(reads)
        self.next.append(to)
        return len(self.sets) - 1

    def _build(self, tree, to: int) -> int:
        kind = tree[0]
        if kind == "set":
            return self._new(tree[1], (to,))
        if kind == "cat":
            for part in reversed(tree[1]):
                to = self._build(part, to)
            return to
        if kind == "alt":
            return self._new(None, tuple(self._build(t, to) for t in tree[1]))
        _, part, least, most = tree
        if most is None:
            loop = self._new(None, ())
            inner = self._build(part, loop)
            self.next[loop] = (inner, to)
            return inner if least else loop
        return self._new(None, (self._build(part, to), to))

    def closure(self, states) -> tuple[int, ...]:
        """Reading states in order of preference; what comes after a match is cut."""
        out: dict[int, None] = {}
        seen: set[int] = set()

        def visit(s: int) -> bool:
            if s in seen:
                return False
            seen.add(s)
            if s == self.match:
                out[s] = None
                return True
            if self.sets[s] is not None:
                out[s] = None
                return False
            return any(visit(t) for t in self.next[s])

        for s in states:
            if visit(s):
                break
        return tuple(out)

    def step(self, states: tuple[int, ...], byte: int) -> tuple[int, ...]:
        return self.closure([self.next[s][0] for s in states if self.sets[s] and byte in self.sets[s]])


def _scanner(nfa: _Nfa):
    """Start, step and acceptance of the automaton that finds leftmost matches one after another."""
    begin = nfa.closure([nfa.start])
    if nfa.match in begin:
        raise ValueError("a rule must not match the empty text")

    def with_start(states):
        return states if nfa.match in states else tuple(dict.fromkeys((*states, *begin)))

    def step(states, byte):
        after = nfa.step(states, byte)
        if nfa.match in states:
            if after and nfa.match not in after:
                raise ValueError("a rule must not need to look back beyond the end of a match")
            if not after:  # the match ended before this byte
                after = nfa.step(begin, byte)
                if nfa.match in after:
                    raise ValueError("a match must not follow another without a byte between")
        return with_start(after)

    return begin, step, lambda states: nfa.match in states


def _prefix_reader(tree):
    """Steps over the reversed text from the end of a match; says after each byte whether a match begins there."""
    nfa = _Nfa(backwards(once(tree)))
    begin = nfa.start

    def all_states(states):
        out, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in out:
                out.add(s)
                if nfa.sets[s] is None:
                    todo += nfa.next[s]
        return frozenset(out)

    def start_of(data: bytes, end: int, least: int) -> int:
        """The leftmost start, not before ``least``, of a match that ends at ``end``."""
        states, found = all_states([begin]), -1
        for i in range(end - 1, least - 1, -1):
            byte = data[i]
            states = all_states(nfa.next[s][0] for s in states if nfa.sets[s] and byte in nfa.sets[s])
            if not states:
                break
            if nfa.match in states:
                found = i
        return found

    return start_of


# --- all rules -------------------------------------------------------------------------------


class Automaton:
    """Transition arrays of the minimal product automaton; ``accepts`` has a bit for each rule inside a match's closing part."""

    def __init__(self, trees: list):
        if not 0 < len(trees) <= 8:
            raise ValueError("one automaton takes one to eight rules")
        rules = [_scanner(_Nfa(t)) for t in trees]
        self.trees = trees
        self.starts_of = [_prefix_reader(t) for t in trees]
        start = tuple(r[0] for r in rules)
        numbers, order, table = {start: 0}, [start], []
        memo: list[dict] = [{} for _ in rules]
        for state in order:  # grows as states are found
            row = []
            for byte in range(256):
                if byte == BREAK:
                    to = start
                else:
                    parts = []
                    for k, (_, step, _) in enumerate(rules):
                        key = (state[k], byte)
                        if key not in memo[k]:
                            memo[k][key] = step(state[k], byte)
                        parts.append(memo[k][key])
                    to = tuple(parts)
                if to not in numbers:
                    numbers[to] = len(order)
                    order.append(to)
                row.append(numbers[to])
            table.append(row)
        bits = np.array([sum(int(r[2](s[k])) << k for k, r in enumerate(rules)) for s in order], np.uint8)
        self._minimise(np.array(table, np.int64), bits)

    def _minimise(self, table: np.ndarray, bits: np.ndarray) -> None:
        """Moore's refinement: states stay together as long as their outputs and the classes of their successors agree."""
        _, part = np.unique(bits, return_inverse=True)
        while True:
            _, finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)
            finer = finer.ravel()
            if finer.max() == part.max():
                break
            part = finer
        n = int(part.max()) + 1
        _, first = np.unique(part, return_index=True)
        swap = np.arange(n)
        swap[part[0]], swap[0] = 0, part[0]  # the start is state 0
        small = np.empty((n, 256), np.int64)
        small[swap] = swap[part[table[first]]]
        accepts = np.empty(n, np.uint8)
        accepts[swap] = bits[first]
        columns, self.classes = np.unique(small, axis=1, return_inverse=True)
        self.classes = self.classes.ravel().astype(np.int32)
        self.states, self.width = n, columns.shape[1]
        self.table = (columns * self.width).astype(np.int32).ravel()  # numbers of states come multiplied by the row width
        self.accepts = np.repeat(accepts, self.width)

    def scan(self, data: np.ndarray, lanes: int = 4_096) -> np.ndarray:
        """The accept bits after each byte, in one pass.

        The data are cut into lanes that advance together. A lane begins in the start state; where the lane before
        ends in another, it is run again until it is in the state that it was in before, mostly a few bytes.
        """
        n = len(data)
        if not n:
            return np.zeros(0, np.uint8)
        lanes = max(1, min(lanes, n // 64))
        length = -(-n // lanes)
        padded = np.full(lanes * length, BREAK, np.uint8)
        padded[:n] = data
        symbols = np.ascontiguousarray(self.classes[padded].reshape(lanes, length).T)
        seen = np.empty((length, lanes), np.int32)
        state = np.zeros(lanes, np.int32)
        for t in range(length):
            state = self.table.take(state + symbols[t])
            seen[t] = state
        assumed = np.zeros(lanes, np.int32)
        while True:
            true = np.append(np.int32(0), seen[-1, :-1])
            wrong = np.flatnonzero(true != assumed)
            if not len(wrong):
                break
            assumed = true
            state = true[wrong]
            for t in range(length):
                state = self.table.take(state + symbols[t, wrong])
                differ = state != seen[t, wrong]
                seen[t, wrong] = state
                wrong, state = wrong[differ], state[differ]
                if not len(wrong):
                    break
        return np.ascontiguousarray(self.accepts[seen].T).ravel()[:n]
