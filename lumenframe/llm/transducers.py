"""Small weighted finite-state transducers: composition, and the best path of a sequence."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field


@dataclass
class Transducer:
    """Arcs (symbol in, symbol out, weight, next state) by state; every state but the open ones may be the last.  Weights of a path add; the best path has the largest sum."""

    start: object = 0
    arcs: dict = field(default_factory=lambda: defaultdict(list))
    open: set = field(default_factory=set)

    def arc(self, state, symbol: str, out: str, weight: float, to) -> None:
        self.arcs[state].append((symbol, out, weight, to))

    def compose(self, other: Transducer) -> Transducer:
        """Reads what self reads and writes what other writes for what self writes."""
        made = Transducer((self.start, other.start))
        todo, seen = [made.start], {made.start}
        taking: dict = defaultdict(list)
        for b, arcs in other.arcs.items():
            for taken, out, w, to in arcs:
                taking[b, taken].append((out, w, to))
        while todo:
            a, b = state = todo.pop()
            if a in self.open or b in other.open:
                made.open.add(state)
            for symbol, middle, w1, to_a in self.arcs.get(a, ()):
                for out, w2, to_b in taking.get((b, middle), ()):
                    to = (to_a, to_b)
                    made.arc(state, symbol, out, w1 + w2, to)
                    if to not in seen:
                        seen.add(to)
                        todo.append(to)
        return made

    def compiled(self) -> Compiled:
        states = {self.start: 0}
        for s, arcs in list(self.arcs.items()):
            states.setdefault(s, len(states))
            for *_, to in arcs:
                states.setdefault(to, len(states))
        table: list[dict] = [defaultdict(list) for _ in states]
        for s, arcs in self.arcs.items():
            for symbol, _, w, to in arcs:
                table[states[s]][symbol].append((w, states[to]))
        return Compiled([dict(t) for t in table], frozenset(states[s] for s in self.open if s in states))


@dataclass
class Compiled:
    table: list[dict]
    open: frozenset = frozenset()

    def best(self, symbols) -> float:
        """Largest weight of a path that reads the symbols."""
        now = {0: 0.0}
        for symbol in symbols:
            after: dict[int, float] = {}
            for state, weight in now.items():
                for w, to in self.table[state].get(symbol, ()):
                    if (new := weight + w) > after.get(to, float("-inf")):
                        after[to] = new
            now = after
        return max((w for state, w in now.items() if state not in self.open), default=float("-inf"))
