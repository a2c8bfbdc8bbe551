"""Finite-state transducers that turn each symbol into one symbol, and their composition."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable
from dataclasses import dataclass


@dataclass(frozen=True)
class Transducer:
    """arcs[state][symbol] is (symbol out, next state); states are numbered from the start state 0."""

    arcs: tuple[tuple[tuple[int, int], ...], ...]

    @staticmethod
    def from_rule(start: Hashable, symbols: int, rule: Callable[[Hashable, int], tuple[int, Hashable]]) -> Transducer:
        """The states that the rule reaches from start."""
        number, todo, arcs = {start: 0}, [start], []
        for state in todo:  # grows while it is read
            row = []
            for symbol in range(symbols):
                out, then = rule(state, symbol)
                if then not in number:
                    number[then] = len(number)
                    todo.append(then)
                row.append((out, number[then]))
            arcs.append(tuple(row))
        return Transducer(tuple(arcs))

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one puts out, the other one takes in."""

        def rule(state: tuple[int, int], symbol: int) -> tuple[int, tuple[int, int]]:
            middle, a = self.arcs[state[0]][symbol]
            out, b = other.arcs[state[1]][middle]
            return out, (a, b)

        return Transducer.from_rule((0, 0), len(self.arcs[0]), rule)

    def smallest(self) -> Transducer:
        """The least transducer that does the same: states that no input tells apart are merged."""
        block = [0] * len(self.arcs)
        while True:
            signs = [(b, tuple((o, block[t]) for o, t in row)) for b, row in zip(block, self.arcs, strict=True)]
            number: dict = {}
            new = [number.setdefault(s, len(number)) for s in signs]
            if len(number) == len(set(block)):
                break
            block = new
        arcs: list = [None] * (max(block) + 1)
        for b, row in zip(block, self.arcs, strict=True):
            arcs[b] = tuple((o, block[t]) for o, t in row)
        return Transducer(tuple(arcs))

    def run(self, symbols: Iterable[int]) -> list[int]:
        state, out = 0, []
        for symbol in symbols:
            made, state = self.arcs[state][symbol]
            out.append(made)
        return out


def compose(*parts: Transducer) -> Transducer:
    """All parts one after another, as one transducer."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.then(part).smallest()
    return whole
