"""A minimised acyclic acceptor of words, and its composition with a one-edit transducer and itself."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class Acceptor:
    """The minimal deterministic acceptor of a sorted list of different words.

    A state is a number; arcs[state] maps a code point to the next state, and final[state] tells whether a word may end
    there. States that accept the same endings are one, so a word with many near words shares its arcs with them.
    """

    def __init__(self, words: Iterable[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        known: dict[tuple, int] = {}
        path: list[int] = [0]  # the states of the last word, still open
        free: list[int] = []
        before = ""

        def close(upto: int) -> None:
            """Give the open states below depth upto their place among the known ones, deepest first."""
            while len(path) > upto + 1:
                state = path.pop()
                sign = (self.final[state], *self.arcs[state].items())
                same = known.setdefault(sign, state)
                if same != state:
                    self.arcs[path[-1]][before[len(path) - 1]] = same
                    free.append(state)

        for word in words:
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            close(shared)
            before = word
            for c in word[shared:]:
                if free:
                    state = free.pop()
                    self.arcs[state], self.final[state] = {}, False
                else:
                    state = len(self.arcs)
                    self.arcs.append({})
                    self.final.append(False)
                self.arcs[path[-1]][c] = state
                path.append(state)
            self.final[path[-1]] = True
        close(0)

    def endings(self, a: int, b: int, not_first: str = "") -> Iterator[str]:
        """The words that both states accept, those that begin with not_first left out."""
        arcs, final = self.arcs, self.final
        todo = [(a, b, "")]
        while todo:
            a, b, seen = todo.pop()
            if final[a] and final[b]:
                yield seen
            x, y = (arcs[a], arcs[b]) if len(arcs[a]) <= len(arcs[b]) else (arcs[b], arcs[a])
            for c, p in x.items():
                q = y.get(c)
                if q is not None and (seen or c != not_first):
                    todo.append((p, q, seen + c))

    def one_edit(self, least: int, most: int) -> Iterator[tuple[str, str]]:
        """Accepted pairs at one edit, each once: those whose first difference lies at depth least or deeper, but below most.

        Up to the edit both words take the same path, so both acceptors are in one state. There the transducer replaces
        one code point by a greater one or inserts one other than the next; behind it, it copies, and the pair is
        accepted where both states accept the rest.
        """
        todo = [(0, "")]
        while todo:
            state, seen = todo.pop()
            arcs = self.arcs[state]
            if len(seen) >= least:
                order = sorted(arcs)
                for i, c in enumerate(order):
                    p = arcs[c]
                    for d in order[i + 1 :]:
                        for rest in self.endings(p, arcs[d]):
                            yield seen + c + rest, seen + d + rest
                    for rest in self.endings(state, p, not_first=c):
                        yield seen + rest, seen + c + rest
            if len(seen) + 1 < most:
                todo.extend((p, seen + c) for c, p in arcs.items())
