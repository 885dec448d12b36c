"""A suffix automaton over sequences of small integers, for one sequence or many."""

from __future__ import annotations

from collections.abc import Iterable


class SuffixAutomaton:
    """States with transitions, suffix links and lengths; state 0 is the empty string."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def feed(self, symbols: Iterable[int]) -> list[int]:
        """Adds a sequence; gives the state of each of its prefixes."""
        last, own = 0, []
        for symbol in symbols:
            last = self._extend(last, symbol)
            own.append(last)
        return own

    def _state(self, length: int, follows: dict[int, int], link: int) -> int:
        self.next.append(follows)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, at: int, symbol: int, target: int) -> int:
        """A copy of ``target`` for the strings that end ``at`` plus ``symbol``; redirects the suffixes of ``at``."""
        copy = self._state(self.length[at] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while at >= 0 and self.next[at].get(symbol) == target:
            self.next[at][symbol] = copy
            at = self.link[at]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        known = self.next[last].get(symbol)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, symbol, known)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = new
            at = self.link[at]
        if at >= 0:
            target = self.next[at][symbol]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, symbol, target)
        return new

    def by_length(self) -> list[int]:
        """All states, shorter ones first."""
        return sorted(range(len(self.next)), key=self.length.__getitem__)


def repeat_lengths(symbols: list[int], least: int) -> list[int]:
    """For each position the length of the longest string ending there that occurs ``least`` or more times."""
    automaton = SuffixAutomaton()
    own = automaton.feed(symbols)
    count = [0] * len(automaton.next)
    for state in own:
        count[state] += 1
    order = automaton.by_length()
    link, length = automaton.link, automaton.length
    for state in reversed(order[1:]):
        count[link[state]] += count[state]
    reach = [0] * len(count)
    for state in order[1:]:
        reach[state] = length[state] if count[state] >= least else reach[link[state]]
    return [reach[state] for state in own]
