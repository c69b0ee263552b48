"""Minimised acceptors of word lists, and their composition with a one-edit transducer."""

from __future__ import annotations

from collections.abc import Iterator

_RING = (1 << 64) - 1


class Acceptor:
    """The smallest automaton without loops that accepts the given distinct words, sorted by code point.

    ``steps[q]`` maps a letter to the next state, ``ends[q]`` tells whether a word may end in ``q``, and
    ``lengths[q]`` has a bit for every length, modulo 64, of what can follow.
    """

    def __init__(self, words: list[str]):
        self.steps: list[dict[str, int]] = [{}]
        self.ends, self.lengths = [False], [0]
        self._known: dict[tuple, int] = {}
        open_: list[tuple[int, str, int]] = []  # the last word's states that have no double looked up yet
        last = ""
        for word in words:
            same, most = 0, min(len(word), len(last))
            while same < most and word[same] == last[same]:
                same += 1
            self._settle(open_, same)
            state = open_[-1][2] if open_ else 0
            for letter in word[same:]:
                self.steps.append({})
                self.ends.append(False)
                self.lengths.append(0)
                self.steps[state][letter] = len(self.steps) - 1
                open_.append((state, letter, len(self.steps) - 1))
                state = len(self.steps) - 1
            self.ends[state] = True
            last = word
        self._settle(open_, 0)
        self.lengths[0] = self._reach(0)
        del self._known

    def _reach(self, state: int) -> int:
        reach = 1 if self.ends[state] else 0
        for to in self.steps[state].values():
            reach |= (self.lengths[to] << 1 | self.lengths[to] >> 63) & _RING
        return reach

    def _settle(self, open_: list[tuple[int, str, int]], keep: int) -> None:
        """Replace the open states beyond ``keep`` by equal ones that are known, from the end of the word on."""
        while len(open_) > keep:
            state, letter, to = open_.pop()
            form = (self.ends[to], tuple(self.steps[to].items()))
            known = self._known.setdefault(form, to)
            if known == to:
                self.lengths[to] = self._reach(to)
            else:
                self.steps[state][letter] = known
                if to == len(self.steps) - 1:
                    self.steps.pop(), self.ends.pop(), self.lengths.pop()


class OneEdit:
    """Pairs accepted by the acceptor composed with a one-edit transducer and the acceptor again.

    A state of the composition is a state twice while nothing has been edited, and two states after the
    edit, from which both sides read the same letters. Each pair is given once: of two replaced letters
    the smaller is on the left, and an inserted letter is taken at its leftmost place, where it differs
    from the letter before it.
    """

    def __init__(self, acceptor: Acceptor):
        self.machine = acceptor
        self._meets: dict[tuple[int, int], bool] = {}
        self._edits: dict[int, list[tuple[str, str, int, int]]] = {}

    def _onward(self, a: int, b: int) -> list[tuple[int, int]]:
        steps, lengths = self.machine.steps, self.machine.lengths
        left, right = steps[a], steps[b]
        if len(right) < len(left):
            return [(left[c], q) for c, q in right.items() if c in left and lengths[left[c]] & lengths[q]]
        return [(q, right[c]) for c, q in left.items() if c in right and lengths[q] & lengths[right[c]]]

    def meets(self, a: int, b: int) -> bool:
        """Whether some rest is accepted from both states."""
        known, ends, lengths = self._meets, self.machine.ends, self.machine.lengths
        if a == b:
            return True
        if not lengths[a] & lengths[b]:
            return False
        if (a, b) in known:
            return known[a, b]
        stack = [((a, b), iter(self._onward(a, b)))]
        found = ends[a] and ends[b]
        while stack and not found:
            for new in stack[-1][1]:
                if new[0] == new[1] or known.get(new) or (ends[new[0]] and ends[new[1]]):
                    found = True
                    break
                if new not in known:
                    stack.append((new, iter(self._onward(*new))))
                    break
            else:
                known[stack.pop()[0]] = False
        # what is still on the stack leads to the rest that was found
        known.update((pair, True) for pair, _ in stack)
        return found

    def common(self, a: int, b: int) -> Iterator[str]:
        """The rests accepted from both states."""
        steps, ends = self.machine.steps, self.machine.ends
        path: list[str] = []
        stack = [(a, b, 0, "")]
        while stack:
            a, b, depth, letter = stack.pop()
            del path[max(depth - 1, 0) :]
            if depth:
                path.append(letter)
            if ends[a] and ends[b]:
                yield "".join(path)
            right = steps[b]
            for c, q in steps[a].items():
                if c in right and self.meets(q, right[c]):
                    stack.append((q, right[c], depth + 1, c))

    def edits(self, state: int) -> list[tuple[str, str, int, int]]:
        """What may be edited here: letters left and right ('' left: inserted) and the two states after it."""
        found = self._edits.get(state)
        if found is None:
            onward = list(self.machine.steps[state].items())
            found = [("", d, state, q) for d, q in onward if self.meets(state, q)]
            for i, (c, p) in enumerate(onward):
                found += [(c, d, p, q) for d, q in onward[i + 1 :] if self.meets(p, q)]
            self._edits[state] = found
        return found

    def pairs(self, before: str = "") -> Iterator[tuple[str, str]]:
        """Accepted pairs of words; ``before`` is the letter that stands before every word, if any."""
        path: list[str] = []
        stack = [(0, 0, before)]
        while stack:
            state, depth, letter = stack.pop()
            del path[max(depth - 1, 0) :]
            if depth:
                path.append(letter)
            if edits := self.edits(state):
                head = "".join(path)
                for c, d, p, q in edits:
                    if c or d != letter:
                        for rest in self.common(p, q):
                            yield head + c + rest, head + d + rest
            for c, q in self.machine.steps[state].items():
                stack.append((q, depth + 1, c))
