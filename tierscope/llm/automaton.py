"""A merge list compiled to a deterministic automaton, and encoding by its transitions.

Token automaton. States are tokens (what was read last), arcs are labelled with tokens. The compiler starts from one
state per base symbol, all arcs present, and takes the merges in order. The gadget of merge
(a, b) -> c: takes the arc a-b away; adds state c; lets c be reached from where a could be reached
(unless that arc goes in this very step) and gives it the arcs that b has. What is left after the last
merge accepts exactly the sequences that merging leaves alone, one per word. Written out, the arcs would be up to the square
of the vocabulary, so the compiler keeps the gadgets (two parents and a step for each state), from which an arc is told.

Symbol automaton. Every beginning of a word has one accepted sequence, and so one last token. A state over base symbols holds that
token and, for each earlier place from which a label may still be going on, the label's beginning (a node of the label
tree) and the token before it. Reading a symbol moves all of these on; of the labels that end, exactly one has an arc
from the token before it. Transitions stand in a table keyed by state and symbol, and a row is compiled from the gadgets when it is
first reached. A word is read once from left to right, a look-up for each symbol, without going back; its last tokens, taken from
the end, are its encoding. Decoding emits the arc labels.
"""

from __future__ import annotations

NEVER = 1 << 60
#: Transitions and arcs kept; beyond, the tables are emptied and filled again.
MOST = 3_000_000


class Automaton:
    def __init__(self, symbols: dict[object, int], merges: list[tuple[int, int, int]], spelled: dict[int, object]):
        """symbols: base symbol to token; merges: (left, right, result) in order; spelled: token to its label."""
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.step: dict[int, int] = {}
        self.gone: dict[tuple[int, int], int] = {}
        self.label = spelled
        for a in symbols.values():
            self.step[a] = -1
        for k, (a, b, c) in enumerate(merges):
            self._gadget(k, a, b, c)
        self.table: dict[tuple[int, int], bool] = {}
        #: The label tree: (node, symbol) to node, and the token that ends at a node.
        self.tree: dict[tuple[int, object], int] = {}
        self.ends: list[int] = [-1]
        self.inner: list[bool] = [True]
        for t, label in spelled.items():
            if t in self.step:
                self._spell(t, label)
        self._empty()

    def _spell(self, t: int, label) -> None:
        node = 0
        for symbol in label:
            self.inner[node] = True
            at = self.tree.get((node, symbol))
            if at is None:
                at = self.tree[node, symbol] = len(self.ends)
                self.ends.append(-1)
                self.inner.append(False)
            node = at
        self.ends[node] = t

    def _empty(self) -> None:
        begin = ((0, -1),)
        self.moves: dict[tuple[int, object], int] = {}
        self.states: dict[tuple, int] = {begin: 0}
        self.open: list[tuple] = [begin]
        self.last: list[int] = [-1]

    def _gadget(self, k: int, a: int, b: int, c: int) -> None:
        if a not in self.step or b not in self.step or not self._unroll(a, b):
            return  # the two never stand next to each other by then, so the merge does nothing
        self.gone.setdefault((a, b), k)
        if c not in self.step:
            self.step[c], self.left[c], self.right[c] = k, a, b

    def arc(self, t: int, u: int) -> bool:
        """Whether the transition from state t under token u is left after all merges."""
        found = self.table.get((t, u))
        if found is None:
            if len(self.table) > MOST:  # a table of what was asked for: emptied when large, then filled again
                self.table.clear()
            found = self.table[t, u] = self._unroll(t, u)
        return found

    def _unroll(self, t: int, u: int) -> bool:
        step, gone = self.step, self.gone
        if (t, u) in gone:
            return False
        while True:
            i, j = step[t], step[u]
            if i < 0 and j < 0:
                return True
            if j > i:  # u came later: t met u's left part then, and did not merge with it up to that step
                u = self.left[u]
                if gone.get((t, u), NEVER) <= j:
                    return False
            elif i > j:  # t came later: its right part met u, and had not merged with it before that step
                t = self.right[t]
                if gone.get((t, u), NEVER) < i:
                    return False
            else:
                t, u = self.right[t], self.left[u]
                if gone.get((t, u), NEVER) < i:
                    return False

    def _move(self, state: int, symbol) -> int:
        """Compiles one entry of the table."""
        on, last, tree = [], -1, self.tree
        for node, before in self.open[state]:
            at = tree.get((node, symbol))
            if at is None:
                continue
            t = self.ends[at]
            if t >= 0 and (before < 0 or self.arc(before, t)):
                last = t
            if self.inner[at]:
                on.append((at, before))
        if last < 0:
            raise ValueError(f"no label ends with {symbol!r} here")
        on.append((0, last))
        key = tuple(on)
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.open)
            self.open.append(key)
            self.last.append(last)
        self.moves[state, symbol] = to
        return to

    def encode(self, word) -> list[int]:
        """The accepting path of a word (a sequence of base symbols)."""
        if len(self.moves) > MOST:
            self._empty()
        moves, last, state, lasts = self.moves, self.last, 0, []
        for symbol in word:
            to = moves.get((state, symbol))
            state = self._move(state, symbol) if to is None else to
            lasts.append(last[state])
        label, path, at = self.label, [], len(lasts)
        while at:
            t = lasts[at - 1]
            path.append(t)
            at -= len(label[t])
        path.reverse()
        return path
