"""Byte-pair merges as a deterministic automaton, and the machine that reads text with it.

``TokenAutomaton`` runs over *tokens*. It starts as one state that allows every base symbol.
Each merge (a, b) -> ab then applies one gadget, in rank order:

* the state q that follows ``a`` is copied without its ``b`` arc, and all ``a`` arcs now lead
  to the copy, so that ``a`` and ``b`` can no longer stand side by side;
* every state with an ``a`` arc gets an ``ab`` arc to where ``b`` led from q.

A token sequence is accepted exactly if byte-pair encoding yields it for its own text, and
every text has one such sequence. All arcs with one label lead to one state, so the state
after ``x`` is named by x, and a gadget need only record when it took ``b`` away after ``a``:

* the state after ``ab`` is the state after ``b`` as it was then, without later removals;
* a state has an ``ab`` arc where it had an ``a`` arc then, whatever was removed later.

So whether x allows t follows from the removals between the right parts of x and the left
parts of t. A full table of states times tokens would have billions of cells.

``PrefixMachine`` reads symbols. After each prefix it knows the last token of the prefix's own
encoding. Its state is the set of open token beginnings with the automaton state before each;
its transitions are compiled when first taken and kept in a table, which is emptied when it
outgrows ``max_states``.
"""

from __future__ import annotations

#: Token beginnings with so few continuations count as alike where they allow the same ones.
FEW = 12
START = -1
#: The state before any symbol: one open beginning, the empty one.
BEGIN = ((0, START, 0),)
ALWAYS = 1 << 60
NEW = object()
#: Answers that are remembered: about 50 MB of a worker.
MEMO = 400_000


class TokenAutomaton:
    def __init__(self, n_tokens: int, merges: list[tuple[int, int, int]], base: list[int]):
        """merges: (left, right, merged) in rank order; base: tokens that no merge makes."""
        self.n = n_tokens
        self.left, self.right = [-1] * n_tokens, [-1] * n_tokens
        self.made = [-2] * n_tokens  # rule that makes it; -1: base; -2: never
        self.removed: dict[tuple[int, int], int] = {}
        self.memo: dict[int, bool] = {}
        for t in base:
            self.made[t] = -1
        for k, (a, b, ab) in enumerate(merges):
            if self.made[a] != -2 and self.made[b] != -2 and self._allows(a, b):
                self.removed[(a, b)] = k
                self.left[ab], self.right[ab], self.made[ab] = a, b, k

    def _allows(self, x: int, t: int) -> bool:
        made, left, right, removed = self.made, self.left, self.right, self.removed
        before = ALWAYS
        while x >= 0:
            e, until = t, ALWAYS
            while e >= 0:
                k = removed.get((x, e))
                if k is not None and k < before and k <= until:
                    return False
                until = made[e]
                e = left[e]
            before = made[x]
            x = right[x]
        return True

    def allows(self, x: int, t: int) -> bool:
        """Whether the state after token x (START: none yet) has an arc labelled t."""
        if x < 0:
            return self.made[t] != -2
        key = x * self.n + t
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            known = self.memo[key] = self.made[t] != -2 and self._allows(x, t)
        return known


class PrefixMachine:
    """Symbols in, last token (or change of the token count) of each prefix out."""

    def __init__(self, automaton: TokenAutomaton, spelled: dict[int, tuple], counted: bool, max_states: int = 60_000):
        """spelled: the symbols of each token that can occur; counted: keep token counts in states, so that transitions emit count changes."""
        self.automaton = automaton
        self.counted = counted
        self.max_states = max_states
        self.child: dict[tuple, int] = {}
        self.token_at = [-1]
        self.open = [True]
        below: list[list[int]] = [[]]
        for t, symbols in spelled.items():
            node = 0
            for c in symbols:
                nxt = self.child.get((node, c))
                if nxt is None:
                    nxt = self.child[(node, c)] = len(self.token_at)
                    self.token_at.append(-1)
                    self.open.append(False)
                    below.append([])
                self.open[node] = True
                if node:
                    below[node].append(t)
                node = nxt
            self.token_at[node] = t
        #: Tokens that continue a node, where they are few enough to be looked at one by one.
        self.below = [tuple(b) if len(b) <= FEW else None for b in below]
        self.alike: dict[tuple, int] = {}
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.live: list[tuple] = []
        self.table: list[dict] = []
        self.start = self._state(BEGIN)

    def _state(self, live: tuple) -> int:
        s = self.ids.get(live)
        if s is None:
            s = self.ids[live] = len(self.live)
            self.live.append(live)
            self.table.append({})
        return s

    def _same(self, node: int, q: int) -> int | None:
        """A state that allows the same continuations of node as q does; None if q allows none."""
        known = self.alike.get((node, q), NEW)
        if known is NEW:
            allows = self.automaton.allows
            these = tuple(t for t in self.below[node] if allows(q, t))
            known = self.alike.setdefault((node, these), q) if these else None
            if len(self.alike) > MEMO // 3:
                self.alike.clear()
            self.alike[(node, q)] = known
        return known

    def compile(self, s: int, c) -> tuple[int, int]:
        """The transition of state s on symbol c: (next state, output)."""
        child, token_at, allows, below = self.child, self.token_at, self.automaton.allows, self.below
        found, kept = -1, []
        change = 0
        for node, q, back in self.live[s]:
            nxt = child.get((node, c))
            if nxt is None:
                continue
            t = token_at[nxt]
            if t >= 0 and found < 0 and allows(q, t):
                found, change = t, 1 - back
            if self.open[nxt]:
                if below[nxt] is not None:
                    q = self._same(nxt, q)
                if q is not None:
                    kept.append((nxt, q, back))
        if found < 0:
            raise ValueError(f"symbol {c!r} is outside the alphabet")
        if self.counted:
            kept = [(node, q, back + change) for node, q, back in kept]
        out = (self._state((*kept, (0, found, 0))), change if self.counted else found)
        self.table[s][c] = out
        return out

    def run(self, live: tuple, symbols) -> tuple[tuple, int]:
        """The state (as its open beginnings, which say the same in every worker) after symbols, and the sum of what the transitions emit."""
        if len(self.live) > self.max_states:
            self.reset()
        table, s, total = self.table, self._state(live), 0
        for c in symbols:
            step = table[s].get(c)
            if step is None:
                step = self.compile(s, c)
            s = step[0]
            total += step[1]
        return self.live[s], total

    def labels(self, symbols) -> list[int]:
        """Last token of every prefix."""
        if len(self.live) > self.max_states:
            self.reset()
        table, s, out = self.table, self.start, []
        for c in symbols:
            step = table[s].get(c)
            if step is None:
                step = self.compile(s, c)
            s = step[0]
            out.append(step[1])
        return out
