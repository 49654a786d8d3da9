"""Regular expressions over bytes compiled to minimal deterministic automata.

The dialect: literals, escapes of single characters, ``\\xHH``, classes with
ranges and negation, groups, alternation and the greedy counts ``? * + {m} {m,n}``.
"""

from __future__ import annotations

DEAD = 0


class Nfa:
    """States with byte-set edges and empty moves, grown fragment by fragment."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for nxt in self.empty[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)


class Parser:
    """Recursive descent to a tree of ('set', bytes), ('cat', parts), ('alt', parts), ('rep', part, lo, hi)."""

    def __init__(self, pattern: str, ignore_case: bool = False) -> None:
        self.pattern, self.at, self.ignore_case = pattern, 0, ignore_case

    def parse(self):
        tree = self.alternatives()
        if self.at < len(self.pattern):
            raise ValueError(f"unbalanced pattern at {self.at}: {self.pattern}")
        return tree

    def peek(self) -> str:
        return self.pattern[self.at : self.at + 1]

    def take(self) -> str:
        ch = self.peek()
        if not ch:
            raise ValueError(f"pattern ends early: {self.pattern}")
        self.at += 1
        return ch

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.counted(self.atom()))
        return ("cat", parts)

    def counted(self, tree):
        while self.peek() in ("?", "*", "+", "{") and self.peek():
            mark = self.take()
            if mark == "{":
                end = self.pattern.index("}", self.at)
                low, comma, high = self.pattern[self.at : end].partition(",")
                self.at = end + 1
                tree = ("rep", tree, int(low), (int(high) if high else None) if comma else int(low))
            else:
                tree = ("rep", tree, int(mark == "+"), 1 if mark == "?" else None)
        return tree

    def fold(self, values: set[int]) -> frozenset[int]:
        if self.ignore_case:
            values = values | {v ^ 32 for v in values if 65 <= v & ~32 <= 90}
        return frozenset(values)

    def escaped(self) -> int:
        ch = self.take()
        if ch == "x":
            self.at += 2
            return int(self.pattern[self.at - 2 : self.at], 16)
        return {"n": 10, "r": 13, "t": 9}.get(ch, ord(ch))

    def atom(self):
        ch = self.take()
        if ch == "(":
            tree = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"unclosed group: {self.pattern}")
            return tree
        if ch == "[":
            return ("set", self.members())
        if ch == ".":
            return ("set", frozenset(range(256)) - {10})
        code = self.escaped() if ch == "\\" else ord(ch)
        if code > 255:
            return ("cat", [("set", frozenset({b})) for b in chr(code).encode()])
        return ("set", self.fold({code}))

    def members(self) -> frozenset[int]:
        inverse = self.peek() == "^"
        if inverse:
            self.take()
        values: set[int] = set()
        while self.peek() != "]":
            ch = self.take()
            low = self.escaped() if ch == "\\" else ord(ch)
            high = low
            if self.peek() == "-" and self.pattern[self.at + 1 : self.at + 2] not in ("]", ""):
                self.take()
                ch = self.take()
                high = self.escaped() if ch == "\\" else ord(ch)
            values.update(range(low, high + 1))
        self.take()
        folded = self.fold(values)
        return frozenset(range(256)) - folded if inverse else folded


def mirrored(tree):
    """The tree of the reversed language."""
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "rep":
        return ("rep", mirrored(tree[1]), tree[2], tree[3])
    parts = [mirrored(part) for part in tree[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


def attach(nfa: Nfa, tree, start: int) -> int:
    """Add the tree's states after ``start``; the fragment's end."""
    kind = tree[0]
    if kind == "set":
        end = nfa.state()
        nfa.moves[start].append((tree[1], end))
        return end
    if kind == "cat":
        for part in tree[1]:
            start = attach(nfa, part, start)
        return start
    if kind == "alt":
        end = nfa.state()
        for part in tree[1]:
            first = nfa.state()
            nfa.empty[start].append(first)
            nfa.empty[attach(nfa, part, first)].append(end)
        return end
    _, part, low, high = tree
    for _ in range(low):
        start = attach(nfa, part, start)
    if high is None:
        loop = nfa.state()
        nfa.empty[start].append(loop)
        nfa.empty[attach(nfa, part, loop)].append(loop)
        return loop
    end = nfa.state()
    nfa.empty[start].append(end)
    for _ in range(high - low):
        start = attach(nfa, part, start)
        nfa.empty[start].append(end)
    return end


class Dfa:
    """``rows[s][byte]`` is the next state, ``accepts[s]`` the labels met on entering ``s``.

    State 0 is dead (no label can follow); accepting states have the highest numbers,
    from ``first_accepting`` on, so a scan tests one comparison a byte.
    """

    def __init__(self, rows: list[list[int]], accepts: list[tuple[int, ...]], start: int) -> None:
        order = [s for s in range(len(rows)) if s == DEAD]
        order += [s for s in range(len(rows)) if s != DEAD and not accepts[s]]
        self.first_accepting = len(order)
        order += [s for s in range(len(rows)) if s != DEAD and accepts[s]]
        number = {old: new for new, old in enumerate(order)}
        self.rows = [[number[t] for t in rows[old]] for old in order]
        self.accepts = [accepts[old] for old in order]
        self.start = number[start]

    def __len__(self) -> int:
        return len(self.rows)

    def longest(self, data: bytes, at: int, step: int = 1, stop: int | None = None) -> int | None:
        """Where the longest match from ``at`` ends, going by ``step`` up to ``stop``."""
        state, rows, best = self.start, self.rows, None
        stop = (len(data) if step > 0 else 0) if stop is None else stop
        if self.accepts[state]:
            best = at
        while at != stop:
            state = rows[state][data[at] if step > 0 else data[at - 1]]
            at += step
            if state == DEAD:
                break
            if state >= self.first_accepting:
                best = at
        return best


def alphabet(nfa: Nfa) -> list[int]:
    """The class of each byte: bytes in one class take the same edges everywhere."""
    kind = [0] * 256
    for values in {values for moves in nfa.moves for values, _ in moves}:
        seen: dict[tuple[int, bool], int] = {}
        kind = [seen.setdefault((kind[b], b in values), len(seen)) for b in range(256)]
    return kind


def determinise(nfa: Nfa, start: int, ends: dict[int, int]) -> tuple[list[list[int]], list[tuple[int, ...]], int, list[int]]:
    """Subset construction over byte classes."""
    kind = alphabet(nfa)
    samples = [kind.index(k) for k in range(max(kind) + 1)]
    subsets = {frozenset(): DEAD}
    rows: list[list[int]] = [[DEAD] * len(samples)]
    accepts: list[tuple[int, ...]] = [()]
    todo = [nfa.closure([start])]
    subsets[todo[0]] = 1
    rows.append([])
    accepts.append(tuple(sorted({ends[s] for s in todo[0] if s in ends})))
    while todo:
        current = todo.pop()
        row = []
        for byte in samples:
            target = nfa.closure({end for s in current for values, end in nfa.moves[s] if byte in values})
            if target not in subsets:
                subsets[target] = len(rows)
                rows.append([])
                accepts.append(tuple(sorted({ends[s] for s in target if s in ends})))
                todo.append(target)
            row.append(subsets[target])
        rows[subsets[current]] = row
    return rows, accepts, 1, kind


def minimise(rows: list[list[int]], accepts: list[tuple[int, ...]], start: int) -> tuple[list[list[int]], list[tuple[int, ...]], int]:
    """Merge states that no input tells apart, by refining the partition by labels."""
    names: dict = {}
    block = [names.setdefault(labels, len(names)) for labels in accepts]
    while True:
        names = {}
        finer = [names.setdefault((block[s], tuple(block[t] for t in rows[s])), len(names)) for s in range(len(rows))]
        if len(names) == max(block) + 1:
            break
        block = finer
    # The dead state keeps number 0: it is the first state and so the first block.
    merged_rows = [[] for _ in range(max(block) + 1)]
    merged_accepts: list[tuple[int, ...]] = [()] * len(merged_rows)
    for s, b in enumerate(block):
        merged_rows[b] = [block[t] for t in rows[s]]
        merged_accepts[b] = accepts[s]
    return merged_rows, merged_accepts, block[start]


def compile_union(trees: list, anywhere: bool) -> Dfa:
    """One minimal automaton for several trees, whose labels are their places in the list.

    ``anywhere``: matches may start at any byte, else only at the first.
    """
    nfa = Nfa()
    start = nfa.state()
    if anywhere:
        nfa.moves[start].append((frozenset(range(256)), start))
    ends: dict[int, int] = {}
    for label, tree in enumerate(trees):
        first = nfa.state()
        nfa.empty[start].append(first)
        end = nfa.state()
        nfa.empty[attach(nfa, tree, first)].append(end)
        ends[end] = label
    rows, accepts, begin, kind = determinise(nfa, start, ends)
    rows, accepts, begin = minimise(rows, accepts, begin)
    return Dfa([[row[k] for k in kind] for row in rows], accepts, begin)
