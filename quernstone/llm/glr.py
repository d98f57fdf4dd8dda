"""Table-driven recognizers from grammars, generalized to every context-free grammar.

A grammar in extended BNF becomes an LR(0) automaton with SLR(1) lookaheads. Where tables conflict, all actions are followed
at once. Stacks are shared in a graph of immutable nodes (a state and the nodes below it), each distinct one stored once; a configuration is a set of tops. A step
(configuration, token) is therefore a pure function and is remembered, so the recognizer turns, as it reads, into a
finite automaton for the constructs that recur.
"""

from __future__ import annotations

import re
from collections import defaultdict

END = "$"


class Grammar:
    """Productions of a grammar in extended BNF: `Name : alternatives ;` with quoted tokens, ( ), ?, * and +."""

    def __init__(self, text: str, start: str):
        self.productions: list[tuple[str, tuple[str, ...]]] = [("^", (start,))]
        self._made: dict[str, str] = {}
        tokens = re.findall(r"'[^'\s]+'|[A-Za-z_]\w*|[:|;()?*+]", text)
        i = 0
        names = set()
        while i < len(tokens):
            name = tokens[i]
            if tokens[i + 1] != ":":
                raise ValueError(f"expected ':' after {name}, got {tokens[i + 1]}")
            names.add(name)
            i, alternatives = self._alternatives(tokens, i + 2)
            if tokens[i] != ";":
                raise ValueError(f"expected ';' in {name}, got {tokens[i]}")
            i += 1
            self.productions += [(name, a) for a in alternatives]
        self.productions = list(dict.fromkeys(self.productions))
        self.nonterminals = {p[0] for p in self.productions}
        loose = {s for _, body in self.productions for s in body if s not in self.nonterminals and not s.startswith("'")}
        if loose:
            raise ValueError(f"no rule for {sorted(loose)}")

    def _alternatives(self, tokens, i):
        out = []
        while True:
            i, seq = self._sequence(tokens, i)
            out.append(seq)
            if tokens[i] != "|":
                return i, out
            i += 1

    def _sequence(self, tokens, i):
        seq: list[str] = []
        while tokens[i] not in "|;)":
            if tokens[i] == "(":
                i, inner = self._alternatives(tokens, i + 1)
                if tokens[i] != ")":
                    raise ValueError("unbalanced group")
                symbol = inner[0][0] if len(inner) == 1 and len(inner[0]) == 1 else self._helper("|".join(map(" ".join, inner)), inner)
            else:
                symbol = tokens[i]
            i += 1
            while tokens[i] in ("?", "*", "+"):
                op = tokens[i]
                i += 1
                if op == "?":
                    symbol = self._helper(f"{symbol}?", [(), (symbol,)])
                else:
                    more = self._helper(f"{symbol}+", [(symbol,), ("<>", symbol)])
                    symbol = more if op == "+" else self._helper(f"{symbol}*", [(), (more,)])
            seq.append(symbol)
        return i, tuple(seq)

    def _helper(self, label, alternatives):
        if label not in self._made:
            name = self._made[label] = f"<{len(self._made)}>"
            self.productions += [(name, tuple(name if s == "<>" else s for s in a)) for a in alternatives]
        return self._made[label]


def build_tables(grammar: Grammar) -> dict:
    """Action and goto tables: shifts[state] and gotos[state] by symbol, reduces[state][token] as lists of productions."""
    productions, nonterminals = grammar.productions, grammar.nonterminals
    by_head = defaultdict(list)
    for n, (head, _) in enumerate(productions):
        by_head[head].append(n)
    nullable: set[str] = set()
    changed = True
    while changed:
        changed = False
        for head, body in productions:
            if head not in nullable and all(s in nullable for s in body):
                nullable.add(head)
                changed = True
    first = {n: set() for n in nonterminals}
    changed = True
    while changed:
        changed = False
        for head, body in productions:
            before = len(first[head])
            for s in body:
                if s in nonterminals:
                    first[head] |= first[s]
                    if s not in nullable:
                        break
                else:
                    first[head].add(s)
                    break
            changed |= len(first[head]) != before
    follow = {n: set() for n in nonterminals}
    follow["^"].add(END)
    changed = True
    while changed:
        changed = False
        for head, body in productions:
            trailer = set(follow[head])
            for s in reversed(body):
                if s in nonterminals:
                    before = len(follow[s])
                    follow[s] |= trailer
                    changed |= len(follow[s]) != before
                    trailer = trailer | first[s] if s in nullable else set(first[s])
                else:
                    trailer = {s}

    closed: dict[str, frozenset] = {}

    def heads_below(symbol):
        if symbol not in closed:
            seen, todo = set(), [symbol]
            while todo:
                s = todo.pop()
                if s in seen:
                    continue
                seen.add(s)
                todo += [productions[n][1][0] for n in by_head[s] if productions[n][1] and productions[n][1][0] in nonterminals]
            closed[symbol] = frozenset((n, 0) for s in seen for n in by_head[s])
        return closed[symbol]

    def closure(kernel):
        items = set(kernel)
        for n, dot in kernel:
            body = productions[n][1]
            if dot < len(body) and body[dot] in nonterminals:
                items |= heads_below(body[dot])
        return items

    start = frozenset([(0, 0)])
    numbers, todo = {start: 0}, [start]
    shifts, gotos, reduces = [], [], []
    k = 0
    while k < len(todo):
        items = closure(todo[k])
        k += 1
        moves = defaultdict(set)
        reduce_here = defaultdict(list)
        for n, dot in items:
            head, body = productions[n]
            if dot < len(body):
                moves[body[dot]].add((n, dot + 1))
            else:
                for t in follow[head]:
                    reduce_here[t].append(n)
        to = {}
        for symbol, kernel in moves.items():
            kernel = frozenset(kernel)
            if kernel not in numbers:
                numbers[kernel] = len(todo)
                todo.append(kernel)
            to[symbol] = numbers[kernel]
        shifts.append({s.strip("'") if len(s) > 1 else s: v for s, v in to.items() if s not in nonterminals})
        gotos.append({s: v for s, v in to.items() if s in nonterminals})
        reduces.append({t.strip("'") if len(t) > 1 else t: tuple(v) for t, v in reduce_here.items()})
    return {
        "shifts": shifts, "gotos": gotos, "reduces": reduces, "heads": [p[0] for p in productions], "sizes": [len(p[1]) for p in productions],
        "tokens": frozenset(t.strip("'") for _, body in productions for t in body if t not in nonterminals),
    }


class Recognizer:
    """Steps through the tables of one grammar; remembers steps within LIMIT entries."""

    LIMIT = 400_000

    def __init__(self, tables: dict):
        self.shifts, self.gotos, self.reduces = tables["shifts"], tables["gotos"], tables["reduces"]
        self.heads, self.sizes, self.tokens = tables["heads"], tables["sizes"], tables["tokens"]
        self.reset()

    def reset(self) -> None:
        """Forgets all steps; configurations of before are void."""
        self.states: list[int] = [0]
        self.parents: list[frozenset[int]] = [frozenset()]
        self.nodes: dict[tuple[int, frozenset[int]], int] = {(0, frozenset()): 0}
        self.configs: list[tuple[int, ...]] = [(0,)]
        self.numbers = {(0,): 0}
        self.steps: dict[tuple[int, str], int] = {}
        self.memory: dict = {}

    def full(self) -> bool:
        return len(self.nodes) + len(self.steps) + len(self.memory) > self.LIMIT

    def _node(self, state: int, parents: frozenset[int]) -> int:
        key = (state, parents)
        n = self.nodes.get(key)
        if n is None:
            n = self.nodes[key] = len(self.states)
            self.states.append(state)
            self.parents.append(parents)
        return n

    def _reduced(self, config: int, token: str) -> dict[int, set[int]]:
        """Parents of the tops by their state, with all reductions before a token made.

        Tops of one state are one, whatever lies under them. A parent that is itself a top, after an empty reduction, is
        given as -1 - state. Sets of what lies k links below a top are all a recognizer needs, so no paths are listed.
        """
        old = self.parents
        tops: dict[int, set[int]] = {}
        for n in self.configs[config]:
            tops.setdefault(self.states[n], set()).update(old[n])
        changed = True
        while changed:
            changed = False
            for state in list(tops):
                for p in self.reduces[state].get(token, ()):
                    if p == 0:
                        continue
                    level = {-1 - state}
                    for _ in range(self.sizes[p]):
                        level = {u for r in level for u in (tops[-1 - r] if r < 0 else old[r])}
                    head = self.heads[p]
                    for under in level:
                        to = self.gotos[-1 - under if under < 0 else self.states[under]].get(head)
                        if to is not None:
                            have = tops.get(to)
                            if have is None:
                                tops[to] = {under}
                                changed = True
                            elif under not in have:
                                have.add(under)
                                changed = True
        return tops

    def step(self, config: int, token: str) -> int:
        """The configuration after a token; -1 where no stack can take it."""
        key = (config, token)
        out = self.steps.get(key)
        if out is None:
            tops = self._reduced(config, token)
            made: dict[int, int] = {}

            def node(state: int) -> int:
                """The lasting node of a top."""
                n = made.get(state)
                if n is None:
                    n = made[state] = self._node(state, frozenset(node(-1 - r) if r < 0 else r for r in tops[state]))
                return n

            after: dict[int, set[int]] = {}
            for state in tops:
                to = self.shifts[state].get(token)
                if to is not None:
                    after.setdefault(to, set()).add(node(state))
            if after:
                stacks = tuple(sorted(self._node(to, frozenset(under)) for to, under in after.items()))
                out = self.numbers.get(stacks)
                if out is None:
                    out = self.numbers[stacks] = len(self.configs)
                    self.configs.append(stacks)
            else:
                out = -1
            self.steps[key] = out
        return out

    def accepts(self, config: int) -> bool:
        """Whether the text may end here."""
        key = (config, END)
        out = self.steps.get(key)
        if out is None:
            out = int(any(0 in self.reduces[state].get(END, ()) for state in self._reduced(config, END)))
            self.steps[key] = out
        return bool(out)
