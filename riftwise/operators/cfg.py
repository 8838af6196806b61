"""Control flow, a function at a time: dominators, loop nests and the cost of the dearest path.

Each task holds the blocks of one function, whose size the source bounds, not the corpus.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftwise.sources.ir import TERMINATORS

KEYS = ["module", "func"]


def _order(entry, after):
    """Blocks reachable from entry in reverse postorder, without recursion."""
    seen, out, stack = {entry}, [], [(entry, iter(after.get(entry, ())))]
    while stack:
        block, rest = stack[-1]
        for nxt in rest:
            if nxt not in seen:
                seen.add(nxt)
                stack.append((nxt, iter(after.get(nxt, ()))))
                break
        else:
            out.append(block)
            stack.pop()
    return out[::-1]


def _graph(blocks: pd.DataFrame, edges: pd.DataFrame):
    blocks = blocks.sort_values("bb_ord")
    after: dict = {}
    for s, d in edges.sort_values(["src", "nth"])[["src", "dst"]].itertuples(index=False):
        after.setdefault(s, []).append(d)
    return blocks["bb"].iloc[0], after


def immediate_dominators(entry, after) -> dict:
    """Block to its immediate dominator by iteration over reverse postorder (Cooper, Harvey and Kennedy, 2001)."""
    order = _order(entry, after)
    rank = {b: i for i, b in enumerate(order)}
    before: dict = {}
    for s in order:
        for d in after.get(s, ()):
            before.setdefault(d, []).append(s)
    dom, moved = {entry: entry}, True
    while moved:
        moved = False
        for b in order[1:]:
            new = None
            for p in before[b]:
                if p in dom:
                    new = p if new is None else _meet(dom, rank, p, new)
            if dom.get(b) != new:
                dom[b], moved = new, True
    return dom


def _meet(dom, rank, a, b):
    while a != b:
        while rank[a] > rank[b]:
            a = dom[a]
        while rank[b] > rank[a]:
            b = dom[b]
    return a


def natural_loops(entry, after) -> dict:
    """Header to the set of its blocks; back edges of one header make one loop."""
    dom = immediate_dominators(entry, after)
    before: dict = {}
    for s in dom:
        for d in after.get(s, ()):
            before.setdefault(d, []).append(s)

    def over(h, b):
        while b != h and b != entry:
            b = dom[b]
        return b == h

    found: dict = {}
    for s in dom:
        for h in after.get(s, ()):
            if over(h, s):
                body, todo = found.setdefault(h, {h}), [s]
                while todo:
                    b = todo.pop()
                    if b not in body:
                        body.add(b)
                        todo += before.get(b, ())
    return found


def _per_function(instructions: DataFrame, edges: DataFrame, run, schema: str) -> DataFrame:
    cost = F.sum("cost") if "cost" in instructions.columns else F.lit(0)
    blocks = instructions.groupBy(*KEYS, "bb").agg(F.min("bb_ord").alias("bb_ord"), cost.cast("long").alias("cost"))
    out = "module string, func string, " + schema

    def apply(key, b, e):
        if b.empty:
            return pd.DataFrame([], columns=[c.split()[0] for c in out.split(", ")])
        rows = run(b, e)
        return pd.DataFrame([(*key, *r) for r in rows], columns=[c.split()[0] for c in out.split(", ")])

    edges = edges.toDF(*edges.columns)  # new columns, in case both sides come from one table
    return blocks.groupBy(*KEYS).cogroup(edges.groupBy(*KEYS)).applyInPandas(apply, out)


def _branching(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows of functions that have edges; others have no loops and need no task of Python each."""
    keys = edges.toDF(*edges.columns).select(*KEYS).distinct()
    return rows.join(keys, KEYS, "left_semi")


def dominators(instructions: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, func, bb, idom, depth): the dominator tree; the entry has none and depth 0."""

    def run(b, e):
        entry, after = _graph(b, e)
        dom, depth = immediate_dominators(entry, after), {entry: 0}
        for x in _order(entry, after)[1:]:
            depth[x] = depth[dom[x]] + 1
        return [(x, None if x == entry else dom[x], depth[x]) for x in depth]

    return _per_function(instructions, edges, run, "bb string, idom string, depth int")


def loops(instructions: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, func, bb, headers): each block in a loop with the headers of the loops around it, outermost first."""

    def run(b, e):
        found = natural_loops(*_graph(b, e))
        nest: dict = {}
        for h in sorted(found, key=lambda h: (-len(found[h]), h)):
            for x in found[h]:
                nest.setdefault(x, []).append(h)
        return list(nest.items())

    return _per_function(_branching(instructions, edges), edges, run, "bb string, headers array<string>")


def function_cost(instructions: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, func, total): cost of the dearest path from entry to exit; instructions carry cost, null unknown.

    Back edges lead to the exit instead, so that each loop counts once.
    """

    def run(b, e):
        entry, after = _graph(b, e)
        cost = {x: int(c or 0) for x, c in zip(b["bb"], b["cost"].fillna(0))}
        order = _order(entry, after)
        rank = {x: i for i, x in enumerate(order)}
        best, total = {entry: cost[entry]}, 0
        for x in order:
            ahead = [d for d in after.get(x, ()) if rank[d] > rank[x]]
            if len(ahead) < len(after.get(x, ())) or not ahead:
                total = max(total, best[x])
            for d in ahead:
                best[d] = max(best.get(d, 0), best[x] + cost.get(d, 0))
        return [(total,)]

    return _per_function(instructions, edges, run, "total long")


#: Comparison that holds where another does not (fixed values).
OPPOSITE = {"eq": "ne", "ne": "eq", "lt": "ge", "ge": "lt", "gt": "le", "le": "gt"}
PHI = re.compile(r"\[ (\S+), %([-\w.$]+) \]")
STEP = re.compile(r"^(add|sub) (?:nsw |nuw )*i\d+ (\S+), (\S+)$")
TEST = re.compile(r"^icmp [su]?(eq|ne|lt|le|gt|ge) i\d+ (\S+), (\S+)$")
BRANCH = re.compile(r"^br i1 (\S+), label %([-\w.$]+), label %([-\w.$]+)$")


def rounds(start: int, step: int, stay: str, bound: int) -> int | None:
    """How often start, start + step, ... satisfies `stay` bound before it fails first; None if it never fails."""
    if stay == "eq":
        return 0 if start != bound else 1 if step else None
    if stay == "ne":
        if start == bound:
            return 0
        return (bound - start) // step if step and (bound - start) % step == 0 and (bound - start) // step > 0 else None
    if stay in ("gt", "ge"):
        start, step, bound, stay = -start, -step, -bound, "lt" if stay == "gt" else "le"
    if stay == "le":
        bound += 1
    if start >= bound:
        return 0
    return -(-(bound - start) // step) if step > 0 else None


def _trips(header, body, after, dom, lines) -> int:
    """The largest constant trip count over the exits of a loop; zero where none is known.

    lines map a block to its (result, text). A count is known for an exit that every round passes, by comparing a
    counter with a constant: a value that starts constant in the header and goes up or down by a constant.
    """
    made = {r: t for b in body for r, t in lines.get(b, ()) if r}
    latches = [b for b in body if header in after.get(b, ())]
    number = lambda t: int(t) if t.lstrip("-").isdigit() else None

    def stepped(name):
        """(base, step) if name is base plus a constant."""
        m = STEP.match(made.get(name, ""))
        if m:
            op, a, b = m.groups()
            if op == "add" and number(a) is not None:
                a, b = b, a
            if number(b) is not None:
                return a, number(b) if op == "add" else -number(b)
        return None

    counters = {}
    for r, t in lines.get(header, ()):
        ways = PHI.findall(t) if r and t.startswith("phi i") else []
        starts = {v for v, b in ways if b not in body}
        nexts = {v for v, b in ways if b in body}
        if len(starts) == 1 and len(nexts) == 1 and number(*starts) is not None:
            at = stepped(*nexts)
            if at and at[0] == r:
                counters[r] = (number(*starts), at[1])
    best = 0
    for b in body:
        m = BRANCH.match(lines[b][-1][1]) if lines.get(b) else None
        if not m or (m[2] in body) == (m[3] in body):
            continue
        passed = True
        for x in latches:
            while x != b and x != dom[x]:
                x = dom[x]
            passed = passed and x == b
        test = TEST.match(made.get(m[1], ""))
        if not passed or not test:
            continue
        how, x, bound = test.groups()
        if number(x) is not None:
            x, bound, how = bound, x, {"lt": "gt", "gt": "lt", "le": "ge", "ge": "le"}.get(how, how)
        at = stepped(x)
        start, step = counters.get(x) or ((counters[at[0]][0] + at[1], counters[at[0]][1]) if at and at[0] in counters else (None, 0))
        if start is None or number(bound) is None:
            continue
        n = rounds(start, step, how if m[2] in body else OPPOSITE[how], number(bound))
        if n is not None and n + 1 < 1 << 32:
            best = max(best, n + 1)
    return best


def trip_counts(instructions: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, func, header, trip): how often each loop's header runs, zero where that is not a known constant.

    instructions carry ord, result, opcode and text. Values of a counter are taken as unbounded integers.
    """
    parts = _branching(instructions, edges).where(F.col("opcode").isin("phi", "add", "sub", "icmp", *TERMINATORS)).select(
        *KEYS, "bb", "bb_ord", "ord", "result", "text")
    out = "module string, func string, header string, trip long"
    names = [c.split()[0] for c in out.split(", ")]

    def apply(key, i, e):
        if i.empty or e.empty:
            return pd.DataFrame([], columns=names)
        entry, after = _graph(i, e)
        lines: dict = {}
        for t in i.sort_values("ord").itertuples(index=False):
            lines.setdefault(t.bb, []).append((t.result, t.text))
        dom = immediate_dominators(entry, after)
        return pd.DataFrame([(*key, h, _trips(h, body, after, dom, lines)) for h, body in natural_loops(entry, after).items()],
                            columns=names)

    edges = edges.toDF(*edges.columns)
    return parts.groupBy(*KEYS).cogroup(edges.groupBy(*KEYS)).applyInPandas(apply, out)


def control_dependences(instructions: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, func, bb, decider): blocks that run or not by the branch at the end of decider.

    These are the post-dominance frontiers (Ferrante, Ottenstein and Warren, 1987). Blocks that never reach an
    exit have none.
    """

    def run(b, e):
        entry, after = _graph(b, e)
        order, before, end = _order(entry, after), {}, "\0"  # end stands behind all exits
        for x in order:
            for y in after.get(x) or (end,):
                before.setdefault(y, []).append(x)
        over = immediate_dominators(end, before)
        out = set()
        for x in order:
            for y in after.get(x, ()):
                while x in over and y in over and y != over[x] and y != end:
                    out.add((y, x))
                    y = over[y]
        return sorted(out)

    return _per_function(instructions, edges, run, "bb string, decider string")
