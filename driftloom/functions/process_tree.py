"""Inductive discovery of a process tree from a directly-follows graph (no noise filter)."""

from __future__ import annotations

NAMES = {"seq": "Sequence", "xor": "Conditional", "par": "Parallel", "loop": "Loop"}


def _components(nodes: set, linked) -> list[set]:
    left, out = set(nodes), []
    while left:
        todo, part = [min(left)], set()
        while todo:
            x = todo.pop()
            if x in part:
                continue
            part.add(x)
            todo += [y for y in left if y not in part and linked(x, y)]
        left -= part
        out.append(part)
    return sorted(out, key=min)


def _reach(nodes: set, edges: set) -> dict:
    out = {}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            for a, b in edges:
                if a == todo[-1] and b in nodes and b not in seen:
                    seen.add(b)
                    todo.insert(0, b)
            todo.pop()
        out[n] = seen
    return out


def discover(edges: set[tuple[str, str]], starts: set[str], ends: set[str], nodes: set[str] | None = None):
    """A tree: an activity, None (silent), or (operator, children). Cuts are tried in the order exclusive, sequence,
    parallel, loop; without a cut, a loop over any of the activities."""
    nodes = set(nodes) if nodes is not None else {x for e in edges for x in e} | set(starts) | set(ends)
    if not nodes:
        return None
    if len(nodes) == 1:
        (n,) = nodes
        return ("loop", [n, None]) if (n, n) in edges else n
    edges = {(a, b) for a, b in edges if a in nodes and b in nodes}
    either = lambda x, y: (x, y) in edges or (y, x) in edges
    parts = _components(nodes, either)
    if len(parts) > 1:
        return ("xor", [discover(edges, starts & p, ends & p, p) for p in parts])
    reach = _reach(nodes, edges)
    parts = _components(nodes, lambda x, y: (y in reach[x]) == (x in reach[y]))
    if len(parts) > 1:
        parts.sort(key=lambda p: -len(set().union(*(reach[x] for x in p)) - p))
        children = []
        for i, p in enumerate(parts):
            before, after = set().union(*parts[:i], set()), set().union(*parts[i + 1 :], set())
            s = (starts & p) | {b for a, b in edges if a in before and b in p}
            e = (ends & p) | {a for a, b in edges if a in p and b in after}
            child = discover(edges, s, e, p)
            # A part that some path goes around can be skipped.
            around = any(a in before and b in after for a, b in edges) or bool(starts & after) and not before or bool(ends & before) and not after
            children.append(("xor", [child, None]) if around else child)
        return ("seq", children)
    parts = _components(nodes, lambda x, y: not ((x, y) in edges and (y, x) in edges))
    if len(parts) > 1:
        whole = [p for p in parts if p & starts and p & ends]
        if whole:
            for p in parts:
                if p not in whole:
                    whole[0] |= p
        if len(whole) > 1:
            return ("par", [discover(edges, starts & p, ends & p, p) for p in whole])
    inner = nodes - starts - ends
    if inner:
        redo = [p for p in _components(inner, lambda x, y: either(x, y))]
        good = []
        for p in redo:
            into, out = {a for a, b in edges if b in p and a not in p}, {b for a, b in edges if a in p and b not in p}
            if into and out and into <= ends and out <= starts:
                good.append(p)
        if good:
            body = nodes - set().union(*good)
            kept = {(a, b) for a, b in edges if a in body and b in body and not (a in ends and b in starts)}
            redos = [discover(edges, {b for a, b in edges if a not in p and b in p}, {a for a, b in edges if a in p and b not in p}, p) for p in good]
            return ("loop", [discover(kept, starts & body, ends & body, body), *redos])
    back = {(a, b) for a, b in edges if a in ends and b in starts}
    if back and edges - back and len(nodes) > 1:
        tree = discover(edges - back, starts, ends, nodes)
        if not (isinstance(tree, tuple) and tree[0] == "loop"):
            return ("loop", [tree, None])
    return ("loop", [("xor", sorted(nodes)), None])


def render(tree) -> str:
    if tree is None:
        return "tau"
    if isinstance(tree, str):
        return f"'{tree}'"
    return f"{NAMES[tree[0]]}( {', '.join(map(render, tree[1]))} )"


def from_dfg(rows) -> str:
    """Text of the tree of a graph's rows (kind, activity_from, activity_to, frequency)."""
    edges = {(r[1], r[2]) for r in rows if r[0] == "edge" and not {r[1], r[2]} & {"unknown_previous_activities", "unknown_following_activities"}}
    starts, ends = {r[2] for r in rows if r[0] == "start"}, {r[1] for r in rows if r[0] == "end"}
    return render(discover(edges, starts, ends))


def wrap_text(text: str, width: int = 20) -> str:
    """Lines of at most width characters, broken at spaces and underscores."""
    out, line = [], ""
    for word in text.replace("_", "_ ").split():
        glue = "" if not line or line.endswith("_") else " "
        if line and len(line) + len(glue) + len(word) > width:
            out.append(line)
            line = word
        else:
            line += glue + word
    return "\n".join([*out, line] if line else out)
