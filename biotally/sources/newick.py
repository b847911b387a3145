"""Newick trees: one parsed on the driver, or many in a column where their rows
are, and kept as tables.

A tree table has node, parent, branchL and dist_to_root; its closure has a row
for each node and leaf below it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "node string, parent string, branchL double, dist_to_root double"
CLOSURE = "node string, leaf string"


@dataclass
class Node:
    name: str | None = None
    length: float | None = None
    support: float | None = None
    children: list[Node] = field(default_factory=list)
    parent: Node | None = field(default=None, repr=False)

    def walk(self) -> list[Node]:
        """Parents before children, without recursion."""
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            out.append(node)
            stack += reversed(node.children)
        return out

    def leaves(self) -> list[Node]:
        return [n for n in self.walk() if not n.children]


def _tokens(text: str):
    at, n = 0, len(text)
    while at < n:
        c = text[at]
        if c in "(),:;":
            yield c
            at += 1
        elif c.isspace():
            at += 1
        elif c == "[":  # comment
            at = text.index("]", at) + 1
        elif c in "'\"":
            end = at + 1
            while end < n and (text[end] != c or text[end + 1 : end + 2] == c):
                end += 2 if text[end] == c else 1
            yield "'" + text[at + 1 : end].replace(c + c, c)
            at = end + 1
        else:
            end = at
            while end < n and text[end] not in "(),:;[" and not text[end].isspace():
                end += 1
            yield "'" + text[at:end]
            at = end


def parse(text: str) -> Node:
    """Numeric labels of inner nodes are support values; inner nodes without a
    name are called in1, in2, ... in the order in which they close."""
    root = node = Node()
    count, length, closed = 0, False, False
    for t in _tokens(text.strip()):
        if t == "(":
            child = Node(parent=node)
            node.children.append(child)
            node, closed = child, False
        elif t == ",":
            child = Node(parent=node.parent)
            if node.parent is None:
                raise ValueError("a comma outside of brackets")
            node.parent.children.append(child)
            node, closed = child, False
        elif t == ")":
            node = node.parent
            if node is None:
                raise ValueError("brackets do not match")
            count += 1
            node.name, closed = f"in{count}", True
        elif t == ":":
            length = True
        elif t == ";":
            break
        elif length:
            node.length, length = float(t[1:]), False
        elif closed:
            try:
                node.support = float(t[1:])
            except ValueError:
                node.name = t[1:]
        else:
            node.name = t[1:]
    if node is not root:
        raise ValueError("brackets do not match")
    return root


def write(root: Node, precision: int = 6) -> str:
    out: dict[int, str] = {}
    for node in reversed(root.walk()):
        own = node.name or ""
        if own and any(c in own for c in " (),:;[]'"):
            own = "'" + own.replace("'", "''") + "'"
        text = ("(" + ",".join(out.pop(id(c)) for c in node.children) + ")" if node.children else "") + own
        out[id(node)] = text + (f":{node.length:.{precision}f}" if node.length is not None else "")
    return out[id(root)] + ";"


def rows(root: Node) -> tuple[list[tuple], list[tuple]]:
    """Node rows, parents first, and closure rows."""
    nodes, closure, height, below = [], [], {}, {}
    order = root.walk()
    for n in order:
        height[id(n)] = (height[id(n.parent)] if n.parent else 0.0) + (n.length or 0.0 if n.parent else 0.0)
        nodes.append((n.name, n.parent.name if n.parent else None, float(n.length or 0.0), height[id(n)]))
    for n in reversed(order):
        below[id(n)] = [n.name] if not n.children else [x for c in n.children for x in below.pop(id(c))]
        closure += [(n.name, leaf) for leaf in below[id(n)]]
    return nodes, closure


def to_tables(spark: SparkSession, root: Node) -> tuple[DataFrame, DataFrame]:
    nodes, closure = rows(root)
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(closure, CLOSURE)


def parse_column(trees: DataFrame, newick: str = "newick", *, strict: bool = True) -> DataFrame:
    """The table's other columns with node, parent, branchL and dist_to_root of
    each row's tree: a table function beside every row, so that trees are parsed
    by the tasks that have them. Null and blank texts give no rows; a text that
    is no tree raises, or gives none if not ``strict``."""

    @F.udtf(returnType=NODES)
    class Parsed:
        def eval(self, text: str):
            if text is None or not text.strip():
                return
            try:
                found = rows(parse(text))[0]
            except ValueError:
                if strict:
                    raise
                return
            yield from found

    kept = [c for c in trees.columns if c != newick]
    return trees.lateralJoin(Parsed(F.col(f"`{newick}`").outer())).select(*[F.col(f"`{c}`") for c in kept], "node", "parent", "branchL", "dist_to_root")


def from_rows(nodes: list[tuple]) -> Node:
    """(node, parent, branchL, ...) -> tree, in the rows' order; several roots
    come under one that is made up."""
    made = {r[0]: Node(name=r[0], length=r[2]) for r in nodes}
    roots = []
    for r in nodes:
        if r[1] is None or r[1] not in made:
            roots.append(made[r[0]])
        else:
            made[r[0]].parent = made[r[1]]
            made[r[1]].children.append(made[r[0]])
    if len(roots) == 1:
        return roots[0]
    top = Node(name="root", length=0.0, children=roots)
    for r in roots:
        r.parent = top
    return top


def prune(root: Node, keep: set[str]) -> Node | None:
    """The tree of the kept leaves; nodes with a single child are merged into
    it, lengths added."""
    for n in reversed(root.walk()):
        n.children = [c for c in n.children if c.name in keep or c.children]
    if not root.children and root.name not in keep:
        return None
    return collapse(root)


def collapse(root: Node) -> Node:
    for n in reversed(root.walk()):
        while len(n.children) == 1 and n is not root:
            only = n.children[0]
            n.name, n.children, n.support = only.name, only.children, only.support
            n.length = (n.length or 0.0) + (only.length or 0.0)
            for c in n.children:
                c.parent = n
    while len(root.children) == 1 and root.children[0].children:
        root = root.children[0]
        root.parent, root.length = None, None
    return root


def reroot_midpoint(root: Node) -> Node:
    """The tree rooted halfway between its two farthest leaves."""

    def farthest(start: Node) -> tuple[Node, dict[int, float], dict[int, Node | None]]:
        dist, came, stack = {id(start): 0.0}, {id(start): None}, [start]
        best = start
        while stack:
            n = stack.pop()
            near = [(c, c.length or 0.0) for c in n.children] + ([(n.parent, n.length or 0.0)] if n.parent else [])
            for m, d in near:
                if id(m) not in dist:
                    dist[id(m)], came[id(m)] = dist[id(n)] + d, n
                    stack.append(m)
                    if not m.children and (dist[id(m)], m.name or "") > (dist[id(best)] if not best.children or best is start else -1.0, best.name or ""):
                        best = m
        return best, dist, came

    first = max(root.leaves(), key=lambda n: n.name or "")
    a, _, _ = farthest(first)
    b, dist, came = farthest(a)
    half, n = dist[id(b)] / 2, b
    while came[id(n)] is not None and dist[id(came[id(n)])] > half:
        n = came[id(n)]
    m = came[id(n)]
    if m is None:
        return root
    # The edge between n and m holds the middle: split it, then turn parents round.
    child, parent = (n, m) if n.parent is m else (m, n)
    to_child = abs(dist[id(child)] - half)
    to_parent = (child.length or 0.0) - to_child
    parent.children = [c for c in parent.children if c is not child]
    top = Node(name="root")
    up, node, length = parent.parent, parent, to_parent
    old = parent.length
    child.length, child.parent = to_child, top
    top.children = [child, parent]
    parent.parent, parent.length = top, length
    while up is not None:
        up.children = [c for c in up.children if c is not node]
        node.children.append(up)
        following, keep = up.parent, up.length
        up.parent, up.length = node, old
        node, up, old = up, following, keep
    return collapse(top)


def ladderize(root: Node, ascending: bool = True) -> Node:
    """Children ordered by how many leaves they have, then by name."""
    size: dict[int, int] = {}
    for n in reversed(root.walk()):
        size[id(n)] = sum(size[id(c)] for c in n.children) or 1
        n.children.sort(key=lambda c: (size[id(c)] if ascending else -size[id(c)], c.name or ""))
    return root


def layout(root: Node) -> list[tuple[str, float, float]]:
    """(node, x, y): x is the distance to the root; tips have y 0, 1, ...; inner
    nodes the mean of their children's."""
    x = {r[0]: r[3] for r in rows(root)[0]}
    y: dict[int, float] = {id(n): float(k) for k, n in enumerate(root.leaves())}
    for n in reversed(root.walk()):
        if n.children:
            y[id(n)] = sum(y[id(c)] for c in n.children) / len(n.children)
    return [(n.name, x[n.name], y[id(n)]) for n in root.walk()]
