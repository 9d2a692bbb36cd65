"""Class hierarchies: probabilities, losses and decisions as expressions over an energy array.

A tree is small and known when a plan is made, so each operator is one projection: no
shuffle, no explode, no Python at run time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """parent[i] is the parent of class i, None for roots."""

    parent: tuple[int | None, ...]

    def __post_init__(self):
        for i in range(len(self.parent)):
            seen, at = {i}, self.parent[i]
            while at is not None:
                if at in seen:
                    raise ValueError("not a tree")
                seen.add(at)
                at = self.parent[at]

    @property
    def roots(self) -> list[int]:
        return self.children(None)

    def children(self, node: int | None) -> list[int]:
        return [i for i, p in enumerate(self.parent) if p == node]

    @property
    def leaves(self) -> list[int]:
        return [i for i in range(len(self.parent)) if not self.children(i)]

    def leaves_below(self, node: int) -> list[int]:
        return [x for c in self.children(node) for x in self.leaves_below(c)] or [node]


def _lse(xs: list[Column]) -> Column:
    if len(xs) == 1:
        return xs[0]
    if len(xs) > 4:  # as an array, which keeps the generated code small
        held = F.array(*xs)
        wide = F.array(F.struct(held.alias("xs"), F.array_max(held).alias("top")))
        return F.transform(wide, lambda s: s["top"] + F.log(F.aggregate(s["xs"], F.lit(0.0), lambda a, x: a + F.exp(x - s["top"]))))[0]
    top = F.greatest(*xs)
    return top + F.log(sum((F.exp(x - top) for x in xs[1:]), F.exp(xs[0] - top)))


def conditional_log_softmax(energy: Column, tree: Tree) -> list[Column]:
    """Log-softmax of each class among its siblings."""
    e = [energy[i].cast("double") for i in range(len(tree.parent))]
    norm = {p: _lse([e[i] for i in tree.children(p)]) for p in set(tree.parent)}
    return [e[i] - norm[p] for i, p in enumerate(tree.parent)]


def source_log_softmax(energy: Column, tree: Tree) -> list[Column]:
    """Top down: log probability given the siblings plus that of the parent."""
    cond = conditional_log_softmax(energy, tree)

    def path(i: int) -> Column:
        return cond[i] if tree.parent[i] is None else cond[i] + path(tree.parent[i])

    return [path(i) for i in range(len(cond))]


def sink_log_softmax(energy: Column, tree: Tree) -> list[Column]:
    """Bottom up: softmax over leaves, a parent is the sum of its children."""
    e = [energy[i].cast("double") for i in range(len(tree.parent))]
    norm = _lse([e[i] for i in tree.leaves])
    return [_lse([e[j] for j in tree.leaves_below(i)]) - norm for i in range(len(e))]


def softmax(energy: Column, tree: Tree) -> list[Column]:
    """Probability of each class: that among its siblings times that of its parent."""
    return [F.exp(x) for x in source_log_softmax(energy, tree)]


def nll(logp: list[Column], target: Column) -> Column:
    """Loss of one row; null for a target that is no class."""
    return -F.get(F.array(*logp), target)


def cross_entropy(energy: Column, target: Column, tree: Tree) -> Column:
    """Loss of one row, from energies; coarse targets ignore what lies below them."""
    return nll(source_log_softmax(energy, tree), target)


def reduced(loss: Column, reduction: str = "mean") -> Column:
    """The loss over all rows as "mean" or "sum" (aggregates), or of each row as "none"."""
    if reduction not in ("mean", "sum", "none"):
        raise ValueError(f"unknown reduction {reduction!r}")
    return {"mean": F.avg, "sum": F.sum, "none": lambda x: x}[reduction](loss)


def gini(p: list[Column]) -> Column:
    return F.lit(1.0) - sum((x * x for x in p[1:]), p[0] * p[0])


def entropy(p: list[Column]) -> Column:
    part = lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0)
    return -sum((part(x) for x in p[1:]), part(p[0]))


def _argmax(p: list[Column], nodes: list[int]) -> Column:
    """The first of the nodes with the largest probability."""
    top = F.greatest(*[p[i] for i in nodes]) if len(nodes) > 1 else p[nodes[0]]
    return F.coalesce(*[F.when(p[i] == top, F.lit(i)) for i in nodes])


def _answer(node: int, p: list[Column]) -> Column:
    return F.struct(F.lit(node).alias("node"), p[node].alias("conf"))


def prob_decision(p: list[Column], tree: Tree, thresh: float = 0.1) -> Column:
    """struct(node, conf): go down while the class and its best child are above thresh."""

    def walk(nodes: list[int]) -> Column:
        best, out = _argmax(p, nodes), None
        for k in nodes:
            own = _answer(k, p)
            if tree.children(k):
                below = walk(tree.children(k))
                own = F.when((p[k] > thresh) & (below["conf"] > thresh), below).otherwise(own)
            out = F.when(best == k, own) if out is None else out.when(best == k, own)
        return out

    return walk(tree.roots)


def decision(p: list[Column], tree: Tree, thresh: float = 0.5, criterion: Callable | str = gini, ignore: frozenset[int] = frozenset(), always: frozenset[int] = frozenset()) -> Column:
    """struct(node, conf): refine a class where its children say much more than an even split would.

    criterion: gini, entropy, their names, or "prob", which is prob_decision. Ignored classes are treated as
    absent; classes of `always` are refined whatever the gain is.
    """
    if criterion == "prob":
        return prob_decision(p, tree, thresh)
    criterion = {"gini": gini, "entropy": entropy}[criterion] if isinstance(criterion, str) else criterion
    if not set(tree.roots) - ignore:
        raise ValueError("all roots are ignored")

    def walk(nodes: list[int]) -> Column:
        nodes = [i for i in nodes if i not in ignore]
        best, out = _argmax(p, nodes), None
        for k in nodes:
            own, below = _answer(k, p), [c for c in tree.children(k) if c not in ignore]
            if below:
                finer = walk(below)
                if k in always or len(below) == 1:
                    own = finer
                else:
                    others = [p[i] for i in nodes if i != k]
                    even = [p[k] / len(below)] * len(below)
                    gain = 1 - criterion(others + [p[c] for c in below]) / (criterion(others + even) + 1e-30)
                    own = F.when(gain > thresh, finer).otherwise(own)
            out = F.when(best == k, own) if out is None else out.when(best == k, own)
        return out

    return walk(tree.roots)
