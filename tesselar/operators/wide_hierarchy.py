"""Class hierarchies of thousands of classes, over arrays of energies or probabilities.

The tree goes into a plan as arrays of numbers (siblings next to each other, parents first), so an expression has the same size for
ten classes and for ten thousand; only those constants grow. Still one projection: no shuffle, no Python at run time.
Results are arrays in the order of classes. A row that lacks a class's energy gets null for what depends on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ints(values: Iterable[int]) -> Column:
    """A constant array; as text it is one node of the plan until it is folded."""
    text = ",".join(map(str, values))
    return F.split(F.lit(text), ",").cast("array<int>") if text else F.array().cast("array<int>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(xs: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + of(x))


def log_sum_exp(xs: Column) -> Column:
    with_top = F.struct(xs.alias("xs"), F.array_max(xs).alias("top"))
    return let(with_top, lambda s: s["top"] + F.log(total(s["xs"], lambda x: F.exp(x - s["top"]))))


class Layout:
    """Places of a tree's nodes: groups of siblings in turn, the roots first, each group by class. Absent nodes have none, nor has what is below them."""

    def __init__(self, parent: Sequence[int | None], absent: frozenset[int] = frozenset()):
        self.parent, below = tuple(parent), {}
        for i, p in enumerate(self.parent):
            if i not in absent:
                below.setdefault(p, []).append(i)
        self.order, self.up, self.group = [], [], []
        self.first, self.count, self.children_group = [], [], []
        waiting, at = [(None, -1)], 0
        while at < len(waiting):
            node, place = waiting[at]
            at += 1
            members = below.get(node, [])
            if not members:
                continue
            if place >= 0:
                self.children_group[place] = len(self.first)
            self.first.append(len(self.order))
            self.count.append(len(members))
            for i in members:
                waiting.append((i, len(self.order)))
                self.order.append(i)
                self.up.append(place)
                self.group.append(len(self.first) - 1)
                self.children_group.append(-1)
        if not absent and len(self.order) < len(self.parent):
            raise ValueError("not a tree")

    def depth(self) -> int:
        level = []
        for p in self.up:
            level.append(1 if p < 0 else level[p] + 1)
        return max(level, default=0)

    def places(self) -> list[int]:
        """The place of each class."""
        found = [0] * len(self.parent)
        for place, i in enumerate(self.order):
            found[i] = place
        return found

    def jumps(self) -> list[list[int]]:
        """For each place the one 1, 2, 4, ... levels up (-1 above the roots), until all are above."""
        found, up = [], list(self.up)
        while any(p >= 0 for p in up):
            found.append(up)
            up = [-1 if p < 0 else up[p] for p in up]
        return found

    def leaf_ranges(self) -> tuple[list[int], list[int], list[int]]:
        """Leaves so ordered that those below any class are neighbours, and each class's first one and number of them."""
        size = [0] * len(self.order)
        for place in reversed(range(len(self.order))):
            size[place] = size[place] or 1
            if self.up[place] >= 0:
                size[self.up[place]] += size[place]
        first, used = [0] * len(self.order), {}
        for place, p in enumerate(self.up):
            first[place] = used.get(p, 0 if p < 0 else first[p])
            used[p] = first[place] + size[place]
        leaves = [0] * sum(size[k] for k, p in enumerate(self.up) if p < 0)
        for place, g in enumerate(self.children_group):
            if g < 0:
                leaves[first[place]] = self.order[place]
        at = self.places()
        return leaves, [first[k] for k in at], [size[k] for k in at]


def _picked(values: Column, at: list[int]) -> Column:
    return let(values, lambda v: F.transform(ints(at), lambda i: F.get(v, i).cast("double")))


def _conditional(layout: Layout, e: Column) -> Column:
    norms = F.zip_with(ints(layout.first), ints(layout.count), lambda s, n: log_sum_exp(F.slice(e, s + 1, n)))
    return let(norms, lambda z: F.zip_with(e, ints(layout.group), lambda x, k: x - F.get(z, k)))


def conditional_log_softmax(energy: Column, parent: Sequence[int | None]) -> Column:
    """Log-softmax of each class among its siblings."""
    layout = Layout(parent)
    cond = let(_picked(energy, layout.order), lambda e: _conditional(layout, e))
    return let(cond, lambda c: _picked(c, layout.places()))


def source_log_softmax(energy: Column, parent: Sequence[int | None]) -> Column:
    """Top down: each class's conditional log probability plus those of all its ancestors.

    Sums over ancestors take one pass for each doubling of the depth.
    """
    layout = Layout(parent)
    cond = let(_picked(energy, layout.order), lambda e: _conditional(layout, e))
    jumps = layout.jumps()
    if jumps:
        cond = F.aggregate(F.array(*map(ints, jumps)), cond, lambda have, up: F.zip_with(have, up, lambda v, p: F.when(p < 0, v).otherwise(v + F.get(have, p))))
    return let(cond, lambda c: _picked(c, layout.places()))


def sink_log_softmax(energy: Column, parent: Sequence[int | None]) -> Column:
    """Bottom up: softmax over leaves, a class is the sum of the leaves below it. Time is the leaves below each class, summed."""
    leaves, first, count = Layout(parent).leaf_ranges()
    with_norm = lambda e: F.struct(e.alias("e"), log_sum_exp(e).alias("norm"))
    each = lambda s: F.zip_with(ints(first), ints(count), lambda k, n: log_sum_exp(F.slice(s["e"], k + 1, n)) - s["norm"])
    return let(let(_picked(energy, leaves), with_norm), each)


def softmax(energy: Column, parent: Sequence[int | None]) -> Column:
    return F.transform(source_log_softmax(energy, parent), F.exp)


def cross_entropy(energy: Column, target: Column, parent: Sequence[int | None]) -> Column:
    """Loss of one row; null for a target that is no class."""
    return -F.get(source_log_softmax(energy, parent), target)


def gini(p: Column) -> Column:
    return 1.0 - total(p, lambda x: x * x)


def entropy(p: Column) -> Column:
    return 0.0 - total(p, lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0))


def _walk(p: Column, layout: Layout, deeper: Callable[[Column, Column, Column], Column], enter: Callable[[Column, Column], Column]) -> Column:
    """struct(node, conf) where a walk down from the roots ends.

    It goes to the best sibling (the first one on ties) if enter(state, siblings) holds, and on to its children
    if deeper(siblings, index of the best, place of the best) does.
    """
    order, first, count, below = (ints(x) for x in (layout.order, layout.first, layout.count, layout.children_group))
    state = lambda node, conf, group: F.struct(node.cast("int").alias("node"), conf.cast("double").alias("conf"), group.cast("int").alias("group"))

    def step(s: Column, _: Column) -> Column:
        def choose(sib: Column) -> Column:
            best = F.array_position(sib, F.array_max(sib)).cast("int") - 1

            def move(b: Column) -> Column:
                place = F.get(first, s["group"]) + b
                onward = F.when(deeper(sib, b, place), F.get(below, place)).otherwise(F.lit(-1))
                return F.when(enter(s, F.get(sib, b)), state(F.get(order, place), F.get(sib, b), onward)).otherwise(state(s["node"], s["conf"], F.lit(-1)))

            return let(best, move)

        siblings = F.slice(p, F.get(first, s["group"]) + 1, F.get(count, s["group"]))
        return F.when(s["group"] < 0, s).otherwise(let(siblings, choose))

    start = state(F.lit(None), F.lit(None), F.lit(0))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(layout.depth())), start, step)
    return let(end, lambda s: F.struct(s["node"].alias("node"), s["conf"].alias("conf")))


def prob_decision(p: Column, parent: Sequence[int | None], thresh: float = 0.1) -> Column:
    """struct(node, conf): go down while a class and its best child are above thresh."""
    layout = Layout(parent)
    deeper = lambda sib, b, place: F.get(sib, b) > thresh
    enter = lambda s, conf: s["node"].isNull() | (conf > thresh)
    return let(_picked(p, layout.order), lambda q: _walk(q, layout, deeper, enter))


def decision(p: Column, parent: Sequence[int | None], thresh: float = 0.5, criterion: Callable[[Column], Column] | str = gini, ignore: frozenset[int] = frozenset(), always: frozenset[int] = frozenset()) -> Column:
    """struct(node, conf): refine a class where its children say much more than an even split would.

    criterion: gini, entropy, their names, or "prob", which is prob_decision. Ignored classes are treated as
    absent; classes of `always` are refined whatever the gain is.
    """
    if criterion == "prob":
        return prob_decision(p, parent, thresh)
    measure = {"gini": gini, "entropy": entropy}[criterion] if isinstance(criterion, str) else criterion
    layout = Layout(parent, frozenset(ignore))
    if not layout.order:
        raise ValueError("all roots are ignored")
    first, count, below = ints(layout.first), ints(layout.count), ints(layout.children_group)
    forced = ints(int(i in always) for i in layout.order)

    def walk(q: Column) -> Column:
        def deeper(sib: Column, b: Column, place: Column) -> Column:
            group = F.get(below, place)
            kids = F.slice(q, F.get(first, group) + 1, F.get(count, group))
            n = F.get(count, group)
            others = F.filter(sib, lambda x, i: i != b)
            even = F.array_repeat(F.get(sib, b) / n, n)
            gain = 1 - measure(F.concat(others, kids)) / (measure(F.concat(others, even)) + 1e-30)
            return (group >= 0) & ((F.get(forced, place) == 1) | (n == 1) | (gain > thresh))

        return _walk(q, layout, deeper, lambda s, conf: F.lit(True))

    return let(_picked(p, layout.order), walk)
