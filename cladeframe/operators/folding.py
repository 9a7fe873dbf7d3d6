"""Networks of single trees inside tasks: folding, passing over idle nodes, path counts, and the measures of a pair.

The definitions are those of `networks`, whose operators make each step for all trees at once and
shuffle nodes and edges in each. Here a tree is one row, packed where a shuffle has put it, so what
follows moves no node. Work and memory follow a tree's own size. Short texts are folded once for as
long as a worker remembers them, as small trees over few labels are often met again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property, lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that a worker remembers, and their greatest length.
REMEMBERED, SHORT = 2048, 400


def packed(nodes: DataFrame) -> DataFrame:
    """One row per tree: ``tree_id, los`` (the numbers of its nodes in preorder), ``text`` (their depths and leaves' labels)."""
    node = F.struct("lo", "depth", F.when(F.col("is_leaf"), F.col("label")).alias("label"))
    trees = nodes.groupBy("tree_id").agg(F.sort_array(F.collect_list(node)).alias("n"))
    return trees.select("tree_id", F.col("n.lo").cast("array<long>").alias("los"), F.to_json(F.struct(F.col("n.depth").alias("d"), F.col("n.label").alias("l"))).alias("text"))


class Network:
    """The network of one tree. A node is named by its place in preorder; the reticulation above the copies of node n is -n - 1."""

    def __init__(self, text: str):
        read = json.loads(text)
        depth, self.label = read["d"], read["l"]
        n = len(depth)
        self.parent: list[int] = [-1] * n
        #: the last place below each node
        self.end = list(range(n))
        path: list[int] = []
        for i in range(n):
            while path and depth[path[-1]] >= depth[i]:
                path.pop()
            if path:
                self.parent[i] = path[-1]
            path.append(i)
        below: list[list[int]] = [[] for _ in range(n)]
        kinds: dict = {}
        code = [0] * n
        for i in range(n - 1, -1, -1):
            code[i] = kinds.setdefault(tuple(sorted(below[i])) if below[i] else self.label[i], len(kinds))
            up = self.parent[i]
            if up >= 0:
                below[up].append(code[i])
                self.end[up] = max(self.end[up], self.end[i])
        first: dict[int, int] = {}
        #: nodes that folding meets, and the first copy of each one's kind
        self.live: list[int] = []
        self.first: dict[int, int] = {}
        gone, copies = -1, {}
        for i in range(n):
            f = first.setdefault(code[i], i)
            if i <= gone:
                continue
            self.live.append(i)
            self.first[i] = f
            copies.setdefault(f, []).append(i)
            if f != i:
                gone = self.end[i]
        #: copies of each reticulation that are met, by its number, in order
        self.copies = {f: x for f, x in copies.items() if len(x) > 1}

    def species(self, i: int) -> set[str]:
        found = set(self.label[i : self.end[i] + 1])
        found.discard(None)
        return found

    @cached_property
    def counts(self) -> dict[str, int]:
        found: dict[str, int] = {}
        for x in self.label:
            if x is not None:
                found[x] = found.get(x, 0) + 1
        return found

    @cached_property
    def events(self) -> int:
        return sum(len(x) - 1 for x in self.copies.values())

    @cached_property
    def leaf_sets(self) -> list[set[str]]:
        """Species below each reticulation."""
        return [self.species(f) for f in self.copies]

    @cached_property
    def sister_sets(self) -> list[list[set[str]]]:
        """Species beside each reticulation, one set per distinct parent."""
        children: dict[int, list[int]] = {}
        for i in self.live:
            children.setdefault(self.parent[i], []).append(i)
        return [[set().union(*(self.species(c) for c in children[p] if self.first[c] != f)) for p in sorted({self.parent[i] for i in x})] for f, x in self.copies.items()]

    @cached_property
    def links(self) -> tuple[dict[int, set[int]], dict[int, set[int]]]:
        """The nodes with what leads into them, and with what they lead to, after nodes with one way in and one way out have been passed over."""
        ins: dict[int, set[int]] = {x: set() for x in self.first.values()}
        outs: dict[int, set[int]] = {x: set() for x in ins}
        for f in self.copies:
            ins[-f - 1], outs[-f - 1] = set(), {f}
            ins[f].add(-f - 1)
        for i in self.live[1:]:
            f, up = self.first[i], self.parent[i]
            down = -f - 1 if f in self.copies else f
            outs[up].add(down)
            ins[down].add(up)
        left = [x for x, down in outs.items() if len(down) == 1]
        while left:
            x = left.pop()
            if x in ins and len(ins[x]) == 1 and len(outs[x]) == 1:
                (up,), (down,) = ins.pop(x), outs.pop(x)
                outs[up].discard(x)
                ins[down].discard(x)
                outs[up].add(down)
                ins[down].add(up)
                left += (up, down)
        return ins, outs

    @cached_property
    def vectors(self) -> tuple[list[int], list[int], list[str]]:
        """The nodes, their numbers of ways in, and their paths to species."""
        ins, outs = self.links
        paths = {x: {self.label[x]: 1} for x, down in outs.items() if not down}
        todo = [0]
        while todo:
            x = todo[-1]
            if x not in paths:
                more = [y for y in outs[x] if y not in paths]
                if more:
                    todo += more
                    continue
                total: dict[str, int] = {}
                for y in outs[x]:
                    for k, v in paths[y].items():
                        total[k] = total.get(k, 0) + v
                paths[x] = total
            todo.pop()
        return list(paths), [len(ins[x]) for x in paths], [",".join(sorted([f"{k}:{v}" for k, v in p.items()])) for p in paths.values()]

    @cached_property
    def in_class(self) -> bool:
        """Whether path counts tell it apart: no reticulation right below another, and all degrees those of a leaf, a reticulation or a tree node."""
        ins, outs = self.links
        for x, up in ins.items():
            down = outs[x]
            if (len(up) != 1) if not down else (len(down) != 1) if len(up) > 1 else (len(down) != 2):
                return False
            if len(up) > 1 and any(len(ins[y]) > 1 for y in down):
                return False
        return True


_remembered = lru_cache(REMEMBERED)(Network)


def network(text: str) -> Network:
    return _remembered(text) if len(text) <= SHORT else Network(text)


def _matched(left: Sequence[set[str]], right: Sequence[set[str]]) -> list[tuple[int, int, int]]:
    """Pairs from the most alike on (ties by place), then what is left on both sides in order: places and how many they share."""
    pairs = []
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            shared = len(x & y)
            if shared:
                pairs.append((-shared / (len(x) + len(y) - shared), i, j, shared))
    pairs.sort()
    a, b, met = dict.fromkeys(range(len(left))), dict.fromkeys(range(len(right))), []
    for _, i, j, shared in pairs:
        if i in a and j in b:
            del a[i], b[j]
            met.append((i, j, shared))
    return met + [(i, j, 0) for i, j in zip(a, b)]


def _sums(sizes: Sequence[tuple[int, int, int]]) -> tuple[float, float, float]:
    """Distance, false positives and negatives over pairs ``shared, n_a, n_b``."""
    dist = fp = fn = 0.0
    for s, a, b in sizes:
        dist += (a + b - 2 * s) / (a + b - s) if a + b > s else 0.0
        fp += (b - s) / b if b else 0.0
        fn += (a - s) / a if a else 0.0
    return dist, fp, fn


def _forms(sums: tuple[float, float, float], l: int, r: int) -> tuple[float, ...]:  # noqa: E741
    """``dist, fp, fn, tp`` penalised, then over matched pairs, from the sums over pairs and both numbers of sets (see `networks._normalised`)."""
    if not l or not r:
        return (1.0, 0.0, 1.0, 0.0) * 2 if l else (1.0, 1.0, 0.0, 0.0) * 2
    dist, fp, fn = sums
    most, least = max(l, r), min(l, r)
    full, found = (dist + most - least) / most, dist / least
    return full, (fp + most - l) / most, (fn + most - r) / most, 1 - full, found, fp / least, fn / least, 1 - found


def _pairs(a: Network, b: Network) -> list[tuple[int, int, int]]:
    return _matched(a.leaf_sets, b.leaf_sets)


def leaf_forms(a: Network, b: Network) -> tuple[float, ...] | None:
    """`networks.leaf_set_distance` of two networks; None where neither has a reticulation."""
    x, y = a.leaf_sets, b.leaf_sets
    if not x and not y:
        return None
    return _forms(_sums([(s, len(x[i]), len(y[j])) for i, j, s in _pairs(a, b)]), len(x), len(y))


def sister_forms(a: Network, b: Network) -> tuple[float, ...] | None:
    """`networks.sister_set_distance` of two networks; None where neither has a reticulation."""
    if not a.copies and not b.copies:
        return None
    dist = fp = fn = 0.0
    for i, j, _ in _pairs(a, b):
        x, y = a.sister_sets[i], b.sister_sets[j]
        # two parents without another child are alike, and count nothing where they stay alone
        met = _matched([s or {""} for s in x], [s or {""} for s in y])
        sizes = [(s, max(len(x[p]), 1), max(len(y[q]), 1)) if s else (0, len(x[p]), len(y[q])) for p, q, s in met]
        one = _forms(_sums(sizes), len(x), len(y))
        dist, fp, fn = dist + one[0], fp + one[1], fn + one[2]
    return _forms((dist, fp, fn), len(a.copies), len(b.copies))


def mu_forms(a: Network, b: Network) -> tuple[float | None, float]:
    """The share of vectors that the other network lacks, null where either is out of its class or the species differ, and whether it is defined."""
    if not a.in_class or not b.in_class or a.counts.keys() != b.counts.keys():
        return None, 0.0
    x, y = (list(zip(*n.vectors[1:])) for n in (a, b))
    p, q = set(x), set(y)
    return (sum(v not in q for v in x) + sum(v not in p for v in y)) / (len(x) + len(y)), 1.0


def copy_forms(a: Network, b: Network) -> tuple[float, float, float, float, float]:
    """`networks.ploidy_difference` (dist, fp, fn, tp) and `networks.polyploid_jaccard`."""
    tp = fp = fn = every = both = some = 0
    for s in a.counts.keys() | b.counts.keys():
        t, i = a.counts.get(s, 0), b.counts.get(s, 0)
        both += t > 1 and i > 1
        some += t > 1 or i > 1
        if t != 1 or i != 1:
            tp += min(t, i) - 1
            fp += max(i - t, 0)
            fn += max(t - i, 0)
            every += max(t, i) - 1
    return 1 - tp / every if every else 0.0, float(fp), float(fn), float(tp), 1 - both / some if some else 0.0


def all_forms(a: Network, b: Network) -> tuple[float | None, ...]:
    """Both numbers of events, then `copy_forms`, `leaf_forms`, `sister_forms` and `mu_forms`."""
    none = (0.0,) * 8
    return float(a.events), float(b.events), *copy_forms(a, b), *(leaf_forms(a, b) or none), *(sister_forms(a, b) or none), *mu_forms(a, b)


def _measured(batches: Iterator[pa.RecordBatch], keys: Sequence[str], measure: Callable) -> Iterator[pa.RecordBatch]:
    bare = Network('{"d":[],"l":[]}')
    of = lambda text: bare if text is None else network(text)
    for batch in batches:
        values = [None if x is None and y is None else measure(of(x), of(y)) for x, y in zip(batch["a"].to_pylist(), batch["b"].to_pylist())]
        yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), pa.array(values, pa.list_(pa.float64()))], names=[*keys, "values"])


def measured(pairs: DataFrame, measure: Callable[[Network, Network], tuple[float | None, ...] | None]) -> DataFrame:
    """Replaces the texts ``a, b`` of pairs of trees by ``values`` of the measure; a side without text is an empty network, both without have null."""
    keys = [c for c in pairs.columns if c not in ("a", "b")]
    schema = pairs.select(*keys, F.lit(None).cast("array<double>").alias("values")).schema
    return pairs.mapInArrow(partial(_measured, keys=keys, measure=measure), schema)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        # each distinct text of a batch once
        texts = batch["text"].dictionary_encode()
        found = zip(*(network(text).vectors for text in texts.dictionary.to_pylist()))
        made = [pa.array(x, pa.list_(t)).take(texts.indices) for x, t in zip(found, (pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch["tree_id"], batch["los"], *made], names=["tree_id", "los", "nodes", "ins", "vectors"])


def vectors(trees: DataFrame) -> DataFrame:
    """`networks.mu_vectors` of `packed` trees."""
    schema = trees.select("tree_id", "los", *(F.lit(None).cast(t).alias(c) for c, t in (("nodes", "array<long>"), ("ins", "array<long>"), ("vectors", "array<string>")))).schema
    rows = trees.mapInArrow(_vectors, schema).select("tree_id", "los", F.explode(F.arrays_zip("nodes", "ins", "vectors")).alias("v"))
    place = F.col("v.nodes")
    node = F.when(place < 0, -F.get("los", (-place - 1).cast("int")) - 1).otherwise(F.get("los", place.cast("int")))
    return rows.select("tree_id", node.alias("node"), F.col("v.ins").alias("in_degree"), F.col("v.vectors").alias("vector"))
