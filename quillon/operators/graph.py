"""Graph operators over edge tables (src, dst)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.schema import PROXIMITY_RELATIONS, SYMMETRIC_RELATIONS

#: Edges that one task searches for strong components.
ONE_TASK = 1_000_000
#: Rows that one task of a join by key reads, about.
TASK_ROWS = 500_000


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): edges that touch a node; a loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def incident(edges: DataFrame, ids: DataFrame, relations: tuple[str, ...] | None = None) -> DataFrame:
    """Edges with an end in ids (column id) and, if given, one of the relations; each once."""
    e = edges if relations is None else edges.where(F.col("relation").isin(*relations))
    out = e.join(ids.select(F.col("id").alias("src")), "src", "left_semi").select(edges.columns)
    into = e.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(edges.columns)
    return out.unionByName(into).distinct()


def proximity(edges: DataFrame, candidates: DataFrame, decay: float = 0.5, relations: tuple[str, ...] = PROXIMITY_RELATIONS, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, id, graph): what candidates (by, id, score) give to their neighbours, at most 1, candidates left out.

    Symmetric relations are walked both ways, the others from src to dst.
    """
    e = edges.where(F.col("relation").isin(*relations))
    give = lambda at, to, e: e.join(candidates.select(*by, F.col("id").alias(at), "score"), at).select(*by, F.col(to).alias("id"), (F.col("score") * decay * F.col("weight")).alias("g"))
    both = give("src", "dst", e).unionByName(give("dst", "src", e.where(F.col("relation").isin(*SYMMETRIC_RELATIONS))))
    return both.groupBy(*by, "id").agg(F.least(F.lit(1.0), F.sum("g")).alias("graph")).join(candidates.select(*by, "id"), [*by, "id"], "left_anti")


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by keys in partitions of about TASK_ROWS of its `rows` rows, so that a task's memory doesn't follow the table; a number below the session's is left to it."""
    n = -(-rows // TASK_ROWS)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)


def co_occurrence(retrievals: DataFrame, step: float = 0.1, cap: float = 5.0, rows: int | None = None) -> DataFrame:
    """(src, dst, weight) for every ordered pair of nodes that were retrieved together (query_id, node_id; rows may be repeated).

    The pairs are the result; a retrieval holds as many nodes as its k. Each pair is counted once and written both ways. rows: how many
    retrievals has, if that is known.
    """
    rows = retrievals.count() if rows is None else rows
    r = dealt(retrievals, rows, "query_id").distinct()
    pairs = r.select("query_id", F.col("node_id").alias("src")).join(r.select("query_id", F.col("node_id").alias("dst")), "query_id").where("src < dst")
    counted = dealt(pairs, 2 * rows, "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("n")).select("src", "dst", F.least(F.col("n") * step, F.lit(cap)).alias("weight"))
    ways = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    return counted.select(F.explode(ways).alias("w"), "weight").select(F.col("w.a").alias("src"), F.col("w.b").alias("dst"), "weight")


def bfs(edges: DataFrame, starts: DataFrame, max_hops: int, directed: bool = False) -> DataFrame:
    """(id, hop): fewest hops from any start (id); a loop of max_hops joins, each from the last frontier only, which is a written table."""
    folder = work_dir(edges.sparkSession)
    step = edges.select("src", "dst")
    if not directed:
        step = step.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = frontier = saved(starts.select("id").distinct().withColumn("hop", F.lit(0)), f"{folder}/0")
    for hop in range(1, max_hops + 1):
        near = frontier.select(F.col("id").alias("src")).join(step, "src").select(F.col("dst").alias("id")).distinct()
        frontier = saved(near.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop)), f"{folder}/{hop}")
        seen = seen.unionByName(frontier)
    return seen


def traverse(edges: DataFrame, starts: DataFrame, max_hops: int, relations: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, hop) by hop and id, edges that the walk went over): undirected, from starts (id)."""
    e = edges if relations is None else edges.where(F.col("relation").isin(*relations))
    near = bfs(e, starts, max_hops)
    inner = near.where(F.col("hop") < max_hops).select("id")
    return near.orderBy("hop", "id"), incident(e, inner)


def ego(edges: DataFrame, node, hops: int) -> DataFrame:
    """Edges among the nodes within 1 to 4 hops of a node."""
    near = bfs(edges, edges.sparkSession.createDataFrame([(node,)], "id long"), max(1, min(hops, 4))).select("id")
    return edges.join(near.withColumnRenamed("id", "src"), "src", "left_semi").join(near.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns)


def scoped(near: DataFrame, edges: DataFrame, nodes: DataFrame, keys: list[str] | None = None, base_only: bool = False) -> DataFrame:
    """(id, why) of the nodes in `near` (id) that a scope lets through, in two passes.

    nodes: (id, project_key, base). `strict`: a project in `keys` or the base flag (only that, with base_only). `boundary`: a node without a
    project and without the flag that an edge joins to a strict one; with base_only there are none. Without a scope all pass.
    """
    held = nodes.join(near.select("id").distinct(), "id", "left_semi").select("id", "project_key", F.coalesce("base", F.lit(False)).alias("base"))
    if not base_only and keys is None:
        return held.select("id", F.lit("strict").alias("why"))
    inside = F.col("base") if base_only else F.coalesce(F.col("project_key").isin(*keys), F.lit(False)) | F.col("base")
    strict = held.where(inside).select("id", F.lit("strict").alias("why"))
    if base_only:
        return strict
    loose = held.where(F.col("project_key").isNull() & ~F.col("base")).select("id")
    e = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    joined = e.join(strict.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    return strict.unionByName(loose.join(joined, "id", "left_semi").select("id", F.lit("boundary").alias("why")))


def scoped_ego(edges: DataFrame, nodes: DataFrame, starts: DataFrame, hops: int, keys: list[str] | None = None, base_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, hop, why), edges among them) within 1 to 4 hops of starts (id) over all relations, then through the two passes of a scope.

    The walk itself isn't bound by the scope; a start that no node has gives nothing.
    """
    begun = starts.join(nodes.select("id"), "id", "left_semi")
    near = bfs(edges, begun, max(1, min(hops, 4)))
    kept = saved(near.join(scoped(near, edges, nodes, keys, base_only), "id"), work_dir(edges.sparkSession))
    inner = edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi")
    return kept, inner.select(edges.columns)


#: Role of a neighbour -> the relation that makes it one, and whether the symbol is that edge's source. Fixed values.
ROLES = {"caller": ("calls", False), "callee": ("calls", True), "defines_in": ("defines", False), "method_of": ("method_of", True), "served_by": ("routes_to", False), "commit": ("references_function", False)}


def symbol_detail(edges: DataFrame, symbols: DataFrame, rows: int | None = None) -> DataFrame:
    """(id, role, other): the neighbours of symbols (id) in all six roles, from edges (src, dst, relation) in one pass over either end.

    Edges are dealt by the symbol, once for each end, and repeated ones go where they were dealt. rows: how many edges there are, if that is known.
    """
    rows = edges.count() if rows is None else rows
    at = {side: [(role, rel) for role, (rel, out) in ROLES.items() if out == side] for side in (True, False)}
    def of(side: bool, mine: str, other: str) -> DataFrame:
        role = F.create_map(*[F.lit(x) for r, rel in at[side] for x in (rel, r)])
        e = dealt(edges.where(F.col("relation").isin(*[rel for _, rel in at[side]])), rows, mine)
        return e.join(dealt(symbols.select(F.col("id").alias(mine)), rows, mine), mine, "left_semi").select(F.col(mine).alias("id"), role[F.col("relation")].alias("role"), F.col(other).alias("other")).distinct()

    return of(True, "src", "dst").unionByName(of(False, "dst", "src"))


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest node of each connected component, by minimum labels and pointer jumping."""
    folder, step = work_dir(edges.sparkSession), 0
    both = saved(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), f"{folder}/edges")
    labels = saved(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m")).select("id", F.least("id", "m").alias("label")), f"{folder}/0")
    while True:
        step += 1
        near = both.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("m"))
        lower = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "m").alias("to"))
        made = saved(lower.join(labels.select(F.col("id").alias("to"), F.col("label").alias("far")), "to").select("id", "old", F.least("to", "far").alias("label")), f"{folder}/{step}")
        labels = made.select("id", "label")
        if made.where("label <> old").isEmpty():
            return labels


def work_dir(spark) -> str:
    """A new folder name under the cluster's shared checkpoint folder; only on one machine, where none is set, a temporary folder serves."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        top = held.get()
    return f"{top.rstrip('/')}/quillon-{uuid.uuid4().hex}"


def saved(df: DataFrame, folder: str) -> DataFrame:
    """A round's table, written and read again: lost executors cost nothing, and neither plans nor their constraints grow from round to round."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def least_reaching(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest node from which each node of the edges can be reached, itself included.

    What reaches the label of a node reaches the node, so labels jump over labels and long paths take few rounds.
    """
    folder, step = work_dir(edges.sparkSession), 0
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    labels = saved(ends.select("id", F.col("id").alias("label")), f"{folder}/0")
    while True:
        step += 1
        near = edges.join(labels.select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("m"))
        lower = labels.join(near, "id", "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("to"))
        jumped = lower.join(labels.select(F.col("id").alias("to"), F.col("label").alias("far")), "to").select("id", "old", F.least("to", "far").alias("label"))
        made = saved(jumped, f"{folder}/{step}")
        labels = made.select("id", "label")
        if made.where("label <> old").isEmpty():
            return labels


def cycles(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(id, cycle): nodes on a directed cycle, with the smallest node of their strongly connected component.

    Distributed colouring: a node gets the smallest node that reaches it and the smallest that it reaches. Where they are one node,
    both stand in that node's component, and it is done; an edge whose ends differ in either colour lies on no cycle and goes. The
    rest is coloured again; in each round the component of every part's smallest node is done. What is left is searched in one
    task as soon as it has at most `one_task` edges, with the same result.
    """
    folder, step = work_dir(edges.sparkSession), 0
    left = saved(edges.select("src", "dst").distinct(), f"{folder}/edges-0")
    found = left.where("src = dst").select(F.col("src").alias("id"), F.col("src").alias("cycle"))
    left = left.where("src <> dst")
    while not left.isEmpty():
        if left.count() <= one_task:
            found = found.unionByName(left.groupBy(F.lit("").alias("_all")).applyInPandas(lambda g: strong_components(g), "id long, cycle long"))
            break
        step += 1
        ahead, back = least_reaching(left), least_reaching(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        both = saved(ahead.join(back.select("id", F.col("label").alias("into")), "id"), f"{folder}/colours-{step}")
        done = both.where("label = into")
        found = found.unionByName(done.join(done.where("id <> label").select("label").distinct(), "label", "left_semi").select("id", F.col("label").alias("cycle")))
        open_ = both.where("label <> into")
        ends = [open_.select(F.col("id").alias(side), F.struct("label", "into").alias(f"_{side}")) for side in ("src", "dst")]
        left = saved(left.join(ends[0], "src").join(ends[1], "dst").where("_src = _dst").select("src", "dst"), f"{folder}/edges-{step}")
    return found.groupBy("id").agg(F.min("cycle").alias("cycle"))


def strong_components(group: pd.DataFrame) -> pd.DataFrame:
    """Strong components of two or more nodes, or with a loop: two sweeps of depth-first search without recursion."""
    ahead: dict[int, list[int]] = {}
    back: dict[int, list[int]] = {}
    loops = set()
    for a, b in zip(group["src"].tolist(), group["dst"].tolist(), strict=True):
        ahead.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
        if a == b:
            loops.add(a)
    order, seen = [], set()
    for root in sorted(set(ahead) | set(back)):
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(ahead.get(root, ())))]
        while stack:
            node, todo = stack[-1]
            nxt = next((x for x in todo if x not in seen), None)
            if nxt is None:
                order.append(node)
                stack.pop()
            else:
                seen.add(nxt)
                stack.append((nxt, iter(ahead.get(nxt, ()))))
    done: set[int] = set()
    out: list[tuple[int, int]] = []
    for root in reversed(order):
        if root in done:
            continue
        done.add(root)
        part, todo = [root], [root]
        while todo:
            for x in back.get(todo.pop(), ()):
                if x not in done:
                    done.add(x)
                    part.append(x)
                    todo.append(x)
        if len(part) > 1 or root in loops:
            out += [(x, min(part)) for x in part]
    return pd.DataFrame(out, columns=["id", "cycle"])


#: Version of the layout's steps; stored layouts of another one are stale.
LAYOUT = "layout-3"
#: Rounds of forces of the largest component and of the others. Fixed values.
ROUNDS_GIANT, ROUNDS_OTHER = 120, 70
#: Nodes of a component that is laid out by its shape.
SHAPED = 256


def clean_edges(edges: DataFrame) -> DataFrame:
    """Undirected edges once, loops gone."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def spectral(n: int, pairs: np.ndarray, rounds: int = 120) -> np.ndarray:
    """The two first non-trivial eigenvectors of the normalised Laplacian, for one component of n nodes.

    Subspace iteration over the list of edges: memory and each round grow with the edges, not with n squared.
    """
    degree = np.bincount(pairs.ravel(), minlength=n).astype(float)
    d = 1 / np.sqrt(np.maximum(degree, 1))
    weight = d[pairs[:, 0]] * d[pairs[:, 1]]
    flat = np.sqrt(np.maximum(degree, 1))
    flat /= np.sqrt((flat**2).sum())
    x = np.random.default_rng(42).normal(size=(n, 2))
    for _ in range(rounds):
        x -= flat[:, None] * (flat @ x)[None, :]
        y = x.copy()  # the shift keeps all eigenvalues above 0
        for k in range(2):
            y[:, k] += np.bincount(pairs[:, 0], weight * x[pairs[:, 1], k], n) + np.bincount(pairs[:, 1], weight * x[pairs[:, 0], k], n)
        x, _ = np.linalg.qr(y) if n >= 2 else (y, None)
        if x.shape[1] < 2:
            x = np.pad(x, ((0, 0), (0, 2 - x.shape[1])))
    signs = np.sign(x[np.abs(x).argmax(axis=0), np.arange(2)])
    return x * np.where(signs == 0, 1, signs)


def repulsion(x: np.ndarray, weight: np.ndarray, scale: float, grid: int = 32) -> np.ndarray:
    """What all nodes push each: a mesh of cells, every cell's centre of mass acting on all others and on its own nodes."""
    low = x.min(axis=0)
    step = np.maximum((x.max(axis=0) - low) / grid, 1e-9)
    cell = np.minimum(((x - low) / step).astype(np.int64), grid - 1)
    cell = cell[:, 0] * grid + cell[:, 1]
    used, own = np.unique(cell, return_inverse=True)
    mass = np.bincount(own, weight)
    centre = np.stack([np.bincount(own, weight * x[:, k]) / mass for k in (0, 1)], axis=1)
    gap = centre[:, None, :] - centre[None, :, :]
    square = (gap**2).sum(axis=2)
    np.fill_diagonal(square, np.inf)
    field = scale * ((mass[None, :] / square)[:, :, None] * gap).sum(axis=1)
    rest = np.maximum(mass[own] - weight, 0.0)
    inner = x - centre[own]
    near = scale * (rest / ((inner**2).sum(axis=1) + (step**2).sum() * 0.01))[:, None] * inner
    return weight[:, None] * (field[own] + near)


def force(position: np.ndarray, pairs: np.ndarray, rounds: int = 120, gravity: float = 0.05, scale: float = 14.0) -> np.ndarray:
    """Linear-log attraction along edges against repulsion by degree, step sizes shrinking."""
    x = position.copy()
    weight = 1 + np.bincount(pairs.ravel(), minlength=len(x)).astype(float)
    for k in range(rounds):
        edge = x[pairs[:, 1]] - x[pairs[:, 0]]
        length = np.sqrt((edge**2).sum(axis=1)) + 1e-9
        f = (np.log1p(length) / length)[:, None] * edge
        pull = np.stack([np.bincount(pairs[:, 0], f[:, c], len(x)) - np.bincount(pairs[:, 1], f[:, c], len(x)) for c in (0, 1)], axis=1)
        move = repulsion(x, weight, scale) + pull - gravity * weight[:, None] * x
        size = np.sqrt((move**2).sum(axis=1)) + 1e-9
        x += move / size[:, None] * np.minimum(size, 10.0 * (1 - k / rounds) + 0.1)[:, None]
    return x


def spiral(position: np.ndarray, arms: int = 4, gamma: float = 1.5, winding: float = 4.4, world: float = 2000.0) -> np.ndarray:
    """Positions bent onto logarithmic spiral arms; radius by rank so that the field fills evenly."""
    if not len(position):
        return position
    centred = position - position.mean(axis=0)
    radius = np.sqrt((centred**2).sum(axis=1))
    rank = np.argsort(np.argsort(radius, kind="stable"), kind="stable") / max(1, len(radius) - 1)
    angle = np.arctan2(centred[:, 1], centred[:, 0])
    arm = np.round(angle / (2 * np.pi) * arms) / arms * 2 * np.pi
    bent = 0.65 * arm + 0.35 * angle + winding * rank
    r = world * rank ** (1 / gamma)
    return np.stack([r * np.cos(bent), r * np.sin(bent)], axis=1)


def close_pairs(x: np.ndarray, least: float, crowd: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of points closer than `least`, each pair once, by a grid of that width: a point meets its own cell and the four after it.

    Of one cell a point meets the `crowd` points that come next in order, so a heap of equal points costs its size and not its square.
    """
    cell = np.floor(x / least).astype(np.int64)
    cell -= cell.min(axis=0)
    wide = int(cell[:, 1].max()) + 3
    key = (cell[:, 0] + 1) * wide + cell[:, 1] + 1
    order = np.argsort(key, kind="stable")
    held = key[order]
    firsts, seconds = [], []
    for step in (0, 1, wide - 1, wide, wide + 1):
        low = np.arange(1, len(x) + 1) if step == 0 else np.searchsorted(held, held + step, "left")
        n = np.minimum(np.searchsorted(held, held + step, "right") - low, crowd)
        n = np.maximum(n, 0)
        ramp = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        firsts.append(order[np.repeat(np.arange(len(x)), n)])
        seconds.append(order[np.repeat(low, n) + ramp])
    i, j = np.concatenate(firsts), np.concatenate(seconds)
    near = ((x[i] - x[j]) ** 2).sum(axis=1) < least**2
    return i[near], j[near]


def separate(position: np.ndarray, least: float, rounds: int = 60) -> np.ndarray:
    """Push points that are closer than `least` apart, half of what they lack each, until none is or `rounds` are over; equal points part by their order."""
    x = position.copy()
    for k in range(rounds if len(x) > 1 else 0):
        i, j = close_pairs(x, least * 0.999)
        if not len(i):
            break
        gap = x[i] - x[j]
        far = np.sqrt((gap**2).sum(axis=1))
        turn = (i * 2.399963229728653 + j + k)[:, None] + np.array([0.0, np.pi / 2])
        way = np.where((far < 1e-9)[:, None], np.cos(turn), gap / np.maximum(far, 1e-9)[:, None])
        push = way * ((least - far) / 2)[:, None]
        met = np.bincount(np.concatenate([i, j]), minlength=len(x))[:, None]
        move = np.zeros_like(x)
        np.add.at(move, i, push)
        np.add.at(move, j, -push)
        x += move / np.maximum(1, np.sqrt(met))
    return x


def place(n: int, pairs: np.ndarray, rounds: int) -> np.ndarray:
    """Positions of one component's nodes 0 to n - 1, from its pairs in order."""
    return separate(spiral(force(spectral(n, pairs) * 100, pairs, rounds)), 8.0)


def layout(edges: DataFrame) -> DataFrame:
    """(label, id, x, y): a deterministic layout of each connected component, by the same steps at every size.

    The largest component (of equal ones that with the smallest label) gets ROUNDS_GIANT rounds of forces, every other one ROUNDS_OTHER. Positions
    depend on a component's shape only: its pairs, with nodes numbered in order. Of the components of at most SHAPED nodes each shape is laid out
    once, for all that have it; each other component is laid out in one task, in memory of its nodes and edges.
    """
    clean, folder = clean_edges(edges), work_dir(edges.sparkSession)
    labels = components(clean)
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    giant = sizes.agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("_giant"))  # one row
    of = clean.join(labels.withColumnRenamed("id", "src"), "src").join(sizes, "label").crossJoin(F.broadcast(giant)).withColumn("giant", F.col("label") == F.col("_giant")).drop("_giant")
    of = saved(of, f"{folder}/pairs")
    small = (F.col("n") <= SHAPED) & ~F.col("giant")

    def alone(group: pd.DataFrame) -> pd.DataFrame:
        src, dst = group["src"].to_numpy(), group["dst"].to_numpy()
        ids = np.unique(np.concatenate([src, dst]))
        pairs = np.stack([np.searchsorted(ids, src), np.searchsorted(ids, dst)], axis=1)
        x = place(len(ids), pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))], ROUNDS_GIANT if group["giant"].iloc[0] else ROUNDS_OTHER)
        return pd.DataFrame({"label": group["label"].iloc[0], "id": ids, "x": x[:, 0], "y": x[:, 1]})

    def shapes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = [place(n, np.stack([a, b], axis=1).astype(np.int64), ROUNDS_OTHER) for n, a, b in zip(part["n"], part["a"], part["b"], strict=True)]
            yield part.assign(x=[m[:, 0] for m in made], y=[m[:, 1] for m in made])

    held = of.where(small).groupBy("label", "n").agg(F.sort_array(F.collect_list(F.struct("src", "dst"))).alias("e"))
    held = held.withColumn("ids", F.array_sort(F.array_distinct(F.concat("e.src", "e.dst"))))
    number = lambda side: F.transform("e", lambda p: (F.array_position("ids", p[side]) - 1).cast("int"))
    held = saved(held.select("label", F.col("n").cast("int").alias("n"), "ids", number("src").alias("a"), number("dst").alias("b")), f"{folder}/shaped")
    # A stated number of partitions: shapes are few bytes and much work, and would be merged into few tasks.
    once = held.select("n", "a", "b").distinct().repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")
    once = saved(once.mapInPandas(shapes, "n int, a array<int>, b array<int>, x array<double>, y array<double>"), f"{folder}/shapes")
    at = held.join(once, ["n", "a", "b"]).select("label", F.explode(F.arrays_zip("ids", "x", "y")).alias("p")).select("label", F.col("p.ids").alias("id"), "p.x", "p.y")
    return of.where(~small).groupBy("label").applyInPandas(alone, "label long, id long, x double, y double").unionByName(at)


def placed(layouts: DataFrame) -> DataFrame:
    """(id, x, y): the components of a layout in one field, the largest in its middle and the others around it by size.

    Only one box for each component is collected into an order; nodes are moved by a join.
    """
    boxes = layouts.groupBy("label").agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))

    def scatter(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["n", "label"], ascending=[False, True]).reset_index(drop=True)
        inner = max(g["w"].iloc[0], g["h"].iloc[0]) / 2
        at = [(0.0, 0.0), *pack_field(list(zip(g["w"].iloc[1:], g["h"].iloc[1:], strict=True)), inner)]
        return pd.DataFrame({"label": g["label"], "mx": [p[0] for p in at] - g["cx"], "my": [p[1] for p in at] - g["cy"]})

    moves = boxes.groupBy(F.lit("").alias("_all")).applyInPandas(scatter, "label long, mx double, my double")
    return layouts.join(moves, "label").select("id", (F.col("x") + F.col("mx")).alias("x"), (F.col("y") + F.col("my")).alias("y"))


def pack_field(boxes: list[tuple[float, float]], radius: float) -> Iterator[tuple[float, float]]:
    """Centres for small components around the giant one, at golden angles."""
    for k, (w, h) in enumerate(boxes):
        r = radius + max(w, h) * (1 + k) ** 0.5
        yield r * np.cos(k * 2.399963229728653), r * np.sin(k * 2.399963229728653)
