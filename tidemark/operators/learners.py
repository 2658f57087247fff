"""Tree and network ensembles over many runs at once.

A run is one group of daily rows (instrument, feature set, horizon); its data is bounded by its days.
What is many are members: trees, boosting settings, seeds. A small batch of them is a row of a task
table, fitted in its own task by a short NumPy routine (``spread`` deals the rows out); Spark
averages, ranks and selects over the members.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.spread import dealt, with_tasks
from tidemark.storage import cut


def _packed(rows: DataFrame, keys: list[str], x: list[str]) -> DataFrame:
    """One row per run: its days in order, with split, features and target."""
    fields = F.struct("day", F.col("split").alias("s"), F.array(*[F.col(c).cast("double") for c in x]).alias("x"), F.col("y").alias("y"))
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(fields)).alias("rows"))


def _unpacked(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    return np.array([r["s"] for r in rows]), np.array([list(r["x"]) for r in rows]), np.array([r["y"] for r in rows]), [r["day"] for r in rows]


def members(rows: DataFrame, keys: list[str], x: list[str], tasks: list[dict], fit: Callable, extra: str) -> DataFrame:
    """(keys, member, ..., day, split, y, y_pred): ``fit(split, X, y, task)`` gives predictions for
    every row and the values of the ``extra`` columns. Each run and member is a task."""
    names = list(tasks[0])
    asked = with_tasks(_packed(rows, keys, x), keys, tasks, 8 * len(x) + 64)
    added = [c.split()[0] for c in extra.split(", ")] if extra else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                split, features, target, days = _unpacked(r["rows"])
                for predictions, values in fit(split, features, target, {k: r[k] for k in names}):
                    use = split != "train"
                    out = pd.DataFrame({"day": np.array(days, object)[use], "split": split[use], "y": target[use], "y_pred": predictions[use]})
                    for k in keys:
                        out[k] = r[k]
                    out["member"] = r["member"]
                    for k, v in zip(added, values, strict=True):
                        out[k] = v
                    yield out[[*keys, "member", *added, "day", "split", "y", "y_pred"]]

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return asked.mapInPandas(run, f"{kinds}, member int, {extra + ', ' if extra else ''}day date, split string, y double, y_pred double")


# --- regression trees ----------------------------------------------------------------------------


#: Chunks of points that are sent to the models.
FEW_CHUNKS = 16
Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _by_value(x: np.ndarray) -> np.ndarray:
    """[feature, place]: rows in the order of each feature."""
    return np.argsort(x, axis=0, kind="stable").T


def _splits(orders: list[np.ndarray], columns: np.ndarray, y: np.ndarray, node: np.ndarray, value: np.ndarray, least_gain: np.ndarray, allowed: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Feature (-1: none) and threshold of the best split of each node, by running sums over the rows
    sorted by node and feature. ``orders`` has the rows in the order of each feature."""
    many, p = allowed.shape
    best, feature, threshold = least_gain.copy(), np.full(many, -1), np.zeros(many)
    short = np.uint16 if many <= 1 << 16 else np.int64  # 16 bits are sorted by digits
    every = allowed.all()
    for f in range(p):
        order = orders[f]
        if not every:
            order = order[allowed[node[order], f]]
        order = order[np.argsort(node[order].astype(short), kind="stable")]
        if len(order) < 2:
            continue
        own, at = node[order], columns[f][order]
        away = y[order] - value[own]  # centred, so that a node's sum is 0
        within = own[1:] == own[:-1]
        starts = np.flatnonzero(np.concatenate(([True], ~within)))
        size = np.diff(np.append(starts, len(own)))
        sums = np.cumsum(away)
        left = sums - np.repeat(sums[starts] - away[starts], size)
        k, m = np.arange(len(own)) - np.repeat(starts, size) + 1, np.repeat(size, size)
        square = left**2
        gain = square / k + square / np.maximum(m - k, 1)
        gain[:-1][~(within & (at[1:] > at[:-1]))] = -1.0
        gain[-1] = -1.0
        if least > 1:
            gain[(k < least) | (m - k < least)] = -1.0
        most = np.maximum.reduceat(gain, starts)
        hit = np.flatnonzero(gain == np.repeat(most, size))
        hit = hit[np.concatenate(([True], own[hit[1:]] != own[hit[:-1]]))]  # the first of each node
        hit = hit[most > best[own[starts]]]
        ids, low, high = own[hit], at[hit], at[np.minimum(hit + 1, len(at) - 1)]
        middle = (low + high) / 2
        best[ids], feature[ids], threshold[ids] = gain[hit], f, np.where(middle < high, middle, low)
    return feature, threshold


def _tried(rng: np.random.Generator, many: int, p: int, tried: int) -> np.ndarray:
    """[node, feature]: which features are tried at a node."""
    return rng.random((many, p)).argsort(axis=1).argsort(axis=1) < tried


def _means(inside: np.ndarray, aims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A node's mean and the least gain that counts for it."""
    many = int(inside.max()) + 1
    squares = np.bincount(inside, aims**2, many)
    return np.bincount(inside, aims, many) / np.bincount(inside, minlength=many), 1e-12 * np.maximum(squares, 1.0)


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, tried: int, depth: int, least: int = 1, by_value: np.ndarray | None = None) -> Tree:
    """A regression tree as arrays over nodes: feature (-1 in a leaf), threshold, left, right, value.
    All nodes of a level are split at once; rows in finished leaves are left behind. ``by_value`` may be
    given where many trees share ``x``."""
    n, p = x.shape
    columns, orders = np.ascontiguousarray(x.T), list(_by_value(x) if by_value is None else by_value)
    node, live, first, made = np.zeros(n, int), np.arange(n), 0, []
    while True:
        inside = node[live]
        value, least_gain = _means(inside, y[live])
        many, allowed = len(value), _tried(rng, len(value), p, tried)
        if len(made) < depth:
            feature, threshold = _splits(orders, columns, y, node, value, least_gain, allowed, least)
        else:
            feature, threshold = np.full(many, -1), np.zeros(many)
        split = feature >= 0
        child = np.cumsum(split) - 1
        to = first + many + 2 * child
        made.append((feature, threshold, np.where(split, to, -1), np.where(split, to + 1, -1), value))
        if not split.any():
            return tuple(np.concatenate(c) for c in zip(*made, strict=True))
        inner = split[inside]
        live, inside = live[inner], inside[inner]
        go = x[live, feature[inside]] > threshold[inside]
        node = np.full(n, -1)
        node[live], first = 2 * child[inside] + go, first + many
        if len(live) < n:
            orders = [o[node[o] >= 0] for o in orders]


def answers(x: np.ndarray, y: np.ndarray, ask: np.ndarray, drawn: np.ndarray, rng: np.random.Generator, tried: int, depth: int, by_value: np.ndarray | None = None) -> np.ndarray:
    """What each tree says of the point ``ask``, a tree for each row of ``drawn`` (places in ``x``). It is
    what ``grow`` and ``fall`` say, but only the nodes that ``ask`` falls into are split: no other part of
    a tree has a part in the answer. All trees go down a level at once."""
    (trees, n), p = drawn.shape, x.shape[1]
    rows, tree = drawn.ravel(), np.arange(trees)
    columns, aims, node = np.ascontiguousarray(x[rows].T), y[rows], np.repeat(tree, n)
    orders = []
    for order in _by_value(x) if by_value is None else by_value:
        rank = np.empty(len(x), np.uint16 if len(x) <= 1 << 16 else np.int64)
        rank[order] = np.arange(len(x))
        orders.append((np.argsort(rank[drawn], axis=1, kind="stable") + n * tree[:, None]).ravel())
    said, level = np.empty(trees), 0
    while True:
        live = orders[0]
        said[tree], least_gain = _means(node[live], aims[live])
        if level == depth:
            return said
        feature, threshold = _splits(orders, columns, aims, node, said[tree], least_gain, _tried(rng, len(tree), p, tried))
        split, level = feature >= 0, level + 1
        if not split.any():
            return said
        inside = node[live]
        live, inside = live[split[inside]], inside[split[inside]]
        kept = (columns[feature[inside], live] > threshold[inside]) == (ask[feature] > threshold)[inside]
        child, inside = np.cumsum(split) - 1, inside[kept]
        node = np.full(len(rows), -1)
        node[live[kept]], tree = child[inside], tree[split]
        orders = [o[node[o] >= 0] for o in orders]


def fall(tree: Tree, x: np.ndarray) -> np.ndarray:
    feature, threshold, left, right, value = tree
    at, live = np.zeros(len(x), int), np.arange(len(x))
    while len(live := live[feature[at[live]] >= 0]):
        here = at[live]
        go = x[live, feature[here]] <= threshold[here]
        at[live] = np.where(go, left[here], right[here])
    return value[at]


def _compact(tree: Tree) -> Tree:
    """The same tree in half the bytes: a node has a threshold or a value, and children count in 32 bits."""
    feature, threshold, left, right, value = tree
    number = np.where(feature >= 0, threshold, value)  # one array, pickled once
    return feature.astype(np.int32), number, left.astype(np.int32), right.astype(np.int32), number


def forest(rows: DataFrame, keys: list[str], x: list[str], trees: int, tried: int | None, name: str, batch: int = 25, depth: int = 1000) -> DataFrame:
    """Bagged trees, or a random forest where ``tried`` features are tried at a split. Fitted on
    train and val; forecasts for val and test."""
    tasks = [{"seed": 42 + i, "trees": min(batch, trees - i)} for i in range(0, trees, batch)]

    def fit(split, features, target, task):
        on = np.flatnonzero(split != "test")
        total = np.zeros(len(target))
        for k in range(task["trees"]):
            rng = np.random.default_rng((task["seed"], k))
            drawn = rng.choice(on, len(on))
            total += fall(grow(features[drawn], target[drawn], rng, tried or features.shape[1], depth), features)
        yield total, (task["trees"],)

    made = members(rows, keys, x, tasks, fit, "trees int")
    mean = F.sum("y_pred") / F.sum("trees")
    return made.groupBy(*keys, "day", "split").agg(F.first("y").alias("y"), mean.alias("y_pred")).withColumn("model", F.lit(name))


def grown_forest(rows: DataFrame, keys: list[str], x: list[str], trees: int, tried: int | None, batch: int = 25, depth: int = 1000) -> DataFrame:
    """(keys, member, trees, model): the trees themselves, packed, to score other points with."""
    tasks = [{"seed": 42 + i, "trees": min(batch, trees - i)} for i in range(0, trees, batch)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                split, features, target, _ = _unpacked(r["rows"])
                on, made = np.flatnonzero(split != "test"), []
                for k in range(r["trees"]):
                    rng = np.random.default_rng((r["seed"], k))
                    drawn = rng.choice(on, len(on))
                    made.append(_compact(grow(features[drawn], target[drawn], rng, tried or features.shape[1], depth)))
                yield pd.DataFrame({**{k: [r[k]] for k in keys}, "member": [r["member"]], "trees": [r["trees"]], "model": [pickle.dumps(made)]})

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    asked = with_tasks(_packed(rows, keys, x), keys, tasks, 8 * len(x) + 64)
    return cut(asked.mapInPandas(run, f"{kinds}, member int, trees int, model binary"))


def forest_scores(points: DataFrame, keys: list[str], x: list[str], models: DataFrame, chunk: int = 4096) -> DataFrame:
    """``points`` with ``y_pred``, the mean over the trees of their run. Points go to the models in
    chunks; each chunk and batch of trees is a row of its own. Few points are sent to the models, which
    stay in place; otherwise both are dealt out."""
    numbered = cut(points.withColumn("_point", F.monotonically_increasing_id()))
    many = numbered.count()
    packed = F.collect_list(F.struct("_point", F.array(*[F.col(c).cast("double") for c in x]).alias("x")))
    chunks = numbered.groupBy(*keys, F.pmod(F.xxhash64("_point"), F.ceil(F.lit(many / chunk))).alias("_chunk")).agg(packed.alias("rows"))
    here = many <= FEW_CHUNKS * chunk
    asked = models.join(F.broadcast(chunks), keys) if here else dealt(chunks.join(models, keys), chunks.count() * 16)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                values = np.array([list(p["x"]) for p in r["rows"]])
                yield pd.DataFrame({"_point": [p["_point"] for p in r["rows"]], "total": sum(fall(t, values) for t in pickle.loads(r["model"])), "trees": r["trees"]})

    made = asked.mapInPandas(run, "_point long, total double, trees int")
    mean = made.groupBy("_point").agg((F.sum("total") / F.sum("trees")).alias("y_pred"))
    return numbered.join(mean, "_point").drop("_point")


def _boost(features: np.ndarray, target: np.ndarray, rounds: int, rate: float, depth: int, seed: int) -> Iterator[np.ndarray]:
    """Predictions for all rows after each round; rows with a null target are not fitted."""
    on = np.flatnonzero(~np.isnan(target))
    now = np.full(len(target), target[on].mean())
    rng = np.random.default_rng(seed)
    fitted, aims = features[on], target[on]
    by_value = _by_value(fitted)
    for _ in range(rounds):
        tree = grow(fitted, aims - now[on], rng, features.shape[1], depth, by_value=by_value)
        now = now + rate * fall(tree, features)
        yield now


def tuned_boosting(rows: DataFrame, keys: list[str], x: list[str], sizes: list[int], rates: list[float], depths: list[int], seed: int = 42) -> DataFrame:
    """(keys, size, rate, depth): each (rate, depth) is grown once on train and judged on val at all
    sizes; the best setting, the first on ties."""
    tasks = [{"rate": r, "depth": d} for r in rates for d in depths]

    def tune(split, features, target, task):
        fitted = np.where(split == "train", target, np.nan)
        for i, now in enumerate(_boost(features, fitted, max(sizes), task["rate"], task["depth"], seed), 1):
            if i in sizes:
                yield now, (i, task["rate"], task["depth"])

    tuned = members(rows, keys, x, tasks, tune, "size int, rate double, depth int").where("split = 'val'")
    errors = tuned.groupBy(*keys, "size", "rate", "depth").agg(F.avg((F.col("y") - F.col("y_pred")) ** 2).alias("mse"))
    best = errors.groupBy(*keys).agg(F.min_by(F.struct("size", "rate", "depth"), F.struct("mse", "size", "rate", "depth")).alias("b"))
    return cut(best.select(*keys, "b.*"))  # a row per run


def boosted(rows: DataFrame, keys: list[str], x: list[str], settings: DataFrame, seed: int = 42) -> DataFrame:
    """Gradient boosting at given settings, fitted on train and val; forecasts for val and test."""
    packed = dealt(_packed(rows, keys, x).join(settings, keys), settings.count())

    def refit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                split, features, target, days = _unpacked(r["rows"])
                fitted = np.where(split != "test", target, np.nan)
                *_, last = _boost(features, fitted, r["size"], r["rate"], r["depth"], seed)
                use = split != "train"
                yield pd.DataFrame({**{k: r[k] for k in keys}, "day": np.array(days, object)[use], "split": split[use], "y": target[use], "y_pred": last[use]})

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return packed.mapInPandas(refit, f"{kinds}, day date, split string, y double, y_pred double").withColumn("model", F.lit("GB"))


def boosting(rows: DataFrame, keys: list[str], x: list[str], sizes: list[int], rates: list[float], depths: list[int], seed: int = 42) -> DataFrame:
    """Tuned on val, refitted on train and val."""
    return boosted(rows, keys, x, tuned_boosting(rows, keys, x, sizes, rates, depths, seed), seed)


# --- refits on rolling windows -------------------------------------------------------------------

#: Test rows of a run whose fits are a task.
FITS = 8


def rolling(rows: DataFrame, keys: list[str], x: list[str], fit: Callable, name: str, settings: DataFrame | None = None) -> DataFrame:
    """(keys, day, split, y, y_pred, model): a fit for each test row, on as many rows right before it as
    train and val have. ``fit(X, y, ask, place, setting)`` forecasts the row ``ask``, the test row of that
    place; ``settings`` has more fields of a run. A task has the rows of ``FITS`` fits."""
    fields = [c for c in (settings.columns if settings is not None else []) if c not in keys]
    packed = cut(_packed(rows, keys, x).withColumn("window", F.size(F.filter("rows", lambda r: r.s != "test"))))
    blocks = F.ceil((F.size("rows") - F.col("window")) / FITS).cast("int")
    packed = packed.where("window > 0").withColumn("blocks", blocks).where("blocks > 0")
    many = packed.agg(F.coalesce(F.sum("blocks"), F.lit(1))).first()[0]
    asked = packed.join(settings, keys) if fields else packed
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = asked.withColumn("rows", F.slice("rows", F.col("block") * FITS + 1, F.col("window") + FITS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                _, features, target, days = _unpacked(r["rows"])
                n, setting = r["window"], {c: r[c] for c in fields}
                last = range(n, len(target))
                made = [fit(features[i - n : i], target[i - n : i], features[i], r["block"] * FITS + i - n, setting) for i in last]
                yield pd.DataFrame({**{k: r[k] for k in keys}, "day": [days[i] for i in last], "split": "test", "y": target[n:], "y_pred": made})

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    dealt_out = dealt(asked.drop("blocks"), many)
    return dealt_out.mapInPandas(run, f"{kinds}, day date, split string, y double, y_pred double").withColumn("model", F.lit(name))


def rolling_forest(rows: DataFrame, keys: list[str], x: list[str], trees: int, tried: int | None, name: str, batch: int = 50, depth: int = 1000) -> DataFrame:
    """``forest`` fitted anew for each test row. A forest that is asked for one row grows no other branches."""

    def fit(features, target, ask, place, setting):
        rng, by_value, total = np.random.default_rng((42, place)), _by_value(features), 0.0
        for i in range(0, trees, batch):
            drawn = rng.integers(0, len(target), (min(batch, trees - i), len(target)))
            total += answers(features, target, ask, drawn, rng, tried or features.shape[1], depth, by_value).sum()
        return total / trees

    return rolling(rows, keys, x, fit, name)


def rolling_boosted(rows: DataFrame, keys: list[str], x: list[str], settings: DataFrame, seed: int = 42) -> DataFrame:
    """``boosted`` at given settings, fitted anew for each test row."""

    def fit(features, target, ask, place, setting):
        *_, last = _boost(np.vstack([features, ask]), np.append(target, np.nan), setting["size"], setting["rate"], setting["depth"], seed)
        return float(last[-1])

    return rolling(rows, keys, x, fit, "GB", settings)


# --- networks ------------------------------------------------------------------------------------

PYRAMIDS = {"NN1": [2], "NN2": [4, 2], "NN3": [8, 4, 2], "NN4": [16, 8, 4, 2]}


def _networks(x: np.ndarray, y: np.ndarray, ask: np.ndarray, layers: list[int], seeds: list[int], epochs: int, rate: float = 1e-3, batch: int = 64, patience: int = 25, held: float = 0.15) -> np.ndarray:
    """[seed, row of ``ask``]: ReLU networks by Adam, each stopped early on its own held slice. All
    seeds take their steps together, with one more axis in every array."""
    rngs = [np.random.default_rng(s) for s in seeds]
    sizes = [x.shape[1], *layers, 1]
    shapes = [shape for a, b in zip(sizes, sizes[1:], strict=False) for shape in ((a, b), (1, b))]
    ends = np.cumsum([a * b for a, b in shapes])

    def parts(flat: np.ndarray) -> list[np.ndarray]:
        return [flat[:, end - a * b : end].reshape(len(flat), a, b) for end, (a, b) in zip(ends, shapes, strict=True)]

    def run(values: np.ndarray, weights: list[np.ndarray]) -> list[np.ndarray]:
        acts = [values]
        for i in range(0, len(weights), 2):
            z = acts[-1] @ weights[i] + weights[i + 1]
            acts.append(np.maximum(z, 0) if i + 2 < len(weights) else z)
        return acts

    # a seed's weights are one row, so that a step of all layers is one expression
    flat = np.zeros((len(seeds), ends[-1]))
    for p, (a, b) in list(zip(parts(flat), shapes, strict=True))[::2]:
        p[:] = np.stack([r.normal(0, np.sqrt(2 / a), (a, b)) for r in rngs])
    slow, fast = np.zeros_like(flat), np.zeros_like(flat)
    order = np.stack([r.permutation(len(x)) for r in rngs])
    kept, out = order[:, int(held * len(x)) :].copy(), order[:, : int(held * len(x))]
    best, least, since, step = flat.copy(), np.full(len(seeds), np.inf), np.zeros(len(seeds), int), 0
    live = np.arange(len(seeds))
    for _ in range(epochs):
        for s in live:
            rngs[s].shuffle(kept[s])
        drawn, aims = x[kept[live]], y[kept[live]][:, :, None]
        for s in range(0, kept.shape[1], batch):
            params, slope = parts(flat), np.empty_like(flat)
            acts, into = run(drawn[:, s : s + batch], params), parts(slope)
            grad = 2 * (acts[-1] - aims[:, s : s + batch]) / acts[-1].shape[1]
            step += 1
            for j in range(len(params) - 2, -1, -2):
                before = acts[j // 2]
                into[j][:], into[j + 1][:] = before.transpose(0, 2, 1) @ grad, grad.sum(axis=1, keepdims=True)
                if j:
                    grad = grad @ params[j].transpose(0, 2, 1) * (before > 0)
            slow = 0.9 * slow + 0.1 * slope
            fast = 0.999 * fast + 0.001 * slope * slope
            flat = flat - rate * (slow / (1 - 0.9**step)) / (np.sqrt(fast / (1 - 0.999**step)) + 1e-8)
        error = ((run(x[out[live]], parts(flat))[-1][:, :, 0] - y[out[live]]) ** 2).mean(axis=1) if out.shape[1] else np.zeros(len(live))
        better = error < least[live] - 1e-5
        least[live], since[live] = np.where(better, error, least[live]), np.where(better, 0, since[live] + 1)
        best[live[better]] = flat[better]
        if not (going := since[live] < patience).all():  # stopped seeds take no more steps
            live, flat, slow, fast = live[going], flat[going], slow[going], fast[going]
        if not len(live):
            break
    return run(np.broadcast_to(ask, (len(seeds), *ask.shape)), parts(best))[-1][:, :, 0]


def networks(rows: DataFrame, keys: list[str], x: list[str], architectures: str | list[str], seeds: int = 100, epochs: int = 200, keep: int = 10, batch: int = 10) -> DataFrame:
    """Forecasts of the ``keep`` best seeds of each architecture by validation error, averaged (model
    ``NNk^10``), and of the single best (``NNk^1``). A task fits ``batch`` seeds of a run and an
    architecture, all of them in one job; the fits are written once and the choice is a window over seeds."""
    names = [architectures] if isinstance(architectures, str) else architectures

    def fit(split, features, target, task):
        on = split == "train"
        mx, sx, my, sy = features[on].mean(axis=0), features[on].std(axis=0), target[on].mean(), target[on].std()
        z = (features - mx) / np.where(sx > 0, sx, 1)
        drawn = list(range(task["first"], task["first"] + task["many"]))
        for seed, made in zip(drawn, _networks(z[on], (target[on] - my) / (sy or 1), z, PYRAMIDS[task["layers"]], drawn, epochs), strict=True):
            yield made * (sy or 1) + my, (task["layers"], seed)

    tasks = [{"layers": a, "first": 42 + i, "many": min(batch, seeds - i)} for a in names for i in range(0, seeds, batch)]
    made = cut(members(rows, keys, x, tasks, fit, "architecture string, seed int"))
    run = [*keys, "architecture"]
    error = made.where("split = 'val'").groupBy(*run, "seed").agg(F.avg((F.col("y") - F.col("y_pred")) ** 2).alias("mse"))
    ranked = error.withColumn("place", F.row_number().over(Window.partitionBy(*run).orderBy("mse", "seed"))).where(F.col("place") <= keep)
    chosen = made.join(ranked, [*run, "seed"])
    named = lambda many: F.concat("architecture", F.lit(f"^{many}")).alias("model")
    mean = chosen.groupBy(*run, "day", "split").agg(F.first("y").alias("y"), F.avg("y_pred").alias("y_pred"))
    return reduce(DataFrame.unionByName, [t.select(*keys, "day", "split", "y", "y_pred", named(k)) for t, k in ((mean, keep), (chosen.where("place = 1"), 1))])
