"""Near duplicates among vectors: a cover tree whose upper levels are Spark rows, by dual traversal.

Vectors of one label are compared by the cosine of their double-precision unit vectors; equal unit vectors are one
point with a weight. The tree of a label starts with one node; in each round, every node of more than ``CELL`` points
is opened: a net of its points (half as wide as the node, drawn in hash order from about ``SAMPLE`` of them) gives the
centers of its children, to which its points go by the nearest. Points of one node are dealt in chunks, so no node is
one task. Pairs of nodes descend along: a pair whose balls are farther apart than the threshold is dropped, a
pair whose balls lie within it counts as a whole (no pair of points is ever made), and the others are opened. Where
both nodes are cells, they meet in a unit of two cells at most, and the traversal goes on in memory
(:mod:`tunelake.llm.cover_tree`); a point comes to a unit only if the other cell's ball reaches it.

The sample decides where nodes are cut, not what is compared: bounds hold for the nodes as they are. In data without
any structure no bound drops a pair of cells, and exact pairs then cost the square of a label's points in
arithmetic and ``points / CELL`` copies of each point in shuffle, as for any exact method.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelake.llm import texts
from tunelake.llm.components import components
from tunelake.llm.cover_tree import MARGIN, CoverTree, Pairs, distances, reach, traverse
from tunelake.session import settle

COSINE = 0.93
CELL = 4096
SAMPLE = 1024
FANOUT = 64
VISITS = 16

POINT = "key binary, node string, weight long, vec binary, far double"


def _units(batches: Iterator[pa.RecordBatch], shown: bool) -> Iterator[pa.RecordBatch]:
    """Rows with the tree they belong to and the point they are; both NULL for a vector that links with nothing."""
    for batch in batches:
        vectors = batch.column("vec").cast(pa.large_list(pa.float64()))
        flat = vectors.flatten()
        values = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        roots, keys, units = [], [], []
        for label, size, end in zip(batch.column("label").to_pylist(), sizes.tolist(), ends.tolist(), strict=True):
            own = values[end - size: end]
            top = np.abs(own).max() if size else 0.0
            if label is None or not (0 < top < np.inf):
                roots.append(None), keys.append(None), units.append(None)
                continue
            own = own / top
            unit = (own / np.sqrt(own @ own) + 0.0).tobytes()
            name = hashlib.blake2b(label.encode(), digest_size=16)
            roots.append(f"{size}:{name.hexdigest()}/"), units.append(unit)
            keys.append(hashlib.blake2b(unit, digest_size=16, key=name.digest()).digest())
        columns = {"_id": batch.column("_id"), "key": pa.array(keys, pa.binary())}
        if shown:
            columns |= {"node": pa.array(roots, pa.string()), "vec": pa.array(units, pa.binary())}
        yield pa.RecordBatch.from_pydict(columns)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _net(table: pa.Table) -> pa.Table:
    """The centers of a node's children: in the sample's order, points farther than half its radius from all others
    chosen, at most ``fanout``."""
    table = table.sort_by("key")
    points, fanout = _matrix(table["vec"]), table["fanout"][0].as_py()
    half = distances(points @ points[0]).max() / 2
    chosen, nearest = [0], distances(points @ points[0])
    while len(chosen) < fanout:
        open_ = np.flatnonzero(nearest > half)
        if not len(open_):
            break
        chosen.append(int(open_[0]))
        nearest = np.minimum(nearest, distances(points @ points[chosen[-1]]))
    if half <= MARGIN:
        chosen = list(range(min(2, len(points)))) * 2
    return pa.table({"node": [table["node"][0].as_py()], "centers": pa.array([points[chosen].tobytes()], pa.binary())})


@texts.releasing
def _descend(points: pa.Table, plan: pa.Table) -> pa.Table:
    """A chunk of a node's points, each with its child: the nearest center, or any where all centers are one."""
    schema = pa.schema([("key", pa.binary()), ("node", pa.string()), ("weight", pa.int64()), ("vec", pa.binary()),
                        ("far", pa.float64())])
    if not points.num_rows:
        return schema.empty_table()
    centers = np.frombuffer(plan["centers"][0].as_py(), np.float64)
    vectors = _matrix(points["vec"])
    centers = centers.reshape(-1, vectors.shape[1])
    far = distances(vectors @ centers.T)
    if len(centers) < 2 or distances(centers @ centers[0]).max() <= 2 * MARGIN:
        # The draw is another one on each level, so that every level parts what the one above left together.
        drawn = np.frombuffer(b"".join(k[:8] for k in points["key"].to_pylist()), np.uint64)
        child = texts.mix(drawn + np.uint64(points["node"][0].as_py().count("/"))) % np.uint64(len(centers))
        child = child.astype(np.int64)
    else:
        child = far.argmin(1)
    far = far[np.arange(len(child)), child]
    node = points["node"][0].as_py()
    return pa.table([points["key"], pa.array([f"{node}{c}/" for c in child.tolist()]), points["weight"], points["vec"],
                     pa.array(far)], schema=schema)


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, centers, n_values) to rows (node, child, center)."""
    for batch in batches:
        rows = []
        for node, packed, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            found = [packed[i: i + 8 * size] for i in range(0, len(packed), 8 * size)]
            rows += [(node, f"{node}{i}/", c) for i, c in enumerate(found)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.binary()))],
            names=["node", "child", "center"])


def _bounds(batches: Iterator[pa.RecordBatch], limit: float) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes that are not too far apart; ``whole`` if all their points are partners."""
    for batch in batches:
        gap = np.array([np.sqrt(max(2 - 2 * float(np.frombuffer(x) @ np.frombuffer(y)), 0)) if a != b else 0.0
                        for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ca", "cb")), strict=True)])
        slack = batch.column("ra").to_numpy() + batch.column("rb").to_numpy()
        batch = batch.append_column("whole", pa.array(gap + slack < limit - MARGIN, pa.bool_()))
        yield batch.filter(pa.array(gap - slack <= limit + MARGIN, pa.bool_()))


UNIT = "a string, b string, side int, keys binary, weights binary, vecs binary"


@texts.releasing
def _visit(points: pa.Table, partners: pa.Table, limit: float) -> pa.Table:
    """A cell's message to each unit it takes part in: the points that the other cell's ball reaches."""
    rows = []
    if points.num_rows:
        vectors, weights = _matrix(points["vec"]), points["weight"].to_numpy()
        keys = np.frombuffer(b"".join(points["key"].to_pylist()), np.uint8).reshape(-1, 16)
        for a, b, side, center, radius in zip(
                *(partners[c].to_pylist() for c in ("a", "b", "side", "center", "radius")), strict=True):
            near = slice(None)
            if center is not None:
                near = distances(vectors @ np.frombuffer(center)) - radius <= limit + MARGIN
            if len(weights[near]):
                rows.append((a, b, side, keys[near].tobytes(), weights[near].tobytes(), vectors[near].tobytes()))
    kinds = (pa.string(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    names = [name.split()[0] for name in UNIT.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


FOUND = "key binary, low binary, n long"


@texts.releasing
def _meet(table: pa.Table, cosine: float) -> pa.Table:
    """A unit: partners of each of its points, and the smallest key of the class that its links join it to."""
    table = table.sort_by("side")
    weights = [np.frombuffer(v, np.int64) for v in table["weights"].to_pylist()]
    sides = [CoverTree(np.frombuffer(v).reshape(len(w), -1)) for v, w in zip(table["vecs"].to_pylist(), weights, strict=True)]
    pairs = Pairs(np.concatenate(weights))
    if table["a"][0].as_py() == table["b"][0].as_py():
        traverse(sides[0], sides[0], pairs, cosine)
    elif len(sides) == 2:
        traverse(sides[0], sides[1], pairs, cosine, shift=len(weights[0]))
    label = pairs.settle()
    raw = b"".join(table["keys"].to_pylist())
    at = np.flatnonzero(pairs.found > 0)
    cut = [raw[16 * i: 16 * i + 16] for i in at.tolist()]
    low = [raw[16 * i: 16 * i + 16] for i in label[at].tolist()]
    return pa.table({"key": pa.array(cut, pa.binary()), "low": pa.array(low, pa.binary()), "n": pairs.found[at]})


def near_vectors(
    vectors: DataFrame, *, key: str = "vec_id", label: str = "label", vector: str = "embedding",
    cosine: float = COSINE, cell: int = CELL,
) -> DataFrame:
    """One row per row of ``vectors``: the key, ``n_links`` (other rows of the same label and length with this cosine at
    least), ``component_id`` (the smallest key that links reach) and ``kept`` (the key is the smallest).

    A row links with nothing if its label or vector is NULL or the vector is empty, all zeros, or holds a NULL or
    non-finite component. Rows with equal keys are vectors of their own; a NULL key is smallest only where all are.
    Other columns are left out; an empty table gives no rows.
    """
    limit = reach(cosine)
    given = vectors.select(F.col(key).alias("_id"), F.col(label).cast("string").alias("label"),
                           F.col(vector).cast("array<double>").alias("vec"))
    kind = given.schema["_id"].dataType.simpleString()
    members = settle(
        given.mapInArrow(lambda b: _units(b, True), f"_id {kind}, key binary, node string, vec binary")
        .where("key IS NOT NULL").groupBy("key").agg(
            F.first("node").alias("node"), F.count("*").alias("weight"), F.first("vec").alias("vec"),
            F.min("_id").alias("_low"))
        .withColumn("far", F.lit(2.0)))
    lows, members = members.select("key", "weight", "_low"), members.drop("_low")

    pairs = members.select("node").distinct().select(F.col("node").alias("a"), F.col("node").alias("b"))
    wholes, cells = [], None
    while True:
        sizes = members.groupBy("node").agg(F.count("*").alias("n"), F.min("key").alias("first"))
        big = settle(sizes.where(F.col("n") > cell).withColumns({
            "chunks": F.ceil(F.col("n") / cell).cast("int"),
            "fanout": F.least(F.lit(FANOUT), F.greatest(F.lit(8), F.ceil(2 * F.col("n") / cell))).cast("int")}))
        if big.isEmpty():
            break
        drawn = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
        opened = members.join(big, "node", "left")
        plan = settle(opened.where((F.col("n") > 0) & ((drawn * F.col("n") < F.lit(SAMPLE << 30)) | (F.col("key") == F.col("first"))))
                      .select("node", "key", "vec", "fanout").groupBy("node").applyInArrow(_net, "node string, centers binary"))
        chunked = opened.where("n > 0").select(
            "node", "key", "weight", "vec", "far", F.pmod(F.xxhash64("key", F.lit(3)), "chunks").cast("int").alias("chunk"))
        plans = plan.join(big, "node").select("node", "centers", F.explode(
            F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        moved = chunked.groupBy("node", "chunk").cogroup(plans.groupBy("node", "chunk")).applyInArrow(
            lambda p, c: _descend(p, c), POINT)
        members = settle(opened.where("n IS NULL").select("key", "node", "weight", "vec", "far").unionByName(moved))
        shape = members.groupBy("node").agg(F.max("far").alias("radius"), F.sum("weight").alias("sum"),
                                            F.min("key").alias("first"))
        length = F.regexp_extract("node", "^([0-9]+):", 1).cast("int")
        centers = plan.select("node", "centers", length.alias("size")).mapInArrow(
            _children, "node string, child string, center binary")
        fresh = centers.join(shape.withColumnRenamed("node", "child"), "child").select(
            "node", "child", "center", "radius", "sum", "first")
        if cells is not None:
            # Cells that were not opened stay as they are, each its own child.
            rest = cells.join(big.select(F.col("node").alias("child")), "child", "left_anti").select(
                F.col("child").alias("node"), "child", "center", "radius", "sum", "first")
            fresh = fresh.unionByName(rest)
        cells = settle(fresh)
        side = lambda to: cells.select(F.col("node").alias(to), F.col("child").alias(f"n{to}"),
                                       F.col("center").alias(f"c{to}"), F.col("radius").alias(f"r{to}"))
        split = pairs.join(side("a"), "a").join(side("b"), "b").where("a <> b OR na <= nb")
        still = pairs.join(cells.select(F.col("node").alias("a")).distinct(), "a", "left_anti")
        schema = "a string, b string, ca binary, cb binary, ra double, rb double, whole boolean"
        judged = settle(split.select(F.col("na").alias("a"), F.col("nb").alias("b"), "ca", "cb", "ra", "rb").mapInArrow(
            lambda b: _bounds(b, limit), schema))
        wholes.append(judged.where("whole").select("a", "b"))
        pairs = settle(judged.where("NOT whole").select("a", "b").unionByName(still))

    # Units of two cells at most.
    shapes = cells if cells is not None else members.where("false").select(
        F.col("node").alias("child"), F.col("vec").alias("center"), F.col("far").alias("radius"))
    other = shapes.select(F.col("child").alias("other"), "center", "radius")
    visits = pairs.select("a", "b", F.col("a").alias("node"), F.col("b").alias("other"), F.lit(0).alias("side")).unionByName(
        pairs.where("a <> b").select("a", "b", F.col("b").alias("node"), F.col("a").alias("other"), F.lit(1).alias("side")))
    visits = visits.join(other, "other", "left").select(
        "node", "a", "b", "side", F.when(F.col("a") != F.col("b"), F.col("center")).alias("center"), "radius")
    # A cell of many partners sends its messages in several parts, each of bounded size.
    parts = visits.groupBy("node").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("parts"))
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    guests = members.join(parts, "node").withColumn("part", at).drop("parts")
    visits = visits.join(parts.withColumnRenamed("parts", "of"), "node").withColumn(
        "part", F.pmod(F.xxhash64("a", "b"), "of")).drop("of")
    units = guests.groupBy("node", "part").cogroup(visits.groupBy("node", "part")).applyInArrow(
        lambda p, v: _visit(p, v, limit), UNIT)
    found = settle(units.groupBy("a", "b").applyInArrow(lambda t: _meet(t, cosine), FOUND))
    links, counts = found.select(F.col("key").alias("a"), F.col("low").alias("b")), found.select("key", "n")
    if wholes:
        more, joined = _from_wholes(wholes, members)
        counts, links = counts.unionByName(more), links.unionByName(joined)

    total = counts.groupBy("key").agg(F.sum("n").alias("n"))
    roots = components(links)
    points = lows.join(total, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left").select(
        "key", F.coalesce("root", "key").alias("root"), "_low",
        (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    smallest = points.groupBy("root").agg(F.min("_low").alias("component_id"))
    points = points.join(smallest, "root").select("key", "n_links", "component_id")
    rows = given.mapInArrow(lambda b: _units(b, False), f"_id {kind}, key binary").join(points, "key", "left")
    component = F.when(F.col("n_links").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return rows.select(F.col("_id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                       component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def _from_wholes(wholes: list[DataFrame], members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts and links from pairs of nodes whose points are all partners: sums by node, handed to the points below it."""
    pairs = wholes[0]
    for further in wholes[1:]:
        pairs = pairs.unionByName(further)
    # A node's name begins with those of the nodes above it, each ending in "/".
    steps = F.filter(F.split("node", "/"), lambda step: step != "")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.concat(
        F.array_join(F.slice(steps, F.lit(1), k), "/"), F.lit("/")))
    below = members.groupBy("node").agg(F.sum("weight").alias("weight"), F.min("key").alias("first")).select(
        F.col("node").alias("cell"), "weight", "first", F.explode(above).alias("node"))
    nodes = settle(below.groupBy("node").agg(F.sum("weight").alias("weight"), F.min("first").alias("first")))
    a, b = (nodes.select(F.col("node").alias(x), F.col("weight").alias(f"w{x}"), F.col("first").alias(f"f{x}"))
            for x in "ab")
    full = pairs.join(a, "a").join(b, "b")
    per_node = full.select(F.col("a").alias("node"), F.col("wb").alias("n"), (F.col("a") == F.col("b")).alias("own"),
                           F.col("fb").alias("to")).unionByName(
        full.where("a <> b").select(F.col("b").alias("node"), F.col("wa").alias("n"), F.lit(False).alias("own"),
                                    F.col("fa").alias("to"))).groupBy("node").agg(
        F.sum("n").alias("n"), F.bool_or("own").alias("own"), F.min("to").alias("to"))
    per_cell = below.select("cell", "node").join(per_node, "node").groupBy("cell").agg(
        F.sum("n").alias("n"), F.sum(F.col("own").cast("long")).alias("own"), F.min("to").alias("to"))
    given = members.join(per_cell.withColumnRenamed("cell", "node"), "node")
    counts = given.select("key", (F.col("n") - F.col("own") * F.col("weight")).alias("n"))
    links = given.select(F.col("key").alias("a"), F.col("to").alias("b")).unionByName(
        full.select(F.col("fa").alias("a"), F.col("fb").alias("b"))).unionByName(
        below.join(per_node, "node").select(F.col("first").alias("a"), F.col("to").alias("b")))
    return counts, links
