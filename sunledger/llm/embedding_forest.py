"""Near-duplicate embeddings by a forest of random-projection trees.

Every tree splits the vectors of a label again and again: a node projects its vectors on a random direction
of its own and cuts at their median. Vectors within a margin of the cut go to both sides (spill), so close
pairs are seldom parted. Vectors are compared only within leaves, by cosine in double precision, and the
links of all trees are united.

The trees grow level by level as Spark jobs. A node that spilling keeps from shrinking is a dense cluster:
it stays one leaf and is compared in pairs of blocks of bounded size. A leaf gives one row per member, its
number of links and the smallest member connected to it in this leaf, never the pairs. A pair that meets in
several leaves is counted in the first of them. Equal vectors collapse to one with a weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from sunledger.session import ship_package
from sunledger.storage import materialize

from .components import components

COSINE = 0.93
TREES, LEAF = 6, 512
#: Half-width of the spill zone in units of 1 / sqrt(dimension), the spread of a random unit vector's projection.
MARGIN = 0.25
#: A split must leave each side at most this share of the node.
SHRINK = 0.85
SEED = 20240
#: Bits of a leaf's code below the tree's number, and so the most levels of a tree.
NODE_BITS = 56


def valid(label: Column, embedding: Column) -> Column:
    """Vectors that can be linked: with a label, without null or non-finite components, not zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return label.isNotNull() & embedding.isNotNull() & F.coalesce(~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _unit(batch, column: str) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths, scaled to length 1 in double precision."""
    values = batch.column(column)
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _project(rows: DataFrame) -> DataFrame:
    """``rows`` with their projection on the direction of their node."""
    schema = StructType([*rows.schema.fields, StructField("p", DoubleType())])
    names = rows.columns

    def run(batches):
        for batch in batches:
            lists, leaf = batch.column("embedding"), np.array(batch.column("leaf").to_pylist(), np.int64)
            sizes = np.array(batch.column("dim").to_pylist(), np.int64)
            p = np.zeros(len(leaf))
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                x = _unit(pa.table({"e": lists.take(pa.array(own))}), "e")
                for code in np.unique(leaf[own]):
                    r = np.random.default_rng([SEED, int(code)]).standard_normal(dim)
                    here = leaf[own] == code
                    p[own[here]] = x[here] @ (r / np.linalg.norm(r))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*names, "p"])

    return rows.mapInArrow(run, schema)


def grow(vectors: DataFrame, trees: int = TREES, leaf_size: int = LEAF, margin: float = MARGIN) -> DataFrame:
    """``vectors`` (label, dim, node, embedding) -> the same with ``leaf``, one row for each leaf that holds the vector.

    ``leaf`` is the tree's number and the node's (1 for the root, 2n and 2n + 1 for the children of n).
    """
    ship_package(vectors.sparkSession)
    group = ["label", "dim", "leaf"]
    roots = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.shiftleft(t.cast("long"), NODE_BITS) + 1)
    level = vectors.withColumn("leaf", F.explode(roots))
    done: DataFrame | None = None
    while True:
        sizes = materialize(level.groupBy(*group).agg(F.count("*").alias("n")).withColumn("large", F.col("n") > leaf_size), "node-sizes")
        counted = level.join(sizes, group)
        small = counted.where(~F.col("large")).drop("n", "large")
        done = small if done is None else done.unionByName(small)
        if not sizes.where("large").limit(1).count():
            return done
        projected = materialize(_project(counted.where("large").drop("large")), "projections")
        cuts = projected.groupBy(*group).agg(F.percentile_approx("p", 0.5, 1000).alias("cut"))
        zone = margin / F.sqrt("dim")
        left, right = F.col("p") < F.col("cut") + zone, F.col("p") >= F.col("cut") - zone
        cuts = materialize(cuts, "cuts")
        shares = projected.join(cuts, group).groupBy(*group).agg(
            F.first("cut").alias("cut"),
            (F.greatest(F.count(F.when(left, 1)), F.count(F.when(right, 1))) <= SHRINK * F.count("*")).alias("splits"),
        )
        cut = projected.join(materialize(shares, "splits"), group)
        done = done.unionByName(cut.where(~F.col("splits")).select(*vectors.columns, "leaf"))
        number = F.col("leaf").bitwiseAND((1 << NODE_BITS) - 1)
        base = F.col("leaf") - number
        children = F.array_compact(F.array(F.when(left, base + 2 * number), F.when(right, base + 2 * number + 1)))
        level = cut.where("splits").select(*vectors.columns, F.explode(children).alias("leaf"))
        level = materialize(level, "level")


def _connected(linked: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each member the smallest name reachable by ``linked`` (a symmetric boolean matrix)."""
    label = names.copy()
    while True:
        low = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(label, low)
        if np.array_equal(new, label):
            return label
        label = new


def _compare(cosine: float):
    schema = StructType([StructField("node", LongType()), StructField("links", LongType()), StructField("low", LongType())])

    def run(table):
        x = _unit(table, "embedding")
        names = np.array(table.column("node").to_pylist(), np.int64)
        weights = np.array(table.column("weight").to_pylist(), np.int64)
        block = np.array(table.column("block").to_pylist(), np.int64)
        here = table.column("leaf")[0].as_py()
        close = x @ x.T >= cosine
        np.fill_diagonal(close, False)
        if table.column("one")[0].as_py() != table.column("two")[0].as_py():
            close &= block[:, None] != block[None, :]  # pairs within a block belong to another group
        # Pairs that have met in an earlier leaf are counted there.
        leaves = table.column("leaves").to_pylist()
        earlier = {code: k for k, code in enumerate(sorted({c for own in leaves for c in own if c < here}))}
        met = np.zeros((len(names), max(1, len(earlier))), np.float32)
        for i, own in enumerate(leaves):
            for code in own:
                if code < here:
                    met[i, earlier[code]] = 1
        counted = close & ~(met @ met.T > 0)
        return pa.table({"node": names, "links": counted.astype(np.int64) @ weights, "low": _connected(close, names)})

    return run, schema


def links(grown: DataFrame, cosine: float = COSINE, leaf_size: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """Of a stored ``grow`` result with ``weight``: (node, links) summed over all leaves, and edges (a, b)."""
    group = ["label", "dim", "leaf"]
    leaves = grown.groupBy("node").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))  # bounded by trees and spill
    sizes = grown.groupBy(*group).agg(F.count("*").alias("n"), F.min("node").alias("least"), F.max("node").alias("most"))
    sizes = materialize(sizes.where("least <> most").select(*group, F.ceil(F.col("n") / leaf_size).cast("int").alias("blocks")), "leaf-sizes")
    spread = grown.join(sizes, group).join(materialize(leaves, "leaves"), "node")
    spread = spread.withColumn("block", F.pmod(F.xxhash64("node", "leaf"), F.col("blocks")).cast("int"))
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = spread.withColumn("partner", partner).withColumn("one", F.least("block", "partner")).withColumn("two", F.greatest("block", "partner"))
    run, schema = _compare(cosine)
    found = spread.select(*group, "one", "two", "block", "node", "weight", "embedding", "leaves")
    found = materialize(found.groupBy(*group, "one", "two").applyInArrow(run, schema), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    return counts, found.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf_size: int = LEAF) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``embeddings`` (vec_id, embedding, label).

    Vectors that cannot be linked (see ``valid``) have no links and their own id as component_id. Repeated
    rows are vectors like any other. Null vec_ids take part; a component_id is null only where no member
    has an id, and such rows are kept. Vectors of different lengths are never linked.
    """
    rows = embeddings.select("vec_id", "embedding", "label").withColumn("ok", valid(F.col("label"), F.col("embedding")))
    node = F.when(F.col("ok"), F.xxhash64("label", "embedding", F.size("embedding")))
    rows = materialize(rows.withColumn("node", node), "vectors")
    one = (
        rows.where("ok").groupBy("node")
        .agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("weight"), F.min("vec_id").alias("least_id"))
        .withColumn("dim", F.size("embedding"))
    )
    one = materialize(one, "distinct-vectors")
    grown = materialize(grow(one.drop("least_id"), trees, leaf_size), "leaves-of-vectors")
    counts, edges = links(grown, cosine, leaf_size)
    labels = components(materialize(edges, "edges")).select("node", F.col("label").alias("component"))
    classes = one.select("node", "weight", "least_id").join(counts, "node", "left").join(labels, "node", "left")
    classes = materialize(
        classes.select("node", "least_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "classes"
    )
    smallest = classes.groupBy("component").agg(F.min("least_id").alias("smallest"))
    classes = materialize(classes.join(smallest, "component").select("node", "n_links", "smallest"), "classes")
    named = rows.select("vec_id", "ok", "node").join(classes, "node", "left")
    component = F.when(F.col("ok"), F.col("smallest")).otherwise(F.col("vec_id"))
    return named.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
