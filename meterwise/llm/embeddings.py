"""Near-duplicate embeddings by int8 tile products with exact error bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.llm.common import staged
from meterwise.llm.components import Forest, components

#: Vectors of a block; a task compares two blocks.
BLOCK = 8192
#: Vectors of a tile, inside a task.
TILE = 1024


class Quantised:
    """Unit vectors u = scale * code + rest: int8 codes, and for each vector a bound of the length of its rest.

    For two of them, u.v is at most scale_u * scale_v * (code_u . code_v) + e_u + e_v + e_u * e_v, where e is the length of the
    rest: the part that is left out is rest_u . v + (u - rest_u) . rest_v, u and v have length 1, and u - rest_u is at most
    1 + e_u long. The products of codes are exact: their sums stay below 2^24 up to about a thousand components, so 32-bit
    floating-point matrix products give whole numbers; beyond that 64-bit ones are used.
    """

    def __init__(self, vectors: np.ndarray) -> None:
        vectors = vectors / np.abs(vectors).max(1, keepdims=True)
        self.unit = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))
        self.scale = np.abs(self.unit).max(1) / 127
        self.code = np.rint(self.unit / self.scale[:, None]).astype(np.int8)
        rest = self.unit - self.scale[:, None] * self.code
        self.error = np.sqrt((rest * rest).sum(1)) + 1e-12
        self.wide = np.float32 if vectors.shape[1] * 127 * 127 < 1 << 24 else np.float64

    def tile(self, own: slice):
        return self.code[own].astype(self.wide), self.scale[own], self.error[own]


def links_between(one: Quantised, other: Quantised, threshold: float, same: bool):
    """Arrays of places (in one, in other) of the pairs with a cosine of at least the threshold, tile by tile. With ``same``
    both are the same block, and each pair comes once."""
    n, m = len(one.unit), len(other.unit)
    for i in range(0, n, TILE):
        a = slice(i, min(i + TILE, n))
        code_a, scale_a, error_a = one.tile(a)
        for j in range(i if same else 0, m, TILE):
            b = slice(j, min(j + TILE, m))
            code_b, scale_b, error_b = other.tile(b)
            product = code_a @ code_b.T
            product *= scale_a[:, None].astype(one.wide)
            product *= scale_b.astype(one.wide)
            most = error_a.max() + error_b.max() + error_a.max() * error_b.max()
            x, y = np.nonzero(product >= threshold - most - 1e-6)
            if same and i == j:
                x, y = x[x < y], y[x < y]
            bound = product[x, y] + error_a[x] + error_b[y] + error_a[x] * error_b[y] + 1e-6
            x, y = x[bound >= threshold], y[bound >= threshold]
            for begin in range(0, len(x), 1 << 16):
                p, q = x[begin : begin + (1 << 16)] + i, y[begin : begin + (1 << 16)] + j
                good = np.einsum("ij,ij->i", one.unit[p], other.unit[q]) >= threshold
                if good.any():
                    yield p[good], q[good]


def near_duplicates(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, block: int = BLOCK) -> DataFrame:
    """``id``, ``n_links`` (other rows with a cosine of at least the threshold), ``component_id`` (smallest id reachable by
    links) and ``kept`` (id = component_id), one row per row.

    Cosines are of double precision. A vector that is null, empty, zero or has null or non-finite components links with
    nothing, one with another number of components neither, and a row without an id takes no part: its component is null
    and it is not kept. Equal vectors link; they are compared once, for all of them.

    Distinct vectors are dealt evenly to blocks by a hash of their id and each pair of blocks is one task, whatever the data
    look like. A task gives a row per vector with its number of links, and a spanning forest of the links it found, never
    the pairs: near copies in any number make no more rows than vectors. The work grows with the square of the distinct
    vectors; the bound of the quantised products decides which of them is computed in full.
    """
    rows = vectors.select(F.col(id).alias("__id"), F.col(vector).cast("array<double>").alias("__v"))
    limit = float(np.finfo(np.float64).max)
    finite = F.forall("__v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= limit)) & F.exists("__v", lambda x: x != 0)
    usable = F.coalesce(finite, F.lit(False)) & F.col("__id").isNotNull()
    valid = rows.where(usable)
    distinct = staged(valid.groupBy("__v").agg(F.min("__id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors")
    blocks = max(1, -(-distinct.count() // block))
    own = F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")
    kind = distinct.schema["rep"].dataType.simpleString()

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        i, j = frame["i"].iloc[0], frame["j"].iloc[0]
        frame = frame.sort_values("rep", ignore_index=True)
        first = np.flatnonzero(frame["own"].to_numpy() == i)
        second = first if i == j else np.flatnonzero(frame["own"].to_numpy() == j)
        matrix = np.vstack(frame["__v"].to_numpy())
        one = Quantised(matrix[first])
        other = one if i == j else Quantised(matrix[second])
        copies = frame["copies"].to_numpy().astype(float)
        links, forest = np.zeros(len(frame)), Forest(len(frame))
        for p, q in links_between(one, other, threshold, i == j):
            a, b = first[p], second[q]
            links += np.bincount(a, copies[b], len(frame)) + np.bincount(b, copies[a], len(frame))
            forest.link(a, b)
        met = links > 0
        ids = frame["rep"].to_numpy()
        return pd.DataFrame({"rep": ids[met], "links": links[met].astype(np.int64), "root": ids[forest.label[met]]})

    pairs = distinct.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = pairs.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "__dim": F.size("__v")})
    compared = pairs.drop("other").groupBy("__dim", "i", "j").applyInPandas(compare, f"rep {kind}, links long, root {kind}")
    found = staged(compared, "vector-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    members = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    classes = (
        distinct.join(counts, "rep", "left")
        .join(members.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select(
            F.col("__v").alias("__class"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    linked = valid.join(classes, F.col("__v") == F.col("__class")).select("__id", "n_links", "component_id")
    alone = rows.where(~usable).select("__id", F.lit(0).cast("long").alias("n_links"), F.col("__id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("__id").alias(id), "n_links", "component_id", F.coalesce(F.col("__id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
