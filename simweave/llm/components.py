"""Consolidating pairwise matches into groups: connected components by low-diameter decomposition.

Each level grows clusters from every vertex at once, with exponentially distributed head
starts: a vertex joins the cluster whose shifted wave reaches it first. The clusters become
the vertices of the next level, which keeps only the edges between different clusters, and so
on until no edge is left. The per-level assignments are then composed from the top down.

The head starts are hashes of vertex and level, so a recomputed task draws the same ones. They
have mean ``MEAN`` and are cut at ``rounds``, hence ``rounds`` hops finish a level. A level
leaves about a fifth of the edges of a sparse graph and fewer of a denser one, so the number of
levels is logarithmic in the number of edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simweave.operators.skew import Pieces
from simweave.storage import drop_written, written

#: Hops a level; also the greatest head start.
ROUNDS = 8
#: The mean head start.
MEAN = 4.0
#: Far beyond any logarithm of a possible number of vertices.
MAX_LEVELS = 60


def _head_start(vertex: str, level: int, rounds: int):
    """Exponential, cut at ``rounds``."""
    uniform = (F.pmod(F.xxhash64(F.col(vertex), F.lit(level)), F.lit(1 << 52)).cast("double") + 1) / F.lit(float(1 << 52))
    return F.least(-F.log(uniform) * F.lit(MEAN), F.lit(float(rounds)))


def _grow(edges: DataFrame, hubs: Pieces, level: int, rounds: int) -> DataFrame:
    """``v, center``: every vertex of the symmetric ``edges`` and its cluster."""
    vertices = edges.select(F.col("src").alias("v")).distinct()
    start = F.struct((-_head_start("v", level, rounds)).alias("at"), F.col("v").alias("center"))
    state = vertices.select("v", start.alias("wave"))
    # a loop of length 0 keeps a vertex's own wave, so that each hop reads the last one once;
    # the exchange of the hops by source is the same in all rounds and is made once
    hops = edges.select(F.col("src").alias("v"), "dst", F.lit(1.0).alias("length")).unionByName(vertices.select("v", F.col("v").alias("dst"), F.lit(0.0).alias("length")))
    hops = hubs.scatter(hops, ("v",))
    on = [c for c in ("v", "_piece") if c in hops.columns]
    for _ in range(rounds):
        wave = F.struct((F.col("wave.at") + F.col("length")).alias("at"), F.col("wave.center").alias("center"))
        reached = hops.join(hubs.repeat(state, ("v",)), on).select(F.col("dst").alias("v"), wave.alias("wave"))
        # the minimum is taken before the shuffle too, so a vertex with many neighbours gets few rows
        state = reached.groupBy("v").agg(F.min("wave").alias("wave"))
    return state.select("v", F.col("wave.center").alias("center"))


def connected_components(edges: DataFrame, left: str, right: str, rounds: int = ROUNDS) -> DataFrame:
    """``vertex, component``: one row for each vertex that has an edge to another vertex.

    ``component`` is the smallest vertex (as a string, by code point) connected to it. Edges are
    undirected; repeated edges, edges in both directions and loops change nothing; edges with a
    null end are no edges, and no edges give an empty table. Other columns are not read.

    Every level writes its clusters and remaining edges to the shared folder, which cuts the
    lineage; only counts come to the driver. A cluster is named after its smallest vertex when it
    becomes a vertex of the next level, so the last name is the component's. Vertices with very
    many edges and clusters of very many vertices are cut into pieces for every join.
    """
    pairs = edges.select(F.col(left).cast("string").alias("a"), F.col(right).cast("string").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    links = written(pairs.distinct().select(both.alias("e")).select("e.src", "e.dst").distinct(), "cc-edges")
    levels: list[tuple[DataFrame, Pieces]] = []
    while not links.isEmpty():
        if len(levels) >= MAX_LEVELS:
            raise RuntimeError(f"no end after {MAX_LEVELS} levels")
        hubs = Pieces.of(links.groupBy("src").agg(F.count(F.lit(1)).alias("n")))
        grown = written(_grow(links, hubs, len(levels), rounds), "cc-grown")
        sizes = written(grown.groupBy("center").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("name")), "cc-sizes")
        large = Pieces.of(sizes.select("center", "n"))
        clusters = written(large.join(grown, sizes.select("center", "name"), ["center"]).select("v", "name"), "cc-clusters")
        # the edges are as heavy by one end as by the other
        near = hubs.join(links, clusters.select(F.col("v").alias("src"), F.col("name").alias("new_src")), ["src"]).select("new_src", F.col("dst").alias("src"))
        far = hubs.join(near, clusters.select(F.col("v").alias("src"), F.col("name").alias("new_dst")), ["src"]).where("new_src <> new_dst")
        before, links = links, written(far.select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst")).distinct(), "cc-edges")
        named = Pieces(("name",), None if large.heavy is None else large.heavy.join(sizes, "center").select("name", "_pieces"))
        levels.append((clusters, named))
        drop_written(before, grown)
    drop_written(links)
    if not levels:
        return pairs.select(F.col("a").alias("vertex"), F.col("a").alias("component")).limit(0)
    top = levels[-1][0].select("v", F.col("name").alias("root"))
    for clusters, named in reversed(levels[:-1]):
        above = top.select(F.col("v").alias("name"), F.col("root").alias("over"))
        top = named.join(clusters, above, ["name"], "left").select("v", F.coalesce("over", "name").alias("root"))
    return top.select(F.col("v").alias("vertex"), F.col("root").alias("component"))
