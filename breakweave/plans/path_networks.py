"""Edges of long reads to clusters of junctions, and to networks of the segments that share them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import collapse_segments, segment_cluster_summary
from ..operators.graph import connected_components, finalize_clusters
from ..operators.joins import place_pairs, shared_member_pairs
from ..operators.ordered import split_to_segments
from .scratch import materialize


def junction_clusters(junctions: DataFrame, id_col: str, keys: list[str], most: float) -> DataFrame:
    """``junctions`` with ``cluster_n``: chained by pairs of equal keys whose two ends lie within ``most``, all places
    of equal ends taken as one."""
    place = [*keys, "pos1", "pos2"]
    places = materialize(junctions.groupBy(*place).agg(F.min(id_col).alias("__place")), "junction-places")
    pairs = place_pairs(places, "__place", keys, "pos1", "pos2", most).select(F.col("id1").alias("a"), F.col("id2").alias("b"))
    clusters = finalize_clusters(places, "__place", pairs).select(*place, "cluster_n")
    return junctions.join(clusters, place)


def path_networks(edges: DataFrame, read: str, order: str, keys: list[str], most: float) -> DataFrame:
    """``network, n_segments, reads, path_types, junction_clusters``: segments of reads joined where they share a junction cluster.

    edges: ``read, order, edge_type`` (A for alignments), ``keys, pos1, pos2, fusable``. Reads are split at
    junctions that are not fusable; the clusters of the others name a segment's junctions. Segments
    without any junction are left out. A network is numbered by its first segment (read:segment).
    """
    edges = materialize(split_to_segments(edges, read, order, "fusable"), "path-edges")
    kept = edges.where("segment_n is not null")
    clustered = materialize(junction_clusters(kept.where("edge_type <> 'A'"), order, keys, most), "path-junctions")
    name = F.concat_ws(":", F.col(read).cast("string"), F.col("segment_n").cast("string"))
    members = materialize(clustered.select(name.alias("segment"), "cluster_n").distinct(), "path-members")
    labels = connected_components(shared_member_pairs(members, "segment", "cluster_n").select(F.col("id1").alias("a"), F.col("id2").alias("b")))
    of_segment = members.groupBy("segment").agg(F.collect_set(F.concat(F.lit("J"), F.col("cluster_n").cast("string"))).alias("junction_clusters"))
    of_segment = of_segment.join(labels.withColumnRenamed("node", "segment"), "segment", "left").withColumn("network", F.coalesce("component", "segment"))
    paths = collapse_segments(kept.withColumns({"node1": F.col("pos1"), "node2": -F.col("pos2")}), [read, "segment_n"], order)
    paths = paths.withColumns({"segment": name, "read": F.col(read).cast("string")}).select("segment", "read", "edge_types")
    return segment_cluster_summary(paths.join(of_segment.drop("component"), "segment"), "network")
