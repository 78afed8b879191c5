"""Columns of SV junctions: nodes, orientation, types, structure and breakend records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import find_all, reverse_complement

#: Junction types: translocation, inversion, deletion, duplication, proper.
TRANSLOCATION, INVERSION, DELETION, DUPLICATION, PROPER = "T", "I", "L", "D", "P"
#: Node classes.
GAP, SPLIT, OUTER_CLIP = 0, 1, 2


def pack_node(chrom: Column, side: Column, pos: Column) -> Column:
    return F.concat_ws(":", chrom.cast("string"), side, pos.cast("string"))


def unpack_node(node: Column) -> tuple[Column, Column, Column]:
    parts = F.split(node, ":")
    return parts[0].cast("int"), parts[1], parts[2].cast("long")


def chromosome_offsets(sizes: DataFrame) -> DataFrame:
    """``chrom, size, before``: bases of all chromosomes ahead of each. One row a chromosome."""
    from pyspark.sql import Window

    w = Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("chrom", "size", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("before"))


def with_signed_node(df: DataFrame, sizes: DataFrame, chrom: str, pos: str, strand: str, out: str = "node") -> DataFrame:
    """Position on the concatenated genome, negative on the reverse strand (``strand`` not 0)."""
    offsets = F.broadcast(chromosome_offsets(sizes).select(F.col("chrom").alias("__c"), "before"))
    joined = df.join(offsets, F.col(chrom) == F.col("__c"), "left")
    n = F.col("before") + F.col(pos)
    return joined.withColumn(out, F.when(F.col(strand) == 0, n).otherwise(-n)).drop("__c", "before")


def with_node_position(df: DataFrame, sizes: DataFrame, node: str) -> DataFrame:
    """Inverse of :func:`with_signed_node`: adds ``chrom, pos, strand``.

    The offsets have one row a chromosome, so they are searched as a sorted array in a column.
    """
    offsets = chromosome_offsets(sizes).agg(F.array_sort(F.collect_list(F.struct("before", "size", "chrom"))).alias("o"))
    joined = df.crossJoin(F.broadcast(offsets))
    at = F.abs(F.col(node))
    hit = F.element_at(F.filter("o", lambda x: (at > x["before"]) & (at <= x["before"] + x["size"])), 1)
    return (
        joined.withColumn("__h", hit)
        .withColumns({"chrom": F.col("__h.chrom"), "pos": at - F.col("__h.before"), "strand": (F.col(node) < 0).cast("int")})
        .drop("__h", "o")
    )


def window_index(pos: Column, size: int) -> Column:
    return F.floor((pos - 1) / size)


def window_start(index: Column, size: int) -> Column:
    return index * size + 1


def is_canonical(node1: Column, node2: Column) -> Column:
    """Whether the node of the smaller absolute position is on the forward strand."""
    return F.when(F.abs(node1) <= F.abs(node2), node1 > 0).otherwise(node2 > 0)


def canonical_nodes(node1: Column, node2: Column) -> tuple[Column, Column, Column]:
    """(is canonical, canonical node 1, canonical node 2)."""
    c = is_canonical(node1, node2)
    return c, F.when(c, node1).otherwise(-node2), F.when(c, node2).otherwise(-node1)


def junction_key(*parts: Column) -> Column:
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def junction_type(
    chrom1: Column, side1: Column, pos1: Column, chrom2: Column, side2: Column, pos2: Column, node_class: Column, max_tlen: int, read_len: int
) -> Column:
    """T by chromosomes, I by equal sides, else D, L or P by the distance along the canonical strand.

    A gap is judged by the insert size that it implies, a split by whether the bases are adjacent.
    """
    dist = F.when(side1 == "L", pos2 - pos1).otherwise(pos1 - pos2)
    gap = F.when(dist < -2 * read_len, DUPLICATION).when(dist > 2 * max_tlen - 2 * read_len, DELETION)
    split = F.when(dist <= 0, DUPLICATION).when(dist > 1, DELETION)
    return (
        F.when(chrom1 != chrom2, TRANSLOCATION)
        .when(side1 == side2, INVERSION)
        .otherwise(F.coalesce(F.when(node_class == GAP, gap).otherwise(split), F.lit(PROPER)))
    )


def is_canonical_pair(chrom1: Column, side1: Column, pos1: Column, chrom2: Column, side2: Column, pos2: Column, kind: Column) -> Column:
    """Equal sides: lower position first, or lower chromosome for a translocation; else the LR pair."""
    return F.when(side1 == side2, F.when(kind == INVERSION, pos1 < pos2).otherwise(chrom1 < chrom2)).otherwise(side1 == "L")


def long_read_edge(node1: Column, node2: Column, chrom1: Column, chrom2: Column) -> tuple[Column, Column]:
    """(edge type, size) of two signed nodes: T, V (strands differ), U (backwards) or D; size 0 for T."""
    step = node2 - node1
    kind = (
        F.when(chrom1 != chrom2, "T").when(F.signum(node1) != F.signum(node2), "V").when(step <= 0, "U").when(step > 1, "D").otherwise("?")
    )
    size = F.when(chrom1 != chrom2, 0).when(F.signum(node1) != F.signum(node2), F.abs(node1 + node2)).when(step <= 0, 1 - step).otherwise(step - 1)
    return kind, size.cast("long")


def edge_type_with_insertion(kind: Column, size: Column, insertion: Column) -> Column:
    return F.when((insertion > 0) & kind.isin("D", "I"), F.when(size > 0, "D").otherwise("I")).otherwise(kind)


def junction_structure(seq: Column, len1: Column, clip1: Column, clip2: Column, merge_len: Column) -> dict[str, Column]:
    """Where the two alignments end in the junction sequence, and what lies between.

    ``microhomology`` is the overlap, negative for inserted bases; ``bases`` are the bases of either.
    """
    read1 = len1 - clip1
    read2 = F.when(merge_len == 0, clip2 + 1).otherwise(len1 - merge_len + clip2 + 1)
    mh = read1 - read2 + 1
    bases = F.when(mh > 0, F.substr(seq, read2, mh)).when(mh < 0, F.substr(seq, read1 + 1, -mh)).otherwise(F.lit(""))
    return {"read_pos1": read1, "read_pos2": read2, "microhomology": mh, "bases": bases}


def flank_length(ref_span: Column, microhomology: Column, ref_pos: Column, pos: Column) -> Column:
    return ref_span - F.greatest(F.lit(0), microhomology) + F.abs(ref_pos - pos)


def target_class(name1: Column, name2: Column, adjacent1: Column, adjacent2: Column) -> Column:
    """TT, TA, AA within one region, lower case between regions, and - for an end outside all.

    ``name`` is the region that an end falls in, padded regions included; ``adjacent`` says that it
    is in the padding only.
    """
    one = F.when(name1.isNull(), "-").when(adjacent1, "A").otherwise("T")
    two = F.when(name2.isNull(), "-").when(adjacent2, "A").otherwise("T")
    first = F.when(F.ascii(two) > F.ascii(one), two).otherwise(one)  # T before A before -
    last = F.when(F.ascii(two) > F.ascii(one), one).otherwise(two)
    both = F.concat(first, last)
    return F.when(name1.eqNullSafe(name2) | both.contains("-") & name1.isNull() & name2.isNull(), both).otherwise(F.lower(both))


def breakend_fields(df: DataFrame) -> DataFrame:
    """Two breakend records a call: ``id, chrom, pos, ref, alt, mate_id, svlen, cipos, homlen, homseq``.

    Input: ``sv_id, jxn_type, chrom1, side1, pos1, ref1, chrom2, side2, pos2, ref2, microhomology,
    bases, sv_size``. The breakend that looks left is moved to the leftmost position of a
    microhomology; its mate then keeps the shared bases out of the second side.
    """
    n = F.col("n")
    a, b = (lambda c: F.when(n == 1, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))), (lambda c: F.when(n == 1, F.col(f"{c}2")).otherwise(F.col(f"{c}1")))
    x = df.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    x = x.select(
        "*",
        a("chrom").alias("chrom"), a("side").alias("side"), a("pos").alias("at"), a("ref").alias("ref"),
        b("chrom").alias("mate_chrom"), b("side").alias("mate_side"), b("pos").alias("mate_at"),
    )
    mh = F.col("microhomology")
    pos = F.when((mh > 0) & (F.col("side") == "L"), F.col("at") - mh).otherwise(F.col("at"))
    mate = F.when((mh > 0) & (F.col("side") == "R"), F.col("mate_at") + F.when(F.col("mate_side") == "L", -mh).otherwise(mh)).otherwise(F.col("mate_at"))
    bracket = F.when(F.col("mate_side") == "L", "]").otherwise("[")
    mate_node = F.concat(bracket, F.col("mate_chrom").cast("string"), F.lit(":"), mate.cast("string"), bracket)
    inserted = F.when(mh < 0, F.col("bases")).otherwise(F.lit(""))
    same = F.col("side") == F.col("mate_side")
    # on equal sides the record of the strand that is turned round carries the turned insertion
    turned = same & (((n == 1) & (F.col("side") == "R")) | ((n == 2) & (F.col("side") == "L")))
    ins = F.when(turned, reverse_complement(inserted)).otherwise(inserted)
    after = F.when(same, F.col("side") == "L").otherwise(n == 1)
    alt = F.when(after, F.concat("ref", ins, mate_node)).otherwise(F.concat(mate_node, ins, "ref"))
    return x.select(
        F.concat_ws(":", F.col("sv_id").cast("string"), n.cast("string")).alias("id"),
        "chrom",
        pos.alias("pos"),
        "ref",
        alt.alias("alt"),
        F.concat_ws(":", F.col("sv_id").cast("string"), (3 - n).cast("string")).alias("mate_id"),
        F.when(F.col("jxn_type") == DELETION, -F.col("sv_size")).otherwise(F.col("sv_size")).alias("svlen"),
        F.when(mh > 0, F.concat(F.lit("0,"), mh.cast("string"))).otherwise(F.lit("0,0")).alias("cipos"),
        F.greatest(F.lit(0), mh).alias("homlen"),
        F.when(mh > 0, F.col("bases")).otherwise(F.lit(".")).alias("homseq"),
    )


def rms(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x) / F.size(values))


def breakpoint_flanks(target: Column, at: Column, side: Column, n: int) -> tuple[Column, Column]:
    """(retained, lost) bases beside a breakpoint at 1-based ``at``, turned so that both read away from it.

    A breakpoint of side L keeps what lies to its left.
    """
    left, right = F.substr(target, F.greatest(F.lit(1), at - n + 1), F.least(at, F.lit(n))), F.substr(target, at + 1, F.lit(n))
    left_r = F.substr(target, F.greatest(F.lit(1), at - n), F.least(at - 1, F.lit(n)))
    return (
        F.when(side == "L", left).otherwise(reverse_complement(F.substr(target, at, F.lit(n)))),
        F.when(side == "L", right).otherwise(reverse_complement(left_r)),
    )


def insertion_templates(df: DataFrame, keys: list[str], min_len: int = 5) -> DataFrame:
    """The flank matches of each insertion: ``is_ref2, is_rc, at, distance, kind``; the longest-then-nearest first.

    Input columns besides ``keys``: ``insertion, flank1, flank2`` (flank1 ends and flank2 begins at
    the junction). Both flanks are searched for the insertion and its reverse complement, at every
    position. A match on the strand and flank of a fold is called foldback, of the other flank
    strandSwitch; on the same strand slippage where it touches the junction, crossJxn on the other
    side; an insertion that is its own reverse complement is a palindrome.
    """
    searches = F.array(
        *[F.struct(F.lit(f).alias("flank"), F.lit(rc).alias("is_rc")) for f in (1, 2) for rc in (0, 1)]
    )
    q = F.when(F.col("is_rc") == 1, reverse_complement(F.col("insertion"))).otherwise(F.col("insertion"))
    flank = F.when(F.col("flank") == 1, F.col("flank1")).otherwise(F.col("flank2"))
    x = df.where(F.length("insertion") >= min_len).select("*", F.explode(searches).alias("s")).select("*", "s.flank", "s.is_rc").drop("s")
    x = x.withColumn("q", q).withColumn("text", flank).withColumn("at", F.explode(find_all(F.col("text"), F.col("q"))))
    distance = F.when(F.col("flank") == 1, F.length("text") - (F.col("at") + F.length("q") - 1)).otherwise(F.col("at") - 1)
    kind = (
        F.when(F.col("insertion") == reverse_complement(F.col("insertion")), "palindrome")
        .when((F.col("is_rc") == 1) & (F.col("flank") == 1), "foldback")
        .when(F.col("is_rc") == 1, "strandSwitch")
        .when(distance == 0, "slippage")
        .when(F.col("flank") == 2, "crossJxn")
        .otherwise("other")
    )
    found = x.select(*keys, "flank", "is_rc", "at", distance.alias("distance"), kind.alias("kind"))
    # one key's matches are a few positions of one short flank
    return found.groupBy(*keys).agg(F.count("*").alias("n_matches"), F.min(F.struct("distance", "flank", "is_rc", "at", "kind")).alias("best")).select(
        *keys, "n_matches", "best.flank", "best.is_rc", "best.at", "best.distance", "best.kind"
    )
