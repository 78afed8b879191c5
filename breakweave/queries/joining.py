"""J: joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Fixtures
from ..operators import joins as j
from . import query
from .expressions import COMPARED_SQL, calls, compared, haplotype_map, HAPLOTYPES_SQL

c = F.col


@query("j1", """SELECT m.mol_id, coalesce(s.n, 0) AS shared_proper FROM fx_molecules m LEFT JOIN
 (SELECT event_id AS mol_id, user_id AS n FROM events WHERE event_id % 3 = 0) s USING (mol_id)""")  # fmt: skip
def j1(fx: Fixtures) -> DataFrame:
    counts = fx.table("events").where("event_id % 3 = 0").select(c("event_id").alias("mol_id"), c("user_id").cast("long").alias("shared_proper"))
    return j.fill_shared_proper(fx.molecules.select("mol_id"), counts)


_REF = """refs AS (SELECT chrom1 || ':' || side1 || ':' || pos1 AS node, 1 AS node_n, min(mol_id) AS sv_id, min(chrom2 || ':' || side2 || ':' || pos2) AS other FROM fx_molecules WHERE mol_id % 2 = 0 GROUP BY 1),
 clips AS (SELECT mol_id, sample, chrom1 || ':' || side1 || ':' || pos1 AS node, clip_len1 AS n FROM fx_molecules WHERE mol_id % 2 = 1 AND clip_len1 >= 5)"""


@query("j2", f"""WITH {_REF} SELECT sv_id, mol_id, sample, node AS node1, other AS node2, n AS clip_len1, 0 AS clip_len2 FROM clips JOIN refs USING (node)""")
def j2(fx: Fixtures) -> DataFrame:
    m = fx.molecules.withColumn("node", F.concat_ws(":", c("chrom1").cast("string"), "side1", c("pos1").cast("string"))).withColumn(
        "other_node", F.concat_ws(":", c("chrom2").cast("string"), "side2", c("pos2").cast("string"))
    )
    refs = m.where("mol_id % 2 = 0").groupBy("node").agg(F.lit(1).alias("node_n"), F.min("mol_id").alias("sv_id"), F.min("other_node").alias("other_node"))
    clips = m.where("mol_id % 2 = 1 and clip_len1 >= 5").select("node", "mol_id", "sample", c("clip_len1").alias("clip_len"))
    return j.outer_clip_evidence(clips, refs)


@query("j3", """SELECT b.chrom, b.bin_n, b.start0, s.mol_id FROM fx_genome_bins b LEFT JOIN fx_spans s ON s.chrom = b.chrom AND s.start0 < b.end1 AND s.end1 > b.start0""")
def j3(fx: Fixtures) -> DataFrame:
    bins, spans = fx.genome_bins.select("chrom", "bin_n", "start0", "end1"), fx.spans.select("mol_id", "chrom", "start0", "end1")
    return j.interval_join(bins, spans, how="left").select("chrom", "bin_n", "start0", "mol_id")


@query("j4", "SELECT mol_id FROM fx_spans s WHERE NOT EXISTS (SELECT 1 FROM fx_targets t WHERE t.chrom = s.chrom AND t.start0 < s.end1 AND t.end1 > s.start0)")
def j4(fx: Fixtures) -> DataFrame:
    return j.interval_join(fx.spans, fx.targets, how="left_anti").select("mol_id")


@query("j5", """SELECT chrom, bin_n, EXISTS (SELECT 1 FROM fx_targets t WHERE t.chrom = b.chrom AND t.start0 < b.end1 AND t.end1 > b.start0) AS bad FROM fx_genome_bins b""")
def j5(fx: Fixtures) -> DataFrame:
    return j.interval_flag(fx.genome_bins, fx.targets, "bad").select("chrom", "bin_n", "bad")


@query("j6", """SELECT m.mol_id, t.name, m.pos1 - t.start0 AS target_index FROM fx_molecules m LEFT JOIN fx_targets t ON t.chrom = m.chrom1 AND m.pos1 > t.start0 AND m.pos1 <= t.end1""")
def j6(fx: Fixtures) -> DataFrame:
    return j.position_in_target(fx.molecules, fx.targets, "chrom1", "pos1").select("mol_id", "name", c("index").alias("target_index"))


@query("j7", """WITH p AS (SELECT mol_id, chrom1 AS chrom, o AS offset_, CASE WHEN side1 = 'L' THEN pos1 + o ELSE pos1 - o END AS p FROM fx_molecules, range(-5, 6) t(o))
 SELECT mol_id, offset_, (EXISTS (SELECT 1 FROM fx_targets t WHERE t.chrom = p.chrom AND p.p > t.start0 AND p.p <= t.end1))::INT AS hit FROM p""")  # fmt: skip
def j7(fx: Fixtures) -> DataFrame:
    m = fx.molecules.select("mol_id", "chrom1", "side1", "pos1", F.explode(F.sequence(F.lit(-5), F.lit(5))).alias("offset_"))
    p = m.withColumn("p", F.when(c("side1") == "L", c("pos1") + c("offset_")).otherwise(c("pos1") - c("offset_")))
    return j.position_in_target(p, fx.targets, "chrom1", "p").select("mol_id", "offset_", c("name").isNotNull().cast("int").alias("hit"))


@query("j8", """WITH n AS (SELECT event_id, strand_key, pos1 + 0.5 * insert_size AS x, pos2 - 0.5 * insert_size AS y FROM fx_nodes_long)
 SELECT a.strand_key, a.event_id AS id1, b.event_id AS id2, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))::DOUBLE, 6) AS distance FROM n a JOIN n b
 ON a.strand_key = b.strand_key AND a.event_id < b.event_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 20""")  # fmt: skip
def j8(fx: Fixtures) -> DataFrame:
    n = fx.nodes_long.withColumns({"x": c("pos1") + F.lit(0.5) * c("insert_size"), "y": c("pos2") - F.lit(0.5) * c("insert_size")})
    return j.distance_join(n, "event_id", ["strand_key"], "x", "y", 20.0, digits=6)


@query("j9", """SELECT a.channel, a.strand_key, a.event_id AS id1, b.event_id AS id2, round(sqrt(pow(a.pos1 - b.pos1, 2) + pow(a.pos2 - b.pos2, 2)), 6) AS distance FROM fx_nodes_long a JOIN fx_nodes_long b
 ON a.channel = b.channel AND a.strand_key = b.strand_key AND a.event_id < b.event_id AND sqrt(pow(a.pos1 - b.pos1, 2) + pow(a.pos2 - b.pos2, 2)) <= 50""")  # fmt: skip
def j9(fx: Fixtures) -> DataFrame:
    return j.distance_join(fx.nodes_long, "event_id", ["channel", "strand_key"], "pos1", "pos2", 50.0, digits=6)


@query("j10", """SELECT a.sample, a.chrom1, a.mol_id AS id1, b.mol_id AS id2, round(sqrt(pow(a.out_pos1 - b.out_pos1, 2) + pow(a.out_pos2 - b.out_pos2, 2)), 6) AS distance FROM fx_molecules a JOIN fx_molecules b
 ON a.sample = b.sample AND a.chrom1 = b.chrom1 AND a.mol_id < b.mol_id AND sqrt(pow(a.out_pos1 - b.out_pos1, 2) + pow(a.out_pos2 - b.out_pos2, 2)) <= 5""")  # fmt: skip
def j10(fx: Fixtures) -> DataFrame:
    return j.distance_join(fx.molecules, "mol_id", ["sample", "chrom1"], "out_pos1", "out_pos2", 5.0, digits=6)


_SEEDS = "SELECT mol_id AS id, node_class = 1 AS is_split, chrom1, chrom2, side1, side2, pos1, pos2 FROM fx_molecules"


@query("j11", f"""WITH m AS ({_SEEDS}), p AS (SELECT s.id AS seed_id, o.id AS id, s.is_split AS ss, o.is_split AS os, s.side1 AS d1, s.side2 AS d2, s.pos1 AS a1, o.pos1 AS b1, s.pos2 AS a2, o.pos2 AS b2
 FROM m s JOIN m o USING (chrom1, chrom2, side1, side2)),
 q AS (SELECT *, CASE WHEN ss THEN a1 - b1 ELSE b1 - a1 END AS e1, CASE WHEN ss THEN a2 - b2 ELSE b2 - a2 END AS e2 FROM p)
 SELECT seed_id, id FROM q WHERE (ss OR NOT os) AND abs(a1 - b1) + abs(a2 - b2) <= 762
 AND CASE WHEN ss AND os THEN abs(a1 - b1) <= 5 WHEN NOT ss AND NOT os THEN abs(a1 - b1) <= 762 WHEN d1 = 'L' THEN e1 BETWEEN -5 AND 762 ELSE e1 BETWEEN -762 AND 5 END
 AND CASE WHEN ss AND os THEN abs(a2 - b2) <= 5 WHEN NOT ss AND NOT os THEN abs(a2 - b2) <= 762 WHEN d2 = 'L' THEN e2 BETWEEN -5 AND 762 ELSE e2 BETWEEN -762 AND 5 END""")  # fmt: skip
def j11(fx: Fixtures) -> DataFrame:
    m = fx.sql(_SEEDS)
    keys = m.withColumn("k", F.concat_ws(":", "chrom1", "chrom2", "side1", "side2"))
    return j.seed_match(keys, keys, ["k"], 5, 762)


@query("j12", """WITH m AS (SELECT DISTINCT user_id AS seg, event_id % 300 AS k FROM events), f AS (SELECT k, min(seg) AS id1 FROM m GROUP BY k)
 SELECT DISTINCT id1, seg AS id2 FROM m JOIN f USING (k) WHERE id1 < seg""")  # fmt: skip
def j12(fx: Fixtures) -> DataFrame:
    return j.shared_member_pairs(fx.table("events").select(c("user_id").alias("seg"), (c("event_id") % 300).alias("k")).distinct(), "seg", "k")


_CELL_COLUMNS = ", ".join(f"sum(n) FILTER (WHERE cell_id = {k})::BIGINT AS cell_{k}" for k in range(20))


@query("j13", f"""WITH s AS (SELECT chrom, bin_n, {_CELL_COLUMNS} FROM fx_bin_counts GROUP BY ALL)
 SELECT g.chrom, g.bin_n, g.gc_fraction, {", ".join(f"s.cell_{k}" for k in range(20))} FROM fx_genome_bins g LEFT JOIN s USING (chrom, bin_n)""")  # fmt: skip
def j13(fx: Fixtures) -> DataFrame:
    cells = list(range(20))
    wide = fx.bin_counts.groupBy("chrom", "bin_n").pivot("cell_id", cells).sum("n").withColumnsRenamed({str(k): f"cell_{k}" for k in cells})
    return fx.genome_bins.join(wide, ["chrom", "bin_n"], "left").select("chrom", "bin_n", "gc_fraction", *(f"cell_{k}" for k in cells))


@query("j14", """SELECT m.mol_id, b.gc_fraction FROM fx_molecules m ASOF LEFT JOIN fx_genome_bins b ON m.chrom1 = b.chrom AND m.pos1 <= b.start0""")
def j14(fx: Fixtures) -> DataFrame:
    m = fx.molecules.select("mol_id", c("chrom1").alias("chrom"), "pos1")
    return j.asof_forward(m, fx.genome_bins, ["chrom"], "pos1", "start0", "gc_fraction").select("mol_id", "gc_fraction")


@query("j15", """WITH l AS (SELECT o_custkey AS sv_id, string_agg(DISTINCT 'S' || o_orderkey % 4, ',') AS samples FROM orders GROUP BY 1), s AS (SELECT 'S' || i AS sample, i * 10 AS depth FROM range(0, 3) t(i))
 SELECT l.sv_id, s.sample, s.depth FROM l JOIN s ON ',' || l.samples || ',' LIKE '%,' || s.sample || ',%'""")  # fmt: skip
def j15(fx: Fixtures) -> DataFrame:
    calls_ = fx.table("orders").groupBy(c("o_custkey").alias("sv_id")).agg(F.array_join(F.collect_set(F.concat(F.lit("S"), (c("o_orderkey") % 4).cast("string"))), ",").alias("samples"))
    samples = fx.spark.range(3).select(F.concat(F.lit("S"), c("id").cast("string")).alias("sample"), (c("id") * 10).alias("depth"))
    return j.list_members(calls_, "samples", "sample").join(samples, "sample").select("sv_id", "sample", "depth")


@query("j16", """WITH n AS (SELECT sample, (mol_id % 9 - 4) AS mh, count(*) AS n FROM fx_molecules GROUP BY ALL), s AS (SELECT DISTINCT sample FROM fx_molecules)
 SELECT s.sample, g.mh, coalesce(n.n, 0) AS n FROM s CROSS JOIN (SELECT unnest(range(-6, 7)) AS mh) g LEFT JOIN n ON n.sample = s.sample AND n.mh = g.mh""")  # fmt: skip
def j16(fx: Fixtures) -> DataFrame:
    n = fx.molecules.groupBy("sample", (c("mol_id") % 9 - 4).alias("mh")).agg(F.count("*").alias("n"))
    return j.complete_grid(n, {"sample": fx.molecules.select("sample"), "mh": fx.spark.range(-6, 7).select(c("id").alias("mh"))}, ["n"])


@query("j17", """WITH a AS (SELECT DISTINCT user_id AS id, user_id % 5 AS k, user_id % 2 AS s, (user_id * 7) % 900 AS f, (user_id * 7) % 900 + 40 AS l FROM events),
 b AS (SELECT k, s, i * 30 AS f, i * 30 + 10 AS l FROM range(0, 40) t(i), range(0, 5) u(k), range(0, 2) v(s))
 SELECT a.id, round(coalesce(sum(least(a.l, b.l) - greatest(a.f, b.f) + 1), 0) / 41, 6) AS overlap FROM a LEFT JOIN b ON a.k = b.k AND a.s = b.s AND a.f <= b.l AND b.f <= a.l GROUP BY a.id""")  # fmt: skip
def j17(fx: Fixtures) -> DataFrame:
    a = fx.table("events").select("user_id").distinct().selectExpr("user_id as id", "user_id % 5 as k", "user_id % 2 as s", "(user_id * 7) % 900 as first", "(user_id * 7) % 900 + 40 as last")
    b = fx.spark.range(400).selectExpr("id % 5 as k", "id div 5 % 2 as s", "id div 10 * 30 as first", "id div 10 * 30 + 10 as last")
    return j.overlap_fraction(a, b, ["k", "s"]).select("id", F.round("overlap", 6).alias("overlap"))


@query("j18", """SELECT coalesce(a.p, b.p, d.p) AS p, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(z, 0) AS z FROM (SELECT pos1 % 50 AS p, count(*) AS x FROM fx_molecules GROUP BY 1) a
 FULL JOIN (SELECT pos2 % 60 AS p, count(*) AS y FROM fx_molecules GROUP BY 1) b ON a.p = b.p FULL JOIN (SELECT out_pos2 % 70 AS p, count(*) AS z FROM fx_molecules GROUP BY 1) d ON coalesce(a.p, b.p) = d.p""")  # fmt: skip
def j18(fx: Fixtures) -> DataFrame:
    one = lambda m, pos, out: fx.molecules.groupBy((c(pos) % m).alias("p")).agg(F.count("*").alias(out))
    return j.full_outer_reduce([one(50, "pos1", "x"), one(60, "pos2", "y"), one(70, "out_pos2", "z")], ["p"])


@query("j19", f"""{COMPARED_SQL}, g AS (SELECT pos // 10 AS sv_id, max(cmp) AS worst FROM compared GROUP BY 1)
 SELECT m.mol_id AS sv_id, g.worst, g.worst >= 3 AS is_reference FROM fx_molecules m JOIN g ON g.sv_id = m.mol_id""")  # fmt: skip
def j19(fx: Fixtures) -> DataFrame:
    g = compared(fx).groupBy(F.floor(c("pos") / 10).alias("sv_id")).agg(F.max("cmp").alias("worst"))
    return fx.molecules.select(c("mol_id").alias("sv_id")).join(g, "sv_id").withColumn("is_reference", c("worst") >= 3)


@query("j20", f"""WITH {HAPLOTYPES_SQL}, p AS (SELECT mol_id, chrom1 AS chrom, pos1 + o AS pos FROM fx_molecules, range(-2, 3) t(o))
 SELECT p.mol_id, p.chrom, p.pos, h.hap1, h.hap2 FROM p LEFT JOIN hap h USING (chrom, pos)""")  # fmt: skip
def j20(fx: Fixtures) -> DataFrame:
    p = fx.molecules.select("mol_id", c("chrom1").alias("chrom"), F.explode(F.sequence(c("pos1") - 2, c("pos1") + 2)).alias("pos"))
    return p.join(haplotype_map(fx), ["chrom", "pos"], "left").select("mol_id", "chrom", "pos", "hap1", "hap2")


@query("j21", "SELECT m.mol_id AS sv_id, round(g.gc_fraction * 4, 6) AS cn1 FROM fx_molecules m LEFT JOIN fx_genome_bins g ON g.chrom = m.chrom1 AND g.bin_n = (m.pos1 - 1) // 500")
def j21(fx: Fixtures) -> DataFrame:
    cn = fx.genome_bins.select("chrom", "bin_n", F.round(c("gc_fraction") * 4, 6).alias("cn1"))
    x = calls(fx).select("sv_id", c("chrom1").alias("chrom"), F.floor((c("pos1") - 1) / 500).alias("bin_n"))
    return x.join(cn, ["chrom", "bin_n"], "left").select("sv_id", "cn1")


@query("j22", """WITH k AS (SELECT event_id AS read, unnest([event_id // 2, event_id // 3]) AS parent FROM events), r AS (SELECT event_id AS parent, 'r' || event_id AS read_id FROM events)
 SELECT k.read, coalesce(string_agg(r.read_id, ';' ORDER BY r.read_id), '') AS parent_ids FROM k LEFT JOIN r USING (parent) GROUP BY k.read""")  # fmt: skip
def j22(fx: Fixtures) -> DataFrame:
    e = fx.table("events")
    kids = e.selectExpr("event_id as read", "concat(cast(event_id div 2 as string), ';', cast(event_id div 3 as string)) as parents")
    reads = e.selectExpr("cast(event_id as string) as read", "concat('r', cast(event_id as string)) as read_id")
    return j.duplex_parents(kids, reads)


@query("j23", """SELECT a.chrom1, a.side1, a.mol_id AS id1, b.mol_id AS id2 FROM fx_molecules a JOIN fx_molecules b ON a.chrom1 = b.chrom1 AND a.side1 = b.side1 AND a.mol_id < b.mol_id AND abs(a.pos1 - b.pos1) <= 3""")
def j23(fx: Fixtures) -> DataFrame:
    return j.neighbours_within(fx.molecules, "mol_id", ["chrom1", "side1"], "pos1", 3)


@query("j24", "SELECT event_id FROM fx_nodes_long WHERE channel IN (SELECT channel FROM fx_nodes_long WHERE duplex = 1 AND insert_size = 4)")
def j24(fx: Fixtures) -> DataFrame:
    return j.cluster_members(fx.nodes_long, "channel", (c("duplex") == 1) & (c("insert_size") == 4)).select("event_id")
