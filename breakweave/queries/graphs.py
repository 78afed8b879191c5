"""C: iterative and graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Fixtures
from ..operators import graph as g
from ..operators import joins as j
from ..operators.ordered import continuity_groups
from ..operators.seeding import parse_continuity_groups
from . import query

c = F.col

_NODES = "n AS (SELECT event_id, strand_key, pos1, pos2 FROM fx_nodes_long)"
_PAIRS = f"""{_NODES}, p AS (SELECT a.event_id AS a, b.event_id AS b FROM n a JOIN n b ON a.strand_key = b.strand_key AND a.event_id < b.event_id AND sqrt(pow(a.pos1 - b.pos1, 2) + pow(a.pos2 - b.pos2, 2)) <= 20),
 e AS (SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p), reach(id, r) AS (SELECT u, u FROM e UNION SELECT reach.id, e.v FROM reach JOIN e ON e.u = reach.r),
 comp AS (SELECT id AS node, min(r) AS component FROM reach GROUP BY id)"""


def pairs(fx: Fixtures) -> DataFrame:
    return j.near_edges(fx.nodes_long, "event_id", ["strand_key"], "pos1", "pos2", 20.0)


@query("c1", f"WITH RECURSIVE {_PAIRS} SELECT node, component FROM comp")
def c1(fx: Fixtures) -> DataFrame:
    return g.connected_components(pairs(fx))


@query("c2", f"""WITH RECURSIVE {_PAIRS}, k AS (SELECT n.event_id, coalesce(component, n.event_id) AS k FROM n LEFT JOIN comp ON comp.node = n.event_id)
 SELECT event_id, dense_rank() OVER (ORDER BY k) AS cluster_n FROM k""")  # fmt: skip
def c2(fx: Fixtures) -> DataFrame:
    rows = fx.nodes_long.select("event_id")
    return g.finalize_clusters(rows, "event_id", pairs(fx)).select("event_id", "cluster_n")


def seeded_sql(source: str, purge: int = 5, tlen: int = 762) -> str:
    """Common table expressions from grouped molecules to ``amb``: junction types with their SV numbers, seed by seed."""

    def match(s: dict, x: dict) -> str:
        def node(side: str, a: str, b: str) -> str:
            apart = f"(CASE WHEN {s['sp']} THEN {a} - {b} ELSE {b} - {a} END)"
            half = f"{apart} BETWEEN (CASE WHEN {side} = 'L' THEN -{purge} ELSE -{tlen} END) AND (CASE WHEN {side} = 'L' THEN {tlen} ELSE {purge} END)"
            return f"(CASE WHEN {s['sp']} AND {x['sp']} THEN abs({a} - {b}) <= {purge} WHEN NOT {s['sp']} AND NOT {x['sp']} THEN abs({a} - {b}) <= {tlen} ELSE {half} END)"

        total = f"abs({s['a']} - {x['a']}) + abs({s['b']} - {x['b']}) <= {tlen}"
        return f"({s['r']} = {x['r']} OR (({s['sp']} OR NOT {x['sp']}) AND {total} AND {node(s['d1'], s['a'], x['a'])} AND {node(s['d2'], s['b'], x['b'])}))"

    of = lambda v: {k: f"{v}.{k}" for k in ("r", "sp", "d1", "a", "d2", "b")}
    rest = lambda l: f"list_filter({l}, lambda x: NOT {match(of(f'{l}[1]'), of('x'))})"
    return f"""ty AS (SELECT group_id, node_class = 1 AS sp, side1 AS d1, pos1 AS a, side2 AS d2, pos2 AS b, count(*) AS n, max(mapq1 + mapq2) AS q FROM {source} GROUP BY ALL),
 rk AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY sp DESC, n DESC, q DESC, a, b) AS r FROM ty),
 ls AS (SELECT group_id, list({{'r': r, 'sp': sp, 'd1': d1, 'a': a, 'd2': d2, 'b': b}} ORDER BY r) AS l FROM rk GROUP BY group_id),
 op(group_id, k, s, l) AS (SELECT group_id, 1, l[1], {rest('l')} FROM ls UNION ALL SELECT group_id, k + 1, l[1], {rest('l')} FROM op WHERE len(l) > 0),
 mt AS (SELECT o.group_id, o.k, t.r, t.sp, t.d1, t.a, t.d2, t.b FROM op o JOIN rk t ON t.group_id = o.group_id AND {match(of('o.s'), of('t'))}),
 ed AS (SELECT DISTINCT x.group_id, x.k AS u, y.k AS v FROM mt x JOIN mt y ON x.group_id = y.group_id AND x.r = y.r WHERE x.sp),
 rc(group_id, u, v) AS (SELECT group_id, u, v FROM ed UNION SELECT rc.group_id, rc.u, ed.v FROM rc JOIN ed ON ed.group_id = rc.group_id AND ed.u = rc.v),
 tp AS (SELECT op.group_id, op.k, coalesce(max(rc.v), op.k) AS top FROM op LEFT JOIN rc ON rc.group_id = op.group_id AND rc.u = op.k GROUP BY op.group_id, op.k),
 sv AS (SELECT group_id, k, dense_rank() OVER (PARTITION BY group_id ORDER BY top)::INT AS sv_n FROM tp),
 asg AS (SELECT DISTINCT mt.group_id, mt.sp, mt.d1, mt.a, mt.d2, mt.b, sv.sv_n FROM mt JOIN sv USING (group_id, k)),
 amb AS (SELECT *, count(*) OVER (PARTITION BY group_id, sp, d1, a, d2, b) > 1 AS is_ambiguous FROM asg)"""


SAME_TYPE = "g.group_id = amb.group_id AND (g.node_class = 1) = amb.sp AND g.side1 = amb.d1 AND g.pos1 = amb.a AND g.side2 = amb.d2 AND g.pos2 = amb.b"
_KEYS = "chrom1, chrom2, side1, side2"


def grouped_sql(source: str) -> str:
    """Common table expressions to ``groups``: the molecules of a table with their continuity group."""
    return f"""ga AS (SELECT *, sum(g) OVER (PARTITION BY {_KEYS} ORDER BY pos1, mol_id) AS g1 FROM (SELECT *, coalesce((pos1 - lag(pos1) OVER (PARTITION BY {_KEYS} ORDER BY pos1, mol_id) > 762)::INT, 0) AS g FROM {source})),
 gb AS (SELECT *, sum(h) OVER (PARTITION BY {_KEYS}, g1 ORDER BY pos2, mol_id) AS g2 FROM (SELECT *, coalesce((pos2 - lag(pos2) OVER (PARTITION BY {_KEYS}, g1 ORDER BY pos2, mol_id) > 762)::INT, 0) AS h FROM ga)),
 gk AS (SELECT *, row_number() OVER (ORDER BY {_KEYS}, g1, g2) AS group_id FROM (SELECT {_KEYS}, g1, g2, max(mapq1) AS m1, max(mapq2) AS m2 FROM gb GROUP BY ALL)),
 groups AS (SELECT gb.*, gk.group_id, gk.m1, gk.m2 FROM gb JOIN gk USING ({_KEYS}, g1, g2))"""


@query("c3", f"WITH RECURSIVE {grouped_sql('fx_molecules')}, {seeded_sql('groups')} SELECT g.mol_id, g.group_id, amb.sv_n, amb.is_ambiguous FROM groups g JOIN amb ON {SAME_TYPE}")
def c3(fx: Fixtures) -> DataFrame:
    """Junction molecules of continuity groups assigned to SVs by greedy seeding."""
    x = continuity_groups(fx.molecules, ["chrom1", "chrom2", "side1", "side2"], 762, 1)
    x = x.withColumn("is_split", c("node_class") == 1)
    return parse_continuity_groups(x, "group_id").select("mol_id", "group_id", "sv_n", "is_ambiguous")


@query("c4", """WITH RECURSIVE p AS (SELECT a.mol_id AS a, b.mol_id AS b FROM fx_molecules a JOIN fx_molecules b ON a.sample = b.sample AND a.chrom1 = b.chrom1 AND a.mol_id < b.mol_id
 AND sqrt(pow(a.out_pos1 - b.out_pos1, 2) + pow(a.out_pos2 - b.out_pos2, 2)) <= 5), e AS (SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p),
 reach(id, r) AS (SELECT u, u FROM e UNION SELECT reach.id, e.v FROM reach JOIN e ON e.u = reach.r), m AS (SELECT f.*, coalesce(k.component, f.mol_id) AS k FROM fx_molecules f LEFT JOIN (SELECT id, min(r) AS component FROM reach GROUP BY id) k ON k.id = f.mol_id),
 s AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY node_class DESC, strand_count1 + strand_count2 DESC, mapq1 + mapq2 DESC, mol_id) AS n, sum(strand_count1) OVER (PARTITION BY k) AS s1, sum(strand_count2) OVER (PARTITION BY k) AS s2, count(*) OVER (PARTITION BY k) AS n_collapsed FROM m)
 SELECT mol_id, s1::BIGINT AS strand_count1, s2::BIGINT AS strand_count2, n_collapsed FROM s WHERE n = 1""")  # fmt: skip
def c4(fx: Fixtures) -> DataFrame:
    order = [-c("node_class"), -(c("strand_count1") + c("strand_count2")), -(c("mapq1") + c("mapq2"))]
    out = g.purge_duplicates(fx.molecules, "mol_id", ["sample", "chrom1"], 5.0, order, ["strand_count1", "strand_count2"])
    return out.select("mol_id", "strand_count1", "strand_count2", "n_collapsed")


_NP = "SELECT chrom1, pos1, chrom2, pos2, count(*) AS n FROM fx_molecules WHERE chrom1 = chrom2 GROUP BY ALL"


def _step(k: int) -> str:
    last = f"l{k - 1}" if k > 1 else "np"
    near = lambda d: f"l.chrom1 = t.chrom1 AND l.chrom2 = t.chrom2 AND abs(l.pos1 - t.pos1) <= {d} AND abs(l.pos2 - t.pos2) <= {d}"
    return f"""t{k} AS (SELECT * FROM {last} ORDER BY n DESC, chrom1, pos1, chrom2, pos2 LIMIT 1), l{k} AS (SELECT l.* FROM {last} l, t{k} t WHERE NOT ({near(300)})),
 a{k} AS (SELECT {k} AS amplicon_n, t.chrom1, t.pos1, t.chrom2, t.pos2, t.n AS index_n, (SELECT sum(l.n) FROM np l WHERE {near(50)})::BIGINT AS n_molecules FROM t{k} t)"""


@query("c5", f"WITH np AS ({_NP}), {_step(1)}, {_step(2)}, {_step(3)} SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3")
def c5(fx: Fixtures) -> DataFrame:
    np_ = fx.molecules.where("chrom1 = chrom2").groupBy("chrom1", "pos1", "chrom2", "pos2").agg(F.count("*").alias("n"))
    return g.discover_amplicons(np_, 3, 300, 50)


def sequences(fx: Fixtures, length: int) -> DataFrame:
    return fx.sequences.groupBy((c("seq_id") % 16).alias("amplicon"), F.substr("ref_seq", F.lit(1), F.lit(length)).alias("seq")).agg(F.count("*").alias("n"))


def networks_sql(length: int, limit: int, sensitivity: float = 0.0, min_parent: int = 0) -> str:
    """Sequences of each amplicon taken one by one, with the list of parents so far."""
    d = "levenshtein(s.seq, q.seq)"
    return f"""WITH RECURSIVE s AS (SELECT seq_id % 16 AS amplicon, substr(ref_seq, 1, {length}) AS seq, count(*) AS n FROM fx_sequences GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY amplicon ORDER BY n DESC, length(seq) DESC, seq DESC) AS k FROM s),
 w(amplicon, k, ps) AS (SELECT amplicon, 0::BIGINT, []::STRUCT(seq VARCHAR, n BIGINT, k BIGINT)[] FROM r WHERE k = 1 UNION ALL
  SELECT w.amplicon, r.k, CASE WHEN r.n >= {min_parent} AND len(list_filter(w.ps, lambda p: levenshtein(p.seq, r.seq) <= {limit} * (1 - {sensitivity}::DOUBLE * r.n / p.n))) = 0
   THEN list_append(w.ps, {{'seq': r.seq, 'n': r.n, 'k': r.k}}) ELSE w.ps END FROM w JOIN r ON r.amplicon = w.amplicon AND r.k = w.k + 1),
 p AS (SELECT amplicon, unnest(ps, recursive := true) FROM (SELECT amplicon, arg_max(ps, k) AS ps FROM w GROUP BY amplicon)),
 b AS (SELECT s.amplicon, s.seq, q.seq AS parent, {d} AS d, row_number() OVER (PARTITION BY s.amplicon, s.seq ORDER BY {d}, q.n DESC, length(q.seq) DESC, q.seq) AS i
  FROM r s JOIN p q ON s.amplicon = q.amplicon AND q.k <= s.k AND {d} <= {limit})
 SELECT s.amplicon, s.seq, CASE WHEN o.seq IS NULL THEN b.parent ELSE s.seq END AS parent, CASE WHEN o.seq IS NULL THEN b.d ELSE 0 END::INT AS distance
 FROM s LEFT JOIN p o ON o.amplicon = s.amplicon AND o.seq = s.seq LEFT JOIN b ON b.amplicon = s.amplicon AND b.seq = s.seq AND b.i = 1"""


@query("c6", networks_sql(9, 1))
def c6(fx: Fixtures) -> DataFrame:
    """Networks of nine-base sequences around their most frequent members, one edit apart."""
    return g.parent_networks(sequences(fx, 9), "amplicon", 1)


@query("c6_rare", networks_sql(7, 2, 0.6, 2))
def c6_rare(fx: Fixtures) -> DataFrame:
    """Networks whose reach depends on relative counts; sequences seen once join what is near, or nothing."""
    return g.parent_networks(sequences(fx, 7), "amplicon", 2, sensitivity=0.6, min_parent=2)


@query("c7", """WITH n AS (SELECT channel AS amplicon, pos1 // 50 * 50 AS node, count(*) AS n FROM fx_nodes_long GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY amplicon ORDER BY n DESC, node) AS k FROM n),
 t AS (SELECT o.*, row_number() OVER (PARTITION BY o.amplicon ORDER BY o.n DESC, o.node) AS q, f.node AS p, f.n AS np FROM o JOIN o f ON f.amplicon = o.amplicon AND f.k = 1 WHERE abs(o.node - f.node) >= 100)
 SELECT amplicon, least(p, node) AS primer1, greatest(p, node) AS primer2, CASE WHEN p <= node THEN np ELSE n END AS n1, CASE WHEN p <= node THEN n ELSE np END AS n2 FROM t WHERE q = 1""")  # fmt: skip
def c7(fx: Fixtures) -> DataFrame:
    n = fx.nodes_long.groupBy(c("channel").alias("amplicon"), (F.floor(c("pos1") / 50) * 50).alias("node")).agg(F.count("*").alias("n"))
    return g.discover_primers(n)
