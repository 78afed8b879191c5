"""The flagship: junction molecules to calls with counts by sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Fixtures
from ..plans.call_svs import call_breakends, call_svs, node_name
from . import query
from .expressions import _DIST, _TYPE, BREAKENDS_SQL
from .graphs import SAME_TYPE, grouped_sql, seeded_sql

_SAMPLES = ["S0", "S1", "S2", "S3"]
_COUNTS = ", ".join(f"count(*) FILTER (WHERE sample = '{x}') AS n_{x}" for x in _SAMPLES)


_CALLS = f"""t AS (SELECT *, {_TYPE} AS jxn_type FROM {_DIST}), f AS (SELECT * FROM t WHERE jxn_type <> 'P' AND (jxn_type = 'T' OR abs(pos2 - pos1) >= 1000)),
 {grouped_sql('f')}, q AS (SELECT * FROM groups WHERE least(m1, m2) >= 20 AND greatest(m1, m2) >= 30), {seeded_sql('q')},
 p AS (SELECT g.*, amb.sv_n, amb.is_ambiguous FROM q g JOIN amb ON {SAME_TYPE}), ids AS (SELECT group_id, sv_n, row_number() OVER (ORDER BY group_id, sv_n) AS sv_id FROM (SELECT DISTINCT group_id, sv_n FROM p)),
 pm AS (SELECT p.*, ids.sv_id FROM p JOIN ids USING (group_id, sv_n)), pr AS (SELECT x.sv_id, x.mol_id AS u, y.mol_id AS v FROM pm x JOIN pm y ON x.sample = y.sample AND x.sv_id = y.sv_id AND x.mol_id <> y.mol_id
 AND sqrt(pow(x.out_pos1 - y.out_pos1, 2) + pow(x.out_pos2 - y.out_pos2, 2)) <= 5), pc(sv_id, u, v) AS (SELECT * FROM pr UNION SELECT pc.sv_id, pc.u, pr.v FROM pc JOIN pr ON pr.sv_id = pc.sv_id AND pr.u = pc.v),
 cl AS (SELECT pm.*, least(pm.mol_id, coalesce(m.low, pm.mol_id)) AS comp FROM pm LEFT JOIN (SELECT sv_id, u AS mol_id, min(v) AS low FROM pc GROUP BY ALL) m USING (sv_id, mol_id)),
 un AS (SELECT * EXCLUDE (strand_count1, strand_count2), s1 AS strand_count1, s2 AS strand_count2 FROM (SELECT *, row_number() OVER (PARTITION BY sample, sv_id, comp ORDER BY node_class DESC, strand_count1 + strand_count2 DESC, mapq1 + mapq2 DESC, mol_id) AS nth,
 sum(strand_count1) OVER w AS s1, sum(strand_count2) OVER w AS s2, count(*) OVER w AS n_collapsed FROM cl WINDOW w AS (PARTITION BY sample, sv_id, comp)) WHERE nth = 1),
 agg AS (SELECT sv_id, any_value(group_id) AS group_id, count(*) AS n_total, count(*) FILTER (WHERE node_class = 0) AS n_gaps, count(*) FILTER (WHERE node_class = 1) AS n_splits, count(*) FILTER (WHERE strand_count1 > 0 AND strand_count2 > 0) AS n_duplex,
 sum(strand_count1 + strand_count2)::BIGINT AS strand_count, string_agg(DISTINCT sample, ',' ORDER BY sample) AS samples, count(DISTINCT sample) AS n_samples, string_agg(mapq1::VARCHAR, ',' ORDER BY mol_id) AS mapqs1, string_agg(mapq2::VARCHAR, ',' ORDER BY mol_id) AS mapqs2,
 count(*) FILTER (WHERE is_ambiguous) AS n_ambiguous, sum(n_collapsed)::BIGINT AS n_collapsed, {_COUNTS} FROM un GROUP BY sv_id),
 ref AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sv_id ORDER BY node_class DESC, CASE WHEN node_class = 1 THEN least(clip_len1, clip_len2) ELSE greatest(clip_len1, clip_len2) END DESC, mol_id) AS k FROM un) WHERE k = 1),
 rn AS (SELECT sv_id, concat_ws(':', chrom1, side1, pos1) AS node FROM ref WHERE clip_len1 > 0 UNION ALL SELECT sv_id, concat_ws(':', chrom2, side2, pos2) FROM ref WHERE clip_len2 > 0),
 oc AS (SELECT DISTINCT rn.sv_id, m.mol_id FROM (SELECT concat_ws(':', chrom1, side1, pos1) AS node, mol_id FROM fx_molecules WHERE clip_len1 >= 5) m JOIN rn USING (node)),
 nc AS (SELECT oc.sv_id, count(*) AS n_clips FROM oc ANTI JOIN un USING (sv_id, mol_id) GROUP BY 1),
 fin AS (SELECT agg.*, ref.mol_id AS ref_mol_id, ref.jxn_type, ref.chrom1, ref.side1, ref.pos1, ref.chrom2, ref.side2, ref.pos2, CASE WHEN ref.jxn_type = 'T' THEN 0 ELSE abs(ref.pos2 - ref.pos1) END AS sv_size, coalesce(nc.n_clips, 0) AS n_clips, ref.clip_len1 AS ref_clip1, ref.clip_len2 AS ref_clip2
 FROM agg JOIN ref USING (sv_id) LEFT JOIN nc USING (sv_id))"""  # fmt: skip


@query("call_svs", f"WITH RECURSIVE {_CALLS} SELECT * FROM fin")
def flagship(fx: Fixtures) -> DataFrame:
    clips = fx.molecules.where("clip_len1 >= 5").select(node_name(1).alias("node"), "mol_id", "sample", F.col("clip_len1").alias("clip_len"))
    return call_svs(fx.molecules, _SAMPLES, clips)


_RECORDS = BREAKENDS_SQL[BREAKENDS_SQL.index("two AS") :]


@query("call_breakends", f"""WITH RECURSIVE {_CALLS}, calls AS (SELECT fin.*, substr(s.ref_seq, 1, 1) AS ref1, substr(s.ref_seq, 2, 1) AS ref2, 12 - ref_clip1 - ref_clip2 AS mh,
 CASE WHEN 12 - ref_clip1 - ref_clip2 > 0 THEN substr(s.seq, ref_clip2 + 1, 12 - ref_clip1 - ref_clip2) WHEN 12 - ref_clip1 - ref_clip2 < 0 THEN substr(s.seq, 13 - ref_clip1, ref_clip1 + ref_clip2 - 12) ELSE '' END AS bases
 FROM fin JOIN fx_sequences s ON s.seq_id = fin.ref_mol_id), {_RECORDS}""")  # fmt: skip
def breakends(fx: Fixtures) -> DataFrame:
    """Calls as breakend records."""
    sequences = fx.sequences.select(
        F.col("seq_id").alias("mol_id"), "seq", F.lit(12).alias("len1"), F.lit(0).alias("merge_len"), F.substr("ref_seq", F.lit(1), F.lit(1)).alias("ref1"), F.substr("ref_seq", F.lit(2), F.lit(1)).alias("ref2")
    )
    return call_breakends(call_svs(fx.molecules, _SAMPLES), sequences)
