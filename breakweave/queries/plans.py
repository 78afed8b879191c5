"""Whole plans: coverage maps, copy numbers of single cells, networks of long reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Fixtures
from ..plans.copy_number import call_cnvs
from ..plans.coverage import coverage_map
from ..plans.path_networks import path_networks
from . import query
from .ordering import viterbi_sql
from .statistics import _FIT, gc_counts

c = F.col

_SPANS = """sp AS (SELECT chrom, start0, end1 FROM fx_spans WHERE mol_class = 'P' AND mol_id % 4 > 0 UNION ALL SELECT chrom, start0 + 3, end1 - 2 FROM fx_spans WHERE mol_class = 'P' AND mol_id % 4 = 0
 UNION ALL SELECT chrom, start0, start0 + 40 FROM fx_spans WHERE mol_class = 'V' UNION ALL SELECT chrom, end1 - 40, end1 FROM fx_spans WHERE mol_class = 'V')"""


@query("coverage_map", f"""WITH {_SPANS}, ev AS (SELECT chrom, start0 AS pos, 1 AS d FROM sp UNION ALL SELECT chrom, end1, -1 FROM sp), ch AS (SELECT chrom, pos, sum(d) AS d FROM ev GROUP BY ALL HAVING sum(d) <> 0),
 st AS (SELECT * FROM (SELECT chrom, pos AS start0, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS end1, (sum(d) OVER (PARTITION BY chrom ORDER BY pos))::BIGINT AS depth FROM ch) WHERE depth > 0),
 ck AS (SELECT chrom, k AS chunk_n, floor(sum(depth * (least(end1, (k + 1) * 65536) - greatest(start0, k * 65536))) * 10 / 65536 + 0.5) / 10 AS mean_depth FROM st, range(0, 3) t(k) WHERE start0 < (k + 1) * 65536 AND end1 > k * 65536 GROUP BY ALL)
 SELECT st.*, ck.chunk_n, ck.mean_depth FROM st JOIN ck ON ck.chrom = st.chrom AND ck.chunk_n = st.start0 // 65536""")  # fmt: skip
def coverage(fx: Fixtures) -> DataFrame:
    aln = lambda a, b: F.struct(a.alias("start0"), b.alias("end1"))
    clipped = {"is_clipped": c("mol_id") % 4 == 0, "mapped0": c("start0") + 3, "mapped1": c("end1") - 2}
    alns = F.array(aln(c("start0"), c("start0") + 40), aln(c("end1") - 40, c("end1")))
    return coverage_map(fx.spans.withColumns({**clipped, "alns": alns}))


_MU = "greatest(0.05, {k} * ((d0 + d1 * gc_index + d2 * gc_index * gc_index) / d) / 2)"
_EMIT = lambda mu: f"lgamma(n + 4.0) - lgamma(4.0) - lgamma(n + 1.0) + 4.0 * ln(4.0 / (4.0 + {mu})) + n * ln({mu} / (4.0 + {mu}))"
_STATES = ", ".join(_EMIT(_MU.format(k=k)) for k in range(5))


@query("call_cnvs", f"""WITH RECURSIVE {_FIT}, em AS (SELECT cell_id, chrom, bin_n, [{_STATES}] AS e FROM gcb JOIN fit USING (cell_id)), {viterbi_sql('em', 5, 0.3)},
 x AS (SELECT *, state - 2 AS diff FROM path WHERE state IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY cell_id, chrom ORDER BY bin_n) - row_number() OVER (PARTITION BY cell_id, chrom, diff ORDER BY bin_n) AS run FROM x)
 SELECT cell_id, chrom, diff::INT AS diff, min(bin_n) AS first, max(bin_n) AS last, count(*) AS n, CASE WHEN diff > 0 THEN 'gain' ELSE 'loss' END AS type FROM r WHERE diff <> 0 GROUP BY cell_id, chrom, diff, run""")  # fmt: skip
def cnvs(fx: Fixtures) -> DataFrame:
    return call_cnvs(gc_counts(fx), min_bins=1, persistence=0.3)


@query("path_networks", """WITH RECURSIVE e AS (SELECT event_id, channel, strand_key, pos1, pos2, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'D' END AS edge_type, event_id % 3 > 0 AS fusable FROM fx_nodes_long),
 sg AS (SELECT * FROM (SELECT *, CASE WHEN edge_type = 'A' OR fusable THEN 1 + sum((edge_type <> 'A' AND NOT fusable)::INT) OVER (PARTITION BY channel ORDER BY event_id) END::BIGINT AS segment_n FROM e) WHERE segment_n IS NOT NULL),
 j AS (SELECT *, channel || ':' || segment_n AS segment FROM sg WHERE edge_type <> 'A'), pl AS (SELECT strand_key, pos1, pos2, min(event_id) AS id FROM j GROUP BY ALL),
 p AS (SELECT a.id AS u, b.id AS v FROM pl a JOIN pl b ON a.strand_key = b.strand_key AND a.id <> b.id AND sqrt(pow(a.pos1 - b.pos1, 2) + pow(a.pos2 - b.pos2, 2)) <= 3),
 reach(id, r) AS (SELECT u, v FROM p UNION SELECT reach.id, p.v FROM reach JOIN p ON p.u = reach.r), k AS (SELECT pl.*, least(pl.id, coalesce(m.low, pl.id)) AS k FROM pl LEFT JOIN (SELECT id, min(r) AS low FROM reach GROUP BY id) m USING (id)),
 cl AS (SELECT *, dense_rank() OVER (ORDER BY k) AS cluster_n FROM k), mb AS (SELECT DISTINCT j.segment, cl.cluster_n FROM j JOIN cl USING (strand_key, pos1, pos2)),
 f AS (SELECT cluster_n, min(segment) AS low FROM mb GROUP BY 1), se AS (SELECT f.low AS u, mb.segment AS v FROM mb JOIN f USING (cluster_n) WHERE f.low <> mb.segment), sb AS (SELECT DISTINCT u, v FROM se UNION SELECT v, u FROM se),
 sr(id, r) AS (SELECT u, u FROM sb UNION SELECT sr.id, sb.v FROM sr JOIN sb ON sb.u = sr.r), nw AS (SELECT s.segment, coalesce(m.low, s.segment) AS network FROM (SELECT DISTINCT segment FROM mb) s LEFT JOIN (SELECT id AS segment, min(r) AS low FROM sr GROUP BY id) m USING (segment)),
 ty AS (SELECT channel::VARCHAR AS read, channel || ':' || segment_n AS segment, string_agg(edge_type, '' ORDER BY event_id) AS edge_types FROM sg GROUP BY channel, segment_n),
 jc AS (SELECT network, string_agg(DISTINCT 'J' || cluster_n, ',' ORDER BY 'J' || cluster_n) AS junction_clusters FROM mb JOIN nw USING (segment) GROUP BY network)
 SELECT nw.network, count(*) AS n_segments, string_agg(DISTINCT read, ',' ORDER BY read) AS reads, string_agg(DISTINCT edge_types, ',' ORDER BY edge_types) AS path_types, any_value(jc.junction_clusters) AS junction_clusters
 FROM nw JOIN ty USING (segment) JOIN jc ON jc.network = nw.network GROUP BY nw.network""")  # fmt: skip
def networks(fx: Fixtures) -> DataFrame:
    kind = F.when(c("event_id") % 2 == 0, "A").otherwise("D")
    x = fx.nodes_long.select("event_id", "channel", "strand_key", "pos1", "pos2", kind.alias("edge_type"), (c("event_id") % 3 > 0).alias("fusable"))
    return path_networks(x, "channel", "event_id", ["strand_key"], 3.0)
