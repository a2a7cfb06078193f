"""The library's queries on the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from cairnrank.functions import scalars as S
from cairnrank.operators import fusion, masks, postings, ranking, records, vectors
from cairnrank.plans import tables as T
from cairnrank.session import staged

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# --- vectors -------------------------------------------------------------------------------------------------------

_V = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS d FROM embeddings),"
_Z = _V + """
m AS (SELECT d, avg(x) AS mu, CASE WHEN stddev_pop(x) < 1e-6 THEN 1 ELSE stddev_pop(x) END AS sd FROM e GROUP BY d),
z AS (SELECT vec_id, label, d, (x - mu) / sd AS x FROM e JOIN m USING (d)),
"""


@query(f"""
WITH {_Z}
p AS (SELECT q.vec_id AS query_id, c.vec_id AS gid, c.label AS molecule, sum((c.x - q.x) * (c.x - q.x)) AS v
  FROM z q JOIN z c ON c.d = q.d AND c.label <> q.label WHERE q.vec_id % 20 = 0 GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v, gid) AS rank FROM p)
SELECT query_id, gid, CAST(molecule AS BIGINT) AS molecule, round(v, 6) AS value, rank FROM r WHERE rank <= 10
""")
def vector_topk_excluding(spark, sf_dir):
    """Exact nearest rows on z-scores, the query's own molecule left out."""
    v = T.vectors(spark, sf_dir)
    return vectors.nearest(v, T.asked(v), 10, standard=True, exclude=True).withColumn("value", F.round("value", 6))


@query(f"""
WITH {_V}
p AS (SELECT q.vec_id AS query_id, c.vec_id AS gid, sum((c.x - q.x) * (c.x - q.x)) AS v FROM e q JOIN e c ON c.d = q.d WHERE q.vec_id % 20 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v, gid) AS rank FROM p)
SELECT query_id, gid, round(1 / (1 + sqrt(v)), 6) AS similarity, rank FROM r WHERE rank <= 25
""")
def vector_similarity_topk(spark, sf_dir):
    v = T.vectors(spark, sf_dir)
    return vectors.nearest(v, T.asked(v), 25).select("query_id", "gid", F.round(1 / (1 + F.sqrt("value")), 6).alias("similarity"), "rank")


@query(f"""
WITH {_V[:-1]}
SELECT CAST(d AS BIGINT) AS dim, round(avg(x), 9) AS mean, round(CASE WHEN stddev_pop(x) < 1e-6 THEN 1 ELSE stddev_pop(x) END, 9) AS std FROM e GROUP BY d
""")
def standardisation(spark, sf_dir):
    m = vectors.moments(T.vectors(spark, sf_dir), "vector")
    return m.select(F.col("dim").cast("bigint").alias("dim"), F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query(f"""
WITH {_V}
p AS (SELECT q.vec_id AS query_id, c.vec_id AS gid, c.label AS molecule, sum((c.x - q.x) * (c.x - q.x)) AS v FROM e q JOIN e c ON c.d = q.d WHERE q.vec_id % 20 = 0 GROUP BY 1, 2, 3),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v, gid) AS r FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, molecule ORDER BY v, gid) AS o FROM t WHERE r <= 100)
SELECT query_id, CAST(molecule AS BIGINT) AS molecule, gid, row_number() OVER (PARTITION BY query_id ORDER BY v, gid) AS rank FROM o WHERE o = 1
""")
def molecule_representatives(spark, sf_dir):
    """The first row of each molecule among a query's hundred nearest."""
    v = T.vectors(spark, sf_dir)
    near = vectors.nearest(v, T.asked(v), 100).drop("rank")
    by = [F.asc("value"), F.asc("gid")]
    one = ranking.top_within(near, 1, by, ["query_id", "molecule"]).drop("rank")
    return ranking.ranked(one, by, ["query_id"]).select("query_id", "molecule", "gid", "rank")


_B = """b AS (SELECT vec_id, list_sum(list_transform(range(32), lambda j: CASE WHEN embedding[j + 1] > 0 THEN CAST(pow(2, j) AS BIGINT) ELSE 0 END))::BIGINT AS w0,
  list_sum(list_transform(range(32), lambda j: CASE WHEN embedding[j + 33] > 0 THEN CAST(pow(2, j) AS BIGINT) ELSE 0 END))::BIGINT AS w1 FROM embeddings),
t AS (SELECT q.vec_id AS query_id, c.vec_id AS gid, (bit_count(q.w0 & c.w0) + bit_count(q.w1 & c.w1)) / greatest(bit_count(q.w0 | c.w0) + bit_count(q.w1 | c.w1), 1)::DOUBLE AS s
  FROM b q, b c WHERE q.vec_id % 20 = 0),
"""


@query(f"""
WITH {_B} r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY 1 - s, gid) AS rank FROM t)
SELECT query_id, gid, round(s, 9) AS similarity, rank FROM r WHERE rank <= 20
""")
def bitset_topk(spark, sf_dir):
    b = T.bits(spark, sf_dir)
    return vectors.nearest(b, T.asked(b), 20, vectors.bit_tanimoto).select("query_id", "gid", F.round(1 - F.col("value"), 9).alias("similarity"), "rank")


@query(f"""
WITH {_V} {_B}
pool AS (SELECT query_id, gid AS molecule, 1 - (1 - s) AS s2, row_number() OVER (PARTITION BY query_id ORDER BY 1 - s, gid) AS n FROM t QUALIFY n <= 50),
d3 AS (SELECT q.vec_id AS query_id, c.vec_id AS molecule, 1 / (1 + sqrt(sum((c.x - q.x) * (c.x - q.x)))) AS s3 FROM e q JOIN e c ON c.d = q.d
  WHERE q.vec_id % 20 = 0 GROUP BY 1, 2),
c AS (SELECT p.query_id, p.molecule, s2, s3, CASE WHEN s3 IS NULL THEN s2 ELSE (0.4 * s2 + 0.6 * s3) / 1.0 END AS comb FROM pool p LEFT JOIN d3 ON d3.query_id = p.query_id AND d3.molecule = p.molecule),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY comb DESC, s2 DESC, molecule) AS rank FROM c)
SELECT query_id, molecule, round(s2, 6) AS score_2d, round(s3, 6) AS score_3d, round(comb, 6) AS combined, rank FROM r WHERE rank <= 10
""")
def hierarchical_search(spark, sf_dir):
    """A bitset pool, then its vectors, then the weighted mean."""
    b, v = T.bits(spark, sf_dir), T.vectors(spark, sf_dir)
    own = v.select("gid", F.col("gid").alias("molecule"), "vector")
    out = vectors.hierarchical(b, own, T.asked(b), T.asked(own), 50, 10)
    return out.select("query_id", "molecule", F.round("score_2d", 6).alias("score_2d"), F.round("score_3d", 6).alias("score_3d"), F.round("combined", 6).alias("combined"), "rank")


@query()
def partitioned_index_recall(spark, sf_dir):
    """Recall of a partitioned index (every row listed) against exact search."""
    v = T.vectors(spark, sf_dir)
    c = vectors.centroids(v, 16)
    found = vectors.probe(vectors.listed(v, c), T.asked(v), c, 13, 10)
    return vectors.recall(vectors.nearest(v, T.asked(v), 10), found, 10)


# --- rankings ------------------------------------------------------------------------------------------------------

_L = "l AS (SELECT *, l_orderkey * 8 + l_linenumber AS gid FROM lineitem),"


@query("""
WITH s AS (SELECT l_partkey AS gid, l_linenumber AS shard, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2),
b AS (SELECT gid, score, shard, row_number() OVER (PARTITION BY gid ORDER BY score DESC, shard) AS n FROM s),
r AS (SELECT gid, score, shard, row_number() OVER (ORDER BY score DESC, gid) AS rank FROM b WHERE n = 1)
SELECT * FROM r WHERE rank <= 500
""")
def ranked_merge(spark, sf_dir):
    """Ranked shards merged, an id once."""
    rows = T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("gid"), F.col("l_linenumber").alias("shard")).agg(F.max("l_extendedprice").alias("score"))
    return ranking.merged(rows, 500)


_CHANNELS = """
c AS (SELECT l_linenumber // 2 AS ch, l_partkey AS gid, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2),
k AS (SELECT ch, gid, score, row_number() OVER (PARTITION BY ch ORDER BY score DESC, gid) AS r FROM c),
a0 AS (SELECT gid, ch, r, 1 AS new FROM k WHERE ch = 0 AND r <= 300),
"""


def _channel(n: int, before: str, budget: int) -> str:
    return f"""
n{n} AS (SELECT k.gid, ch, r, CASE WHEN o.gid IS NULL THEN 1 ELSE 0 END AS new FROM k LEFT JOIN (SELECT DISTINCT gid FROM ({before})) o ON o.gid = k.gid WHERE ch = {n}),
a{n} AS (SELECT gid, ch, r, new FROM (SELECT *, coalesce(sum(new) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n{n}) WHERE b < {budget}),"""


@query(
    "WITH " + _CHANNELS + _channel(1, "SELECT gid FROM a0", 150) + _channel(2, "SELECT gid FROM a0 UNION ALL SELECT gid FROM a1", 100)
    + _channel(3, "SELECT gid FROM a0 UNION ALL SELECT gid FROM a1 UNION ALL SELECT gid FROM a2", 50)
    + """ u AS (SELECT * FROM a0 UNION ALL SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3),
g AS (SELECT gid, CAST(sum(1 << ch) AS BIGINT) AS source_flags, min(ch) AS first_channel, arg_min(r, ch) AS first_rank FROM u GROUP BY gid)
SELECT gid, source_flags, CAST(first_channel AS BIGINT) AS first_channel, first_rank, row_number() OVER (ORDER BY first_channel, first_rank) AS position FROM g
"""
)
def candidate_schedule(spark, sf_dir):
    """Four ranked channels, of two line numbers each, admitted within budgets of new ids."""
    channel = F.array(*map(F.lit, ranking.CHANNELS))[(F.col("l_linenumber") / 2).cast("int")]
    rows = T.table(spark, sf_dir, "lineitem").groupBy(channel.alias("channel"), F.col("l_partkey").alias("gid")).agg(F.max("l_extendedprice").alias("score"))
    rows = ranking.ranked_by_range(rows, "channel", [F.desc("score"), F.asc("gid")])
    return ranking.schedule(rows, {"baseline": 300, "strict": 150, "balanced": 100, "loose": 50})


@query(f"""
WITH {_L} o AS (UNPIVOT (SELECT l_suppkey, l_partkey, gid, l_extendedprice, l_quantity, l_discount FROM l) ON l_extendedprice, l_quantity, l_discount INTO NAME objective VALUE score)
SELECT l_suppkey AS query_id, l_partkey AS molecule, objective, arg_min(gid, (-score, gid)) AS gid, max(score) AS score FROM o GROUP BY 1, 2, 3
""")
def collapse_by_objective(spark, sf_dir):
    """Each objective's best row of a query's molecule, apart from the others."""
    rows = T.table(spark, sf_dir, "lineitem").withColumn("gid", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("objective"), F.col(c).alias("score")) for c in ("l_extendedprice", "l_quantity", "l_discount")]))
    rows = rows.select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("molecule"), "gid", each.alias("o")).select("*", "o.*")
    return ranking.collapse(rows, ["query_id", "molecule", "objective"])


@query(f"""
WITH {_L} r AS (SELECT l_partkey AS molecule, gid, l_extendedprice AS score, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, gid) AS rank FROM l)
SELECT molecule, gid, score, rank FROM r WHERE rank <= 3
""")
def top_rows_per_molecule(spark, sf_dir):
    rows = T.results(spark, sf_dir).select(F.col("molecule_id").alias("molecule"), "gid", "score")
    return ranking.top_within(rows, 3, [F.desc("score"), F.asc("gid")], ["molecule"])


@query(f"""
WITH {_L} g AS (SELECT gid, max(l_extendedprice) AS p, max(l_quantity) AS q, max(l_tax) AS t FROM l GROUP BY 1),
a AS (SELECT gid, row_number() OVER (ORDER BY p DESC, gid) AS r FROM g QUALIFY r <= 200),
b AS (SELECT gid, row_number() OVER (ORDER BY q DESC, gid) AS r FROM g QUALIFY r <= 200),
c AS (SELECT gid, row_number() OVER (ORDER BY t DESC, gid) AS r FROM g QUALIFY r <= 200)
SELECT gid, a.r AS rank_l_extendedprice, b.r AS rank_l_quantity, c.r AS rank_l_tax, least(a.r, b.r, c.r) AS best_rank FROM a FULL JOIN b USING (gid) FULL JOIN c USING (gid)
""")
def union_of_tops(spark, sf_dir):
    rows = T.table(spark, sf_dir, "lineitem").withColumn("gid", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    names = ["l_extendedprice", "l_quantity", "l_tax"]
    return ranking.union_of_tops(rows.groupBy("gid").agg(*[F.max(c).alias(c) for c in names]), names, 200)


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) - 1 AS b,
  count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS c FROM orders)
SELECT o_custkey, o_orderkey, b + (c - 1) / 2.0::DOUBLE AS average_rank FROM r
""")
def average_ranks(spark, sf_dir):
    rows = T.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return ranking.average_ranks(rows, "o_orderpriority", ["o_custkey"]).select("o_custkey", "o_orderkey", "average_rank")


@query("""
WITH a AS (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) - 1 + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0 AS x,
  rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) - 1 + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1) / 2.0 AS y FROM lineitem)
SELECT l_suppkey, round(CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END, 6) AS spearman, count(*) AS n FROM a GROUP BY 1
""")
def spearman_by_group(spark, sf_dir):
    out = ranking.spearman(T.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", ["l_suppkey"])
    return out.withColumn("spearman", F.round("spearman", 6))


_AGREE = """
a AS (SELECT l_partkey AS molecule, arg_min(gid, (-l_extendedprice, gid)) AS first_gid, max(l_extendedprice) AS s FROM l GROUP BY 1),
b AS (SELECT l_partkey AS molecule, arg_min(gid, (-l_quantity, gid)) AS second_gid, max(l_quantity) AS s FROM l GROUP BY 1),
ra AS (SELECT molecule, first_gid, row_number() OVER (ORDER BY s DESC, molecule) AS first_rank FROM a),
rb AS (SELECT molecule, second_gid, row_number() OVER (ORDER BY s DESC, molecule) AS second_rank FROM b)
"""


@query(f"""
WITH {_L} {_AGREE}
SELECT molecule, first_gid, first_rank, second_gid, second_rank,
  CASE WHEN first_rank <= 100 AND second_rank <= 100 THEN 'agreed' WHEN first_rank <= 100 AND second_rank > 500 THEN 'first_only'
       WHEN second_rank <= 100 AND first_rank > 500 THEN 'second_only' ELSE 'none' END AS comparison
FROM ra JOIN rb USING (molecule)
""")
def two_metric_comparison(spark, sf_dir):
    rows = T.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("molecule"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("gid"), "l_extendedprice", "l_quantity")
    return ranking.two_metric_comparison(rows, "molecule", "l_extendedprice", "l_quantity", 100, 500)


@query(f"""
WITH {_L} {_AGREE}
SELECT round(corr(first_rank, second_rank), 6) AS rank_correlation, count(*) FILTER (first_rank <= 200 AND second_rank <= 200) AS shared_top, count(*) AS n FROM ra JOIN rb USING (molecule)
""")
def ranking_agreement(spark, sf_dir):
    c = two_metric_comparison(spark, sf_dir)
    out = ranking.ranking_agreement(c.select(F.col("molecule").alias("gid"), F.col("first_rank").alias("rank")), c.select(F.col("molecule").alias("gid"), F.col("second_rank").alias("rank")), 200)
    return out.withColumn("rank_correlation", F.round("rank_correlation", 6))


# --- fusion --------------------------------------------------------------------------------------------------------

_E = """
x AS (SELECT CAST(s_nationkey AS VARCHAR) AS site_id, CAST(l_suppkey AS VARCHAR) AS query_id, 'R' || (l_suppkey % 7) AS receptor_id, l_partkey AS molecule_id,
  l_orderkey * 8 + l_linenumber AS gid, l_extendedprice AS score FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
c AS (SELECT site_id, query_id, receptor_id, molecule_id, arg_min(gid, (-score, gid)) AS gid, max(score) AS score FROM x GROUP BY 1, 2, 3, 4),
e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, molecule_id) AS r, count(*) OVER (PARTITION BY query_id) AS n FROM c),
"""
_S = _E + """
s0 AS (SELECT site_id, molecule_id, count(DISTINCT query_id) AS query_support, count(DISTINCT receptor_id) AS receptor_support, min(r) AS best_query_rank,
  max(1 - (r - 1) / greatest(1, n - 1)::DOUBLE) AS best_percentile, round(sum(1.0::DOUBLE / (60 + r)), 12) AS rrf_score FROM e GROUP BY 1, 2),
s AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY rrf_score DESC, best_query_rank, molecule_id) AS site_consensus_rank FROM s0),
"""
_A = _S + """
p AS (SELECT site_id, molecule_id, min((query_id, r)) AS place, list(('protected_query:' || query_id) ORDER BY query_id) AS why FROM e WHERE r <= 20 GROUP BY 1, 2),
h AS (SELECT site_id, count(*) AS held FROM p GROUP BY 1),
f AS (SELECT s.site_id, s.molecule_id, site_consensus_rank AS cr, coalesce(held, 0) AS held,
  sum(CASE WHEN p.molecule_id IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY s.site_id ORDER BY site_consensus_rank) AS fresh
  FROM s LEFT JOIN p ON p.site_id = s.site_id AND p.molecule_id = s.molecule_id LEFT JOIN h ON h.site_id = s.site_id WHERE site_consensus_rank <= 100),
k AS (SELECT site_id, molecule_id, cr FROM f WHERE held + fresh <= 200),
a0 AS (SELECT coalesce(p.site_id, k.site_id) AS site_id, coalesce(p.molecule_id, k.molecule_id) AS molecule_id, place, cr,
  array_to_string(list_concat(coalesce(why, []), CASE WHEN cr IS NULL THEN [] ELSE ['site_consensus'] END), ',') AS reasons
  FROM p FULL JOIN k ON p.site_id = k.site_id AND p.molecule_id = k.molecule_id),
a AS (SELECT site_id, molecule_id, reasons, row_number() OVER (PARTITION BY site_id ORDER BY place NULLS LAST, cr) AS site_admission_rank FROM a0),
"""


@query(f"WITH {_E[:-2]} SELECT site_id, query_id, receptor_id, molecule_id, gid, score, r AS query_molecule_rank, 1 - (r - 1) / greatest(1, n - 1)::DOUBLE AS query_rank_percentile FROM e")
def query_evidence(spark, sf_dir):
    return fusion.evidence(T.results(spark, sf_dir))


@query(f"WITH {_S[:-2]} SELECT * FROM s")
def site_consensus(spark, sf_dir):
    """Reciprocal rank fusion by site."""
    return fusion.site_summary(fusion.evidence(T.results(spark, sf_dir)))


def _admitted(spark, sf_dir):
    rows = fusion.evidence(T.results(spark, sf_dir))
    return rows, fusion.admission(rows, fusion.site_summary(rows), 20, 100, 200)


@query(f"WITH {_A[:-2]} SELECT * FROM a")
def site_admission(spark, sf_dir):
    a = _admitted(spark, sf_dir)[1]
    return a.select("site_id", "molecule_id", F.array_join("admission_reasons", ",").alias("reasons"), "site_admission_rank")


@query(f"""
WITH {_A[:-2]}
SELECT 'DT-' || upper(substr(sha256(e.site_id || '|' || e.molecule_id || '|' || e.query_id || '|' || e.receptor_id), 1, 16)) AS docking_task_id,
  e.site_id, e.molecule_id, e.query_id, e.receptor_id, e.gid, e.score AS search_score, e.r AS query_molecule_rank, a.site_admission_rank, a.reasons
FROM e JOIN a ON a.site_id = e.site_id AND a.molecule_id = e.molecule_id
""")
def docking_tasks(spark, sf_dir):
    return fusion.tasks(*_admitted(spark, sf_dir))


@query(f"WITH {_A[:-2]} SELECT site_id, w AS reason, count(*) AS molecules FROM (SELECT site_id, unnest(string_split(reasons, ',')) AS w FROM a) GROUP BY 1, 2")
def admission_reasons(spark, sf_dir):
    return fusion.reason_counts(_admitted(spark, sf_dir)[1])


@query(f"""
WITH {_E} q AS (SELECT site_id, count(DISTINCT query_id) AS queries FROM e GROUP BY 1), m AS (SELECT site_id, molecule_id, count(DISTINCT query_id) AS n FROM e GROUP BY 1, 2)
SELECT site_id, queries, count(*) AS found, count(*) FILTER (n = queries) AS shared_all, count(*) FILTER (n = 1) AS exclusive FROM m JOIN q USING (site_id) GROUP BY 1, 2
""")
def query_set_report(spark, sf_dir):
    return fusion.set_report(fusion.evidence(T.results(spark, sf_dir)))


@query(f"""
WITH {_E} k AS (SELECT unnest([100, 300]) AS k),
z AS (SELECT site_id, query_id, k, count(*) AS n FROM e, k WHERE r <= k GROUP BY 1, 2, 3),
i AS (SELECT x.site_id, x.query_id AS a, y.query_id AS b, k, count(*) AS shared FROM e x JOIN e y ON x.site_id = y.site_id AND x.molecule_id = y.molecule_id AND x.query_id < y.query_id, k
  WHERE x.r <= k AND y.r <= k GROUP BY 1, 2, 3, 4)
SELECT za.site_id, za.query_id AS a, zb.query_id AS b, CAST(za.k AS BIGINT) AS k, coalesce(shared, 0) AS shared,
  coalesce(shared, 0) / (za.n + zb.n - coalesce(shared, 0))::DOUBLE AS jaccard, coalesce(shared, 0) / least(za.n, zb.n)::DOUBLE AS overlap
FROM z za JOIN z zb ON za.site_id = zb.site_id AND za.k = zb.k AND za.query_id < zb.query_id LEFT JOIN i ON i.site_id = za.site_id AND i.a = za.query_id AND i.b = zb.query_id AND i.k = za.k
""")
def query_overlap(spark, sf_dir):
    return fusion.top_overlap(fusion.evidence(T.results(spark, sf_dir)), (100, 300))


@query(f"""
WITH {_E[:-2]}
SELECT x.site_id, x.query_id AS a, y.query_id AS b, count(*) AS shared, round(CASE WHEN count(*) > 1 AND stddev_pop(x.r) > 1e-12 AND stddev_pop(y.r) > 1e-12 THEN corr(x.r, y.r) END, 6) AS rank_correlation
FROM e x JOIN e y ON x.site_id = y.site_id AND x.molecule_id = y.molecule_id AND x.query_id < y.query_id GROUP BY 1, 2, 3
""")
def query_rank_correlation(spark, sf_dir):
    out = fusion.shared_rank_correlation(fusion.evidence(T.results(spark, sf_dir)))
    return out.withColumn("rank_correlation", F.round("rank_correlation", 6))


# --- postings ------------------------------------------------------------------------------------------------------

_C = """c AS (SELECT vec_id AS gid, i AS idx, i % 6 + 1 AS type, round(10 * embedding[3 * i + 1]::DOUBLE, 4) AS x, round(10 * embedding[3 * i + 2]::DOUBLE, 4) AS y,
  round(10 * embedding[3 * i + 3]::DOUBLE, 4) AS z FROM (SELECT vec_id, embedding, unnest(range(21)) AS i FROM embeddings)),
pr AS (SELECT a.gid, a.idx AS i, b.idx AS j, least(a.type, b.type) AS t1, greatest(a.type, b.type) AS t2, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d
  FROM c a JOIN c b ON a.gid = b.gid AND a.idx < b.idx),
ix AS (SELECT DISTINCT t1, t2, CAST(floor(d / 0.5) AS BIGINT) AS bin, gid FROM pr WHERE d <= 20),
"""
_F = _C + """
qp AS (SELECT gid AS query_id, i || '::' || j AS pair_id, t1, t2, d FROM pr WHERE gid % 20 = 0 AND i < 3 AND j < 3),
pf AS (SELECT * FROM (VALUES ('loose', 2.0, 1), ('balanced', 1.0, 2), ('strict', 0.5, 3)) v(profile, tol, need)),
hits AS (SELECT query_id, ix.gid, profile, need, count(DISTINCT pair_id) AS matched FROM qp, pf, ix WHERE ix.t1 = qp.t1 AND ix.t2 = qp.t2 AND d - tol <= 20
  AND ix.bin BETWEEN CAST(floor(greatest(0, d - tol::DOUBLE) / 0.5) AS BIGINT) AND CAST(floor(least(20, d + tol::DOUBLE) / 0.5) AS BIGINT) GROUP BY 1, 2, 3, 4),
np AS (SELECT query_id, count(DISTINCT pair_id) AS pairs FROM qp GROUP BY 1),
fd AS (SELECT query_id, gid, profile, matched FROM hits JOIN np USING (query_id) WHERE matched >= least(need, pairs)),
"""


@query(f"WITH {_C[:-2]} SELECT t1, t2, bin, count(*) AS rows, min(gid) AS first FROM ix GROUP BY 1, 2, 3")
def pair_postings(spark, sf_dir):
    return postings.postings(T.clouds(spark, sf_dir)).groupBy("t1", "t2", "bin").agg(F.count("*").alias("rows"), F.min("gid").alias("first"))


def _found(spark, sf_dir):
    c = T.clouds(spark, sf_dir)
    pairs = postings.pairs_of(T.asked(c).filter("idx < 3")).select(F.col("gid").alias("query_id"), F.concat_ws("::", "i", "j").alias("pair_id"), "t1", "t2", "distance")
    return postings.search(postings.postings(c), pairs)


@query(f"WITH {_F[:-2]} SELECT * FROM fd")
def pair_search(spark, sf_dir):
    """Three profiles of tolerance in one join."""
    return _found(spark, sf_dir)


@query(f"""
WITH {_F} u AS (SELECT query_id, gid, 1 AS flag, CASE profile WHEN 'loose' THEN 1 WHEN 'balanced' THEN 2 ELSE 3 END AS tier FROM fd
  UNION ALL SELECT q.query_id, v.vec_id, 2, 0 FROM (SELECT DISTINCT query_id FROM qp) q JOIN embeddings e ON e.vec_id = q.query_id JOIN embeddings v ON v.label = e.label)
SELECT query_id, gid, CAST(bit_or(flag) AS BIGINT) AS source_flags, CAST(max(tier) AS BIGINT) AS tier FROM u GROUP BY 1, 2
""")
def pair_search_tiers(spark, sf_dir):
    """Tiers, with rows of the query's own label as outside ids."""
    v = T.vectors(spark, sf_dir)
    outside = T.asked(v).select(F.col("gid").alias("query_id"), "molecule").join(v.select("gid", "molecule"), "molecule").select("query_id", "gid")
    return postings.tiers(_found(spark, sf_dir), outside)


# --- masks ---------------------------------------------------------------------------------------------------------

_P = """h AS (SELECT l_orderkey * 8 + l_linenumber AS gid, l_orderkey AS molecule, l_extendedprice AS score, l_quantity >= 25 AS h0, l_discount >= 0.05 AS h1, l_tax <= 0.04 AS h2, l_returnflag = 'R' AS h3,
  l_quantity / 50 AS s0, l_discount * 10 AS s1, l_tax * 12.5 AS s2, l_linestatus FROM lineitem),
p AS (SELECT *, (h0::BIGINT + 2 * h1::BIGINT + 4 * h2::BIGINT + 8 * h3::BIGINT) AS mask,
  CAST(CASE WHEN NOT h0 THEN 0 WHEN NOT h1 THEN 1 WHEN NOT h2 THEN 2 WHEN NOT h3 THEN 3 ELSE 4 END AS BIGINT) AS stage FROM h),
"""


@query(f"""
WITH {_P} b AS (SELECT unnest(range(4)) AS bit), m AS (SELECT molecule, bit_or(mask) AS mask FROM p GROUP BY 1)
SELECT bit, (SELECT count(*) FROM m WHERE (mask >> bit) & 1 = 1) AS molecules, (SELECT count(*) FROM p WHERE (mask >> bit) & 1 = 1) AS poses FROM b
""")
def mask_bit_counts(spark, sf_dir):
    return masks.bit_counts(T.poses(spark, sf_dir), "molecule", "mask", 4)


@query(f"WITH {_P[:-2]} SELECT mask, count(DISTINCT molecule) AS molecules FROM p GROUP BY 1")
def mask_histogram(spark, sf_dir):
    return masks.mask_histogram(T.poses(spark, sf_dir), "molecule", "mask")


@query(f"WITH {_P[:-2]} SELECT molecule, bit_or(mask) AS union_mask, count(*) AS poses FROM p GROUP BY 1")
def union_masks(spark, sf_dir):
    return masks.union_masks(T.poses(spark, sf_dir), "molecule", "mask")


@query(f"WITH {_P[:-2]} SELECT molecule, mask, max(score) AS score, arg_min(gid, (-score, gid)) AS gid FROM p WHERE mask <> 0 GROUP BY 1, 2")
def best_pose_by_mask(spark, sf_dir):
    return masks.best_by_mask(T.poses(spark, sf_dir), "molecule", "mask", "score")


@query(f"""
WITH {_P} b AS (SELECT unnest(range(5)) AS stage), m AS (SELECT molecule, max(stage) AS st FROM p GROUP BY 1)
SELECT stage, (SELECT count(*) FROM p WHERE p.stage >= b.stage) AS rows, (SELECT count(*) FROM m WHERE st >= b.stage) AS molecules FROM b
""")
def stage_histogram(spark, sf_dir):
    return masks.stage_histogram(T.poses(spark, sf_dir), "molecule", "stage", 4)


@query(f"WITH {_P[:-2]} SELECT CASE WHEN NOT h0 THEN 'quantity' WHEN NOT h1 THEN 'discount' WHEN NOT h2 THEN 'tax' ELSE 'passed' END AS reason, count(*) AS rows FROM p GROUP BY 1")
def rejection_reasons(spark, sf_dir):
    p = T.poses(spark, sf_dir)
    return p.groupBy(masks.first_failure([("quantity", F.col("h0")), ("discount", F.col("h1")), ("tax", F.col("h2"))]).alias("reason")).agg(F.count("*").alias("rows"))


@query(f"""
WITH {_P[:-2]}
SELECT 0::BIGINT AS bit, count(*) FILTER (h0) AS alone, count(*) FILTER (h0) AS cumulative FROM p UNION ALL
SELECT 1, count(*) FILTER (h1), count(*) FILTER (h0 AND h1) FROM p UNION ALL SELECT 2, count(*) FILTER (h2), count(*) FILTER (h0 AND h1 AND h2) FROM p UNION ALL
SELECT 3, count(*) FILTER (h3), count(*) FILTER (h0 AND h1 AND h2 AND h3) FROM p
""")
def anchor_pass_counts(spark, sf_dir):
    return masks.pass_counts(T.poses(spark, sf_dir), [F.col(f"h{j}") for j in range(4)])


def _chosen(test: str) -> str:
    return f"""WITH {_P} o AS (SELECT molecule, gid, score, row_number() OVER (PARTITION BY molecule ORDER BY score DESC, gid) AS n FROM p WHERE {test}),
r AS (SELECT molecule, gid, score, row_number() OVER (ORDER BY score DESC, gid) AS rank FROM o WHERE n = 1) SELECT * FROM r WHERE rank <= 400"""


@query(_chosen("s0 >= 0.5 AND (s1 >= 0.5 AND l_linestatus = 'O') AND s2 >= 0.5"))
def selection_all(spark, sf_dir):
    p = T.poses(spark, sf_dir)
    return masks.selection(p, masks.pose_passes("scores", "assignments", [0, 1, 2], 0.5, "all"), 400).select("molecule", "gid", "score", "rank")


@query(_chosen("(s1 >= 0.9 AND l_linestatus = 'O') OR s2 >= 0.9"))
def selection_any(spark, sf_dir):
    p = T.poses(spark, sf_dir)
    return masks.selection(p, masks.pose_passes("scores", "assignments", [1, 2], 0.9, "any"), 400).select("molecule", "gid", "score", "rank")


# --- records -------------------------------------------------------------------------------------------------------


@query("SELECT c_mktsegment AS library, count(DISTINCT o_custkey) AS molecules, count(o_custkey) AS conformers, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def library_summary(spark, sf_dir):
    rows = T.table(spark, sf_dir, "customer").join(T.table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").withColumnRenamed("c_mktsegment", "library")
    return records.library_summary(rows, "library", "o_custkey", "o_totalprice").withColumn("total", F.round("total", 2))


@query("SELECT size, count(*) AS molecules FROM (SELECT count(*) AS size FROM orders GROUP BY o_custkey) GROUP BY 1")
def conformer_histogram(spark, sf_dir):
    return records.group_size_histogram(T.table(spark, sf_dir, "orders"), "o_custkey")


@query("""
SELECT r_name, n_name, count(*) AS suppliers, round(avg(s_acctbal), 6) AS balance FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2
""")
def dimension_join(spark, sf_dir):
    """Three relations joined on their keys."""
    s, n, r = (T.table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    both = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return both.groupBy("r_name", "n_name").agg(F.count("*").alias("suppliers"), F.round(F.avg("s_acctbal"), 6).alias("balance"))


@query("""
WITH b AS (SELECT *, l_orderkey % 3 = 0 AS kn FROM lineitem),
n AS (SELECT *, first_value(l_returnflag) OVER w AS f, row_number() OVER w AS k FROM b WHERE NOT kn WINDOW w AS (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber)),
o AS (SELECT l_partkey, l_suppkey, min(l_returnflag) AS known FROM b WHERE kn GROUP BY 1, 2)
SELECT outcome, count(*) AS rows FROM (SELECT CASE WHEN l_returnflag <> coalesce(known, f) THEN 'conflict' WHEN k > 1 OR known IS NOT NULL THEN 'duplicate' ELSE 'inserted' END AS outcome
  FROM n LEFT JOIN o ON o.l_partkey = n.l_partkey AND o.l_suppkey = n.l_suppkey) GROUP BY 1
""")
def import_outcomes(spark, sf_dir):
    """New records against known ones: inserted, duplicate, conflict."""
    rows = T.table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag")
    known, new = rows.filter("l_orderkey % 3 = 0"), rows.filter("l_orderkey % 3 <> 0")
    return records.imported(new, known, ["l_partkey", "l_suppkey"], "l_returnflag", ["l_orderkey", "l_linenumber"]).groupBy("outcome").agg(F.count("*").alias("rows"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders)
SELECT o_orderkey, o_custkey, CASE WHEN n = 1 THEN ascii(o_orderpriority) - 48 ELSE -sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::BIGINT END AS internal_index FROM r
""")
def preserved_indexes(spark, sf_dir):
    rows = T.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.ascii("o_orderpriority") - 48).alias("index"))
    return records.preserved_index(rows, "o_custkey", "index", ["o_orderkey"]).select("o_orderkey", "o_custkey", "internal_index")


@query("""
WITH s AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, user_id, event_type, before FROM s WHERE NOT CASE WHEN before IS NULL THEN event_type IN ('view') WHEN before = 'view' THEN event_type IN ('view', 'click') WHEN before = 'click' THEN event_type IN ('purchase', 'view') ELSE event_type = 'view' END
""")
def illegal_transitions(spark, sf_dir):
    """Events whose user's last event doesn't allow them."""
    e = T.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    kinds = [r[0] for r in e.select("event_type").distinct().collect()]
    legal = {"view": ("view", "click"), "click": ("purchase", "view")} | {k: ("view",) for k in kinds if k not in ("view", "click")}
    return records.illegal_transitions(e, "user_id", "event_type", ["ts", "event_id"], legal, ("view",)).select("event_id", "user_id", "event_type", "before")


@query("""
WITH s AS (SELECT label, min(vec_id) AS start, count(*) AS count FROM embeddings GROUP BY 1), e AS (SELECT *, coalesce(lag(start + count) OVER (ORDER BY start), 0) AS expected FROM s)
SELECT CAST(label AS BIGINT) AS shard, start, count, expected FROM e WHERE start <> expected
""")
def catalog_faults(spark, sf_dir):
    shards = T.vectors(spark, sf_dir).groupBy(F.col("molecule").alias("shard")).agg(F.min("gid").alias("start"), F.count("*").alias("count"))
    return records.catalog_faults(shards)


@query("""
WITH a AS (SELECT l_orderkey, max(l_extendedprice) AS s FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey, max(l_extendedprice) AS s FROM lineitem WHERE l_linenumber > 1 GROUP BY 1)
SELECT coalesce(max(abs(a.s - b.s)), 0) AS max_error, count(*) FILTER (a.s IS NULL) AS only_second, count(*) FILTER (b.s IS NULL) AS only_first, count(*) AS ids FROM a FULL JOIN b USING (l_orderkey)
""")
def score_equivalence(spark, sf_dir):
    rows = T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("s"))
    a, b = (x.groupBy("l_orderkey").agg(F.max("s").alias("s")) for x in (rows, rows.filter("l_linenumber > 1")))
    return records.score_equivalence(a, b, ["l_orderkey"], "s")


@query("""
SELECT l_linenumber AS setting, count(*) AS runs, min(l_discount) AS least, round(avg(l_discount), 9) AS mean, quantile_cont(l_discount, 0.5) AS p50, round(quantile_cont(l_discount, 0.95), 9) AS p95, min(l_discount) >= 0.0 AS passes
FROM lineitem GROUP BY 1
""")
def settings_summary(spark, sf_dir):
    out = records.settings_summary(T.table(spark, sf_dir, "lineitem").withColumnRenamed("l_linenumber", "setting"), ["setting"], "l_discount", 0.0)
    return out.withColumns({"mean": F.round("mean", 9), "p95": F.round("p95", 9)})


@query("""
WITH s AS (SELECT s_nationkey AS shard, count(*) AS size FROM supplier GROUP BY 1),
f AS (SELECT *, size * (60 - count(*) OVER ()) / sum(size) OVER ()::DOUBLE AS share FROM s),
p AS (SELECT *, floor(share) AS fl, row_number() OVER (ORDER BY share - floor(share) DESC, shard) AS place FROM f)
SELECT shard, CAST(1 + fl + CASE WHEN place <= 60 - count(*) OVER () - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS take FROM p
""")
def stratified_counts(spark, sf_dir):
    shards = T.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("shard")).agg(F.count("*").alias("size"))
    return records.stratified_counts(shards, 60)


# --- scalars -------------------------------------------------------------------------------------------------------


@query("""
SELECT p_partkey, trim(regexp_replace(lower(trim(p_name || ' / ' || p_brand)), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
  trim(regexp_replace(p_name || '#' || p_type, '[^A-Za-z0-9._-]+', '_', 'g'), '._') AS safe,
  'DT-' || upper(substr(sha256(p_partkey || '|' || p_brand), 1, 16)) AS task FROM part
""")
def names_and_ids(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", S.slugify(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"), S.safe_name(F.concat_ws("#", "p_name", "p_type")).alias("safe"),
        S.task_id(F.col("p_partkey").cast("string"), F.col("p_brand")).alias("task"),
    )


@query("""
WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'mol_' || o_custkey WHEN o_orderkey % 3 = 1 THEN 'mol_' || o_custkey || '_conf' || (o_orderkey % 9) ELSE 'mol-' || o_custkey || '-CONF_' || (o_orderkey % 11) END AS s FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(s, '(?i)^(.+?)[_-]conf[_-]?(\\d+)$') THEN regexp_extract(s, '(?i)^(.+?)[_-]conf[_-]?(\\d+)$', 1) ELSE s END AS molecule,
  CASE WHEN regexp_matches(s, '(?i)^(.+?)[_-]conf[_-]?(\\d+)$') THEN CAST(regexp_extract(s, '(?i)^(.+?)[_-]conf[_-]?(\\d+)$', 2) AS INTEGER) ELSE 0 END AS conformer FROM n
""")
def conformer_names(spark, sf_dir):
    o, k = T.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("mol_"), "o_custkey")).when(k % 3 == 1, F.concat(F.lit("mol_"), "o_custkey", F.lit("_conf"), k % 9)).otherwise(F.concat(F.lit("mol-"), "o_custkey", F.lit("-CONF_"), k % 11))
    molecule, conformer = S.split_conformer(F.col("s"))
    return o.select("o_orderkey", name.alias("s")).select("o_orderkey", molecule.alias("molecule"), conformer.alias("conformer"))


@query("""
SELECT l_orderkey, l_linenumber, (least(l_suppkey % 6 + 1, l_partkey % 6 + 1) << 24) | (greatest(l_suppkey % 6 + 1, l_partkey % 6 + 1) << 16) | CAST(floor(l_quantity / 0.5) AS BIGINT) AS key,
  CAST(floor(greatest(0, l_quantity - 2) / 0.5) AS BIGINT) AS low, CAST(floor(least(20, l_quantity + 2) / 0.5) AS BIGINT) AS high,
  CASE WHEN l_tax + l_discount - l_tax * l_discount <= 0 THEN 0 ELSE round(l_tax * l_discount / (l_tax + l_discount - l_tax * l_discount), 9) END AS tanimoto,
  CASE WHEN 0.95 * l_tax + 0.05 * l_discount <= 0 THEN 0 ELSE round(l_tax * l_discount / (0.95::DOUBLE * l_tax + 0.05::DOUBLE * l_discount), 9) END AS tversky FROM lineitem
""")
def keys_and_scores(spark, sf_dir):
    rows = T.table(spark, sf_dir, "lineitem")
    low, high = S.bin_range(F.col("l_quantity"), F.lit(2.0), 0.5, 20)
    cross = F.col("l_tax") * F.col("l_discount")
    return rows.select(
        "l_orderkey", "l_linenumber", S.pair_key(F.col("l_suppkey") % 6 + 1, F.col("l_partkey") % 6 + 1, S.distance_bin(F.col("l_quantity"), 0.5)).alias("key"), low.alias("low"), high.alias("high"),
        F.round(S.tanimoto(cross, F.col("l_tax"), F.col("l_discount")), 9).alias("tanimoto"), F.round(S.tversky(cross, F.col("l_tax"), F.col("l_discount")), 9).alias("tversky"),
    )


# --- clouds and poses ----------------------------------------------------------------------------------------------


@query(f"""
WITH {_C[:-2]}
SELECT b.gid * 32 + b.idx AS point, arg_min(a.gid * 32 + a.idx, (sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), a.gid * 32 + a.idx)) AS partner,
  round(min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)), 6) AS distance, count(*) AS within
FROM c b JOIN c a ON a.gid <> b.gid AND abs(a.x - b.x) <= 0.2 WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 0.2 GROUP BY 1
""")
def nearest_partner(spark, sf_dir):
    """Spatial nearest-neighbour join by grid cells: each feature with the nearest one of another cloud."""
    from cairnrank.operators.overlay import nearest_partner as join

    c = T.clouds(spark, sf_dir).select((F.col("gid") * 32 + F.col("idx")).alias("id"), "gid", "x", "y", "z")
    found = join(c, c, 0.2, apart="gid")
    return found.withColumn("distance", F.round("distance", 6))


@query()
def overlay_scores(spark, sf_dir):
    """Every cloud laid on each asked cloud by axis seeds: three objectives, each with a pose of its own."""
    from cairnrank.functions.geometry import OBJECTIVES
    from cairnrank.operators import overlay

    rows, asked = _overlay_queries(spark, sf_dir)
    out = _united(overlay.scored(rows, q, poses=False, most=0) for q in asked)
    return out.select("query_id", "gid", *[F.round(o, 6).alias(o) for o in OBJECTIVES])


def _overlay_queries(spark, sf_dir):
    """All clouds, and blocks of the asked ones as queries."""
    from cairnrank.functions.geometry import Overlay
    from cairnrank.operators.overlay import blocks, nested

    rows = nested(T.clouds(spark, sf_dir))
    return rows, blocks(T.asked(rows), lambda r: Overlay(r["shape"], r["features"], r["types"], [1.5] * 3 + [1.0] * 18, (0, 1, 2)))


def _united(parts):
    return reduce(lambda a, b: a.unionByName(b), parts)


def _anchors(queries):
    """The first three features of each query, with their types."""
    return {i: (q.features[:3], q.types[:3].tolist()) for i, q in queries.items()}


@query()
def staged_rerank(spark, sf_dir):
    """For each asked cloud all clouds coarsely, the best by each objective finely, then which feature meets which anchor."""
    from cairnrank.operators import overlay

    rows, asked = _overlay_queries(spark, sf_dir)

    def one(q):
        poses = staged(overlay.staged_rerank(rows, q, 10), "poses")
        notes = overlay.annotated(poses, rows, {i: overlay.anchors_of(*a, [1.5, 1.0, 1.0]) for i, a in _anchors(q).items()})
        return poses.select("query_id", "gid", F.round("atomcentered_anchored_joint", 6).alias("score")).join(notes, ["query_id", "gid"])

    return _united(map(one, asked)).select("query_id", "gid", "score", F.round("match_score", 6).alias("match_score"), F.array_join(F.col("assignments").cast("array<string>"), ",").alias("assignments"))


@query()
def necessary_conditions(spark, sf_dir):
    """How many clouds can meet each asked cloud's first three features in one pose, and why others can't."""
    from cairnrank.operators import overlay

    rows, asked = _overlay_queries(spark, sf_dir)
    return _united(overlay.necessary(rows, _anchors(q), 0.75) for q in asked).groupBy("query_id", "reason").agg(F.count("*").alias("rows"))


# --- streams -------------------------------------------------------------------------------------------------------


@query("SELECT user_id, count(*) AS rows, CAST(bit_or(1 << CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END) AS BIGINT) AS mask FROM events GROUP BY 1")
def stream_masks(spark, sf_dir):
    """Running masks over a file stream."""
    from cairnrank.streaming import incremental as I

    schema = T.table(spark, sf_dir, "events").schema
    kind = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "purchase", 4).otherwise(8)
    rows = I.file_stream(spark, sf_dir, schema, "events.parquet").select("user_id", kind.cast("bigint").alias("mask"))
    return I.kept(I.running_masks(rows, "user_id", "mask")).select("user_id", "rows", "mask")


@query("SELECT user_id, arg_min(event_id, (-value, event_id)) AS event_id, max(value) AS value FROM events GROUP BY 1")
def stream_best_rows(spark, sf_dir):
    """The best row by key over a file stream."""
    from cairnrank.streaming import incremental as I

    schema = T.table(spark, sf_dir, "events").schema
    return I.kept(I.running_best(I.file_stream(spark, sf_dir, schema, "events.parquet"), "user_id", "value", "event_id"))


@query("SELECT event_type, count(*) AS rows, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1")
def stream_append(spark, sf_dir):
    """Rows of a file stream appended once to a folder."""
    from cairnrank.session import scratch
    from cairnrank.streaming import incremental as I

    target = scratch(spark, "appended")
    I.appended(I.file_stream(spark, sf_dir, T.table(spark, sf_dir, "events").schema, "events.parquet"), target, "event_id")
    return spark.read.parquet(target).groupBy("event_type").agg(F.count("*").alias("rows"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


# --- nested data ---------------------------------------------------------------------------------------------------


@query("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, count(*) FILTER (regexp_matches(text, '[\\x{4E00}-\\x{9FFF}]')) AS han FROM conversations GROUP BY 1")
def conversation_roles(spark, sf_dir):
    c = T.table(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.count_if(S.contains_han(F.col("text"))).alias("han"))


@query(f"""
WITH {_C[:-2]}
SELECT a.gid, round(sum(exp(((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) / -2)), 6) AS overlap FROM c a JOIN c b ON a.gid = b.gid AND a.type = b.type
WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 20.25 GROUP BY 1
""")
def self_overlaps(spark, sf_dir):
    """Typed Gaussian self overlap by the kernel."""
    from cairnrank.operators import overlay

    return overlay.self_overlaps(overlay.nested(T.clouds(spark, sf_dir))).withColumn("overlap", F.round("overlap", 6))


@query(f"""
WITH {_C[:-2]}
SELECT gid, """ + ", ".join(f"(min({c}) + max({c})) / 2 AS mid_{c}, CAST(ceil((max({c}) - min({c})) / 2 + 5) AS BIGINT) AS half_{c}" for c in "xyz") + " FROM c GROUP BY 1")
def cloud_boxes(spark, sf_dir):
    from cairnrank.operators import overlay

    return overlay.boxes(T.clouds(spark, sf_dir))


@query(f"WITH {_C[:-2]} SELECT gid, idx, 1.5::DOUBLE / count(*) OVER (PARTITION BY gid, type) AS share FROM c")
def split_weights(spark, sf_dir):
    from cairnrank.operators import overlay

    return overlay.split_weights(T.clouds(spark, sf_dir).withColumn("w", F.lit(1.5)), ["gid", "type"], "w").select("gid", "idx", "share")


@query(f"""
WITH {_C[:-2]}
SELECT gid, idx, CAST(round_even((x - 1) * 100, 0) AS SMALLINT) AS qx, CAST(round_even((y - 1) * 100, 0) AS SMALLINT) AS qy, round(1 + round_even((z - 1) * 100, 0) / 100, 6) AS back_z FROM c
""")
def quantised_points(spark, sf_dir):
    c, one = T.clouds(spark, sf_dir), F.lit(1.0)
    q = lambda k: S.quantised(F.col(k), one)
    return c.select("gid", "idx", q("x").alias("qx"), q("y").alias("qy"), F.round(S.dequantised(q("z"), one), 6).alias("back_z"))


@query(f"""
WITH {_C[:-2]}
SELECT a.gid, round(degrees(acos(greatest(-1, least(1, (a.x * b.x + a.y * b.y + a.z * b.z) / sqrt((a.x ** 2 + a.y ** 2 + a.z ** 2) * (b.x ** 2 + b.y ** 2 + b.z ** 2)))))), 5) AS angle
FROM c a JOIN c b ON a.gid = b.gid AND a.idx = 0 AND b.idx = 1
""")
def feature_angles(spark, sf_dir):
    c = T.clouds(spark, sf_dir)
    a, b = (c.filter(F.col("idx") == k).select("gid", *[F.col(x).alias(f"{x}{k}") for x in "xyz"]) for k in (0, 1))
    return a.join(b, "gid").select("gid", F.round(S.angle(*[F.col(f"{x}{k}") for k in (0, 1) for x in "xyz"]), 5).alias("angle"))


@query(f"""
WITH {_C} p AS (SELECT gid AS task, idx, x, y, z FROM c WHERE gid > 0), r AS (SELECT x, y, z FROM c WHERE gid = 0),
d AS (SELECT task, idx, min(sqrt((p.x - r.x) ** 2 + (p.y - r.y) ** 2 + (p.z - r.z) ** 2)) AS d FROM p, r GROUP BY 1, 2)
SELECT task, count(*) AS points, count(*) FILTER (d <= 1.2) / count(*)::DOUBLE AS near_fraction, round(min(CASE WHEN d <= 1.2 THEN d END), 6) AS least_distance,
  count(*) FILTER (d < 0.8) AS close, count(*) FILTER (d < 0.5) AS severe FROM d GROUP BY 1
""")
def pose_checks(spark, sf_dir):
    """Every cloud's points against cloud 0 as pocket and ligand."""
    from cairnrank.operators import structures

    c = T.clouds(spark, sf_dir)
    pocket = c.filter("gid = 0").select("x", "y", "z")
    return structures.pose_checks(c.filter("gid > 0").withColumnRenamed("gid", "task"), pocket, pocket, 1.2, 0.8, 0.5).withColumn("least_distance", F.round("least_distance", 6))


# --- registry ------------------------------------------------------------------------------------------------------


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def current_states(spark, sf_dir):
    """Each user's last event."""
    from cairnrank.operators import registry

    e = T.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return registry.current(e, "user_id", ["ts", "event_id"])


@query("SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS accepted FROM events")
def first_locks(spark, sf_dir):
    from cairnrank.operators import registry

    locks = T.table(spark, sf_dir, "events").withColumn("lock", F.struct("user_id", "event_type"))
    return registry.first_locks(locks, "lock", ["ts", "event_id"]).select("user_id", "event_type", "event_id", "accepted")


@query("SELECT l_partkey, l_suppkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS digests FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) > 1")
def conflicting_records(spark, sf_dir):
    from cairnrank.operators import registry

    return registry.conflicting_records(T.table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], "l_returnflag").withColumn("digests", F.array_join("digests", ","))


@query("""
WITH m AS (SELECT CAST(l_linenumber AS VARCHAR) AS variant, count(*) AS runs, median(l_quantity) AS seconds FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
SELECT variant, runs, seconds, (SELECT seconds FROM m WHERE variant = '1') / seconds AS speedup FROM m
""")
def benchmark_speedups(spark, sf_dir):
    from cairnrank.operators import registry

    rows = T.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("string").alias("variant"), F.col("l_quantity").alias("seconds"), (F.col("l_returnflag") == "N").alias("eligible"))
    return registry.speedups(rows, "1")


@query("""
WITH s AS (SELECT l_linenumber AS setting, l_suppkey, min(l_quantity) AS v FROM lineitem GROUP BY 1, 2), q AS (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem)
SELECT min(setting) AS setting FROM (SELECT setting FROM s GROUP BY 1 HAVING count(*) = (SELECT n FROM q) AND min(v) >= 1)
""")
def chosen_setting(spark, sf_dir):
    from cairnrank.operators import registry

    rows = T.table(spark, sf_dir, "lineitem")
    n = rows.select("l_suppkey").distinct().count()
    runs = rows.groupBy(F.col("l_linenumber").alias("setting"), F.col("l_suppkey").alias("query_id")).agg(F.min("l_quantity").alias("v"))
    return registry.chosen_setting(runs, "setting", "v", n, 1.0)


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS rows FROM events GROUP BY 1, 2")
def json_columns(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("rows"))


@query("""
WITH t AS (SELECT o_orderkey AS task, o_custkey AS owner, o_orderstatus AS status FROM orders), a AS (SELECT o_orderkey AS task, CASE WHEN o_orderkey % 4 = 0 THEN 'viewer' ELSE 'owner' END AS role FROM orders WHERE o_custkey % 10 < 7)
SELECT status, count(*) AS tasks FROM t JOIN a USING (task) WHERE role <> 'viewer' GROUP BY 1
""")
def accessible_tasks(spark, sf_dir):
    from cairnrank.operators import registry

    o = T.table(spark, sf_dir, "orders")
    tasks = o.select(F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("status"))
    access = o.filter("o_custkey % 10 < 7").select(F.col("o_orderkey").alias("task_id"), F.lit("u").alias("user_id"), F.when(F.col("o_orderkey") % 4 == 0, "viewer").otherwise("owner").alias("role"))
    return registry.accessible(tasks, access, "u", True).groupBy("status").agg(F.count("*").alias("tasks"))


from cairnrank.plans import reviews, screens  # noqa: E402, F401 - more queries, which use what stands above
