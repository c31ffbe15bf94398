"""Queries of the plan of a library's moves."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirework.operators import moves
from quirework.plans.registry import query

# Folders f<id>, ten to a block: four in a chain that ends at a free place, two that change places, three in a ring, one that wants the same place as one of every other block. That place is
# lived in, and so are some of its numbers.
_DEST = """CASE WHEN doc_id % 10 < 3 OR doc_id % 10 IN (4, 6, 7) THEN concat('f', doc_id + 1) WHEN doc_id % 10 = 3 THEN concat('free', doc_id) WHEN doc_id % 10 = 5 THEN concat('f', doc_id - 1)
WHEN doc_id % 10 = 8 THEN concat('f', doc_id - 2) ELSE 'hot' END"""
_TAKEN = "doc_id % 50 = 0"
_D_WANTED = f"""WITH RECURSIVE w AS (SELECT doc_id AS pos, concat('f', doc_id) AS source, {_DEST} AS dest FROM documents), there AS (SELECT source AS path FROM w UNION SELECT 'hot' UNION SELECT concat('hot (dup ', 3 * (doc_id // 50) + 1, ')') FROM documents WHERE {_TAKEN}),
stays AS (SELECT path FROM there EXCEPT SELECT source FROM w), cl AS (SELECT w.*, row_number() OVER (PARTITION BY dest ORDER BY pos) - CASE WHEN dest IN (SELECT path FROM stays) THEN 0 ELSE 1 END AS k FROM w),
gaps AS (SELECT n, row_number() OVER (ORDER BY n) AS k FROM range(1, (SELECT 3 + 2 * count(*) FROM documents)) t(n) WHERE concat('hot (dup ', n, ')') NOT IN (SELECT path FROM there)),
fin AS (SELECT pos, source, CASE WHEN cl.k = 0 THEN dest ELSE concat(dest, ' (dup ', gaps.n, ')') END AS final, CASE WHEN cl.k = 0 THEN 'moved' ELSE 'collision_renamed' END AS action FROM cl LEFT JOIN gaps ON cl.k = gaps.k AND cl.k > 0)"""
D_PLAN = _D_WANTED + """, nx AS (SELECT a.pos, b.pos AS nxt FROM fin a LEFT JOIN fin b ON a.final = b.source),
chain AS (SELECT pos, 0 AS depth FROM nx WHERE nxt IS NULL UNION ALL SELECT nx.pos, depth + 1 FROM chain JOIN nx ON nx.nxt = chain.pos),
ring AS (SELECT * FROM nx WHERE pos NOT IN (SELECT pos FROM chain)), walk AS (SELECT pos AS start, nxt AS here FROM ring UNION SELECT start, r.nxt FROM walk JOIN ring r ON r.pos = walk.here),
led AS (SELECT start AS pos, min(here) AS leader, count(*) AS size FROM walk GROUP BY start), back AS (SELECT pos, 0 AS depth FROM led WHERE pos = leader UNION ALL SELECT r.pos, depth + 1 FROM back JOIN ring r ON r.nxt = back.pos JOIN led ON led.pos = r.pos WHERE r.pos <> led.leader),
st AS (SELECT pos, depth AS step FROM chain UNION ALL SELECT b.pos, CASE WHEN b.depth = 0 THEN led.size ELSE b.depth END FROM back b JOIN led USING (pos))
SELECT fin.pos, CAST(step AS BIGINT) AS step, CASE WHEN fin.pos IN (SELECT leader FROM led) THEN concat(source, '.moving') ELSE source END AS source, final AS dest, action FROM fin JOIN st USING (pos)
UNION ALL SELECT pos, CAST(0 AS BIGINT), source, concat(source, '.moving'), 'set_aside' FROM fin WHERE pos IN (SELECT leader FROM led)"""


def _moves(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    wanted = d.selectExpr("doc_id AS pos", "concat('f', doc_id) AS source", f"{_DEST} AS dest")
    numbered = d.where(_TAKEN).selectExpr("concat('hot (dup ', 3 * (doc_id div 50) + 1, ')') AS path")
    existing = wanted.select(F.col("source").alias("path")).unionByName(numbered).unionByName(d.selectExpr("'hot' AS path").limit(1))
    return wanted, existing


@query(D_PLAN)
def move_plan(spark, sf_dir):
    """All moves of a library with their places and their order: chains, rings and a place that a tenth of all records want."""
    return moves.plan(*_moves(spark, sf_dir)).select("pos", "step", "source", "dest", "action")


@query("SELECT 0 AS meets")
def move_plan_conflicts(spark, sf_dir):
    """The plan carried out in thought: how often a move would meet a place that is taken at its step."""
    wanted, existing = _moves(spark, sf_dir)
    p = moves.written(moves.plan(wanted, existing), "plan").where("step IS NOT NULL")
    # a place is taken from when something comes there, or from the outset, until what was there has gone
    comes = p.select(F.col("dest").alias("path"), "step").unionByName(existing.distinct().select("path", F.lit(-1).cast("long").alias("step")))
    goes = p.select(F.col("source").alias("path"), F.col("step").alias("gone"))
    at = comes.join(goes, "path", "left").where("gone IS NULL OR gone > step").groupBy("path", "step").agg(F.min("gone").alias("gone"))
    arrivals = p.select(F.col("dest").alias("path"), F.col("step").alias("now"))
    return arrivals.join(at, "path").where("step < now AND (gone IS NULL OR gone >= now)").agg(F.count("*").cast("int").alias("meets"))
