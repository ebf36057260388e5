"""Derived indexes on rows given inline, which the driver's corpus cannot exercise; both engines read the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.operators import evidence_index as I
from tarnwick.queries import registry_sql as S
from tarnwick.queries.registry import query
from tarnwick.sources import corpus as C

c = F.col


@query("r4_authority_adjust", "R4", "R11", sql=f"""WITH {S.CANDIDATES}, {S.CHUNKS}, x AS (SELECT qid, chunk_key, coalesce(vector_score, 0) AS s, authority_sensitive AS a, CASE content_type WHEN 'list' THEN 'current_explicit' WHEN 'table_row' THEN 'superseded_explicit' WHEN 'figure' THEN 'historical_appended' ELSE 'unknown' END AS st FROM candidates JOIN query_plans USING (qid) JOIN (SELECT chunk_key, content_type FROM chunks) USING (chunk_key))
SELECT qid, chunk_key, st AS status, round(CASE WHEN st LIKE 'current%' THEN least(1.0, s + CASE WHEN a THEN 0.16 ELSE 0.12 END) WHEN st LIKE 'superseded%' THEN greatest(0.0, s - 0.45) WHEN st = 'historical_appended' THEN greatest(0.0, s - 0.30) ELSE s END, 6) AS score FROM x""")
def r4_authority_adjust(spark, d):
    rows = C.candidates(spark, d).join(C.plans(spark, d).select("qid", "authority_sensitive"), "qid").join(C.chunks(spark, d, "content_type"), "chunk_key")
    kind = c("content_type")  # stands in for the status, which the corpus does not hold
    status = F.when(kind == "list", "current_explicit").when(kind == "table_row", "superseded_explicit").when(kind == "figure", "historical_appended").otherwise("unknown")
    score = T.authority_adjust(F.coalesce("vector_score", F.lit(0.0)), c("status"), c("authority_sensitive"), F.lit(None).cast("int"))
    return rows.withColumn("status", status).select("qid", "chunk_key", "status", F.round(score, 6).alias("score"))
