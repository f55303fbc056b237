"""Vector and text check queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.keyed import cut_lineage
from tidewatch.functions.scalars import sanitize_field
from tidewatch.operators import vectors as V
from tidewatch.plans.model import events, query, table, with_ne

# Every vector is a probe.
PROBES = "pe AS (SELECT vec_id AS query_id, embedding FROM embeddings)"


def knn_sql(k: int, where: str = "true") -> str:
    return f"""near AS (SELECT query_id, vec_id AS id, 1 - list_cosine_similarity(CAST(pe.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS distance, label,
  row_number() OVER (PARTITION BY query_id ORDER BY 1 - list_cosine_similarity(CAST(pe.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), vec_id) AS rank
  FROM pe, embeddings e WHERE {where} QUALIFY rank <= {k})"""


def probes(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


@query("vec1_nearest", f"WITH {PROBES}, {knn_sql(10)} SELECT query_id, id, round(distance, 6) AS distance, rank FROM near")
def vec1(spark, sf):
    return V.nearest(table(spark, sf, "embeddings"), probes(spark, sf), 10).withColumn("distance", F.round("distance", 6))


@query("vec1_nearest_filtered", f"WITH {PROBES}, {knn_sql(5, 'label >= 5')} SELECT query_id, id, round(distance, 6) AS distance, rank FROM near")
def vec1b(spark, sf):
    return V.nearest(table(spark, sf, "embeddings").filter("label >= 5"), probes(spark, sf), 5, query_block=100).withColumn("distance", F.round("distance", 6))


@query("vec2_upsert_vectors", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label, len(embedding) AS dims FROM embeddings")
def vec2(spark, sf):
    e = table(spark, sf, "embeddings")
    return V.upsert_vectors(e, e.filter("vec_id % 3 = 0").withColumn("label", F.col("label") + 100)).select("vec_id", "label", F.size("embedding").alias("dims"))


@query("vec3_rerank", f"""WITH {PROBES}, {knn_sql(10)} SELECT query_id, id, rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN id % 4 <> 0 THEN (id * 7) % 13 END DESC NULLS LAST, rank) AS new_rank
FROM near QUALIFY new_rank <= 4""")
def vec3(spark, sf):
    near = cut_lineage(V.nearest(table(spark, sf, "embeddings"), probes(spark, sf), 10).drop("distance"))      # asked for twice
    given = near.filter("id % 4 <> 0").selectExpr("query_id", "id", "(id * 7) % 13 AS score")
    return V.rerank(near, given, 4).select("query_id", "id", "rank", "new_rank")


@query("vec3_passthrough", f"WITH {PROBES}, {knn_sql(4)} SELECT query_id, id, rank AS new_rank FROM near")
def vec3b(spark, sf):
    return V.rerank(V.nearest(table(spark, sf, "embeddings"), probes(spark, sf), 10), None, 4).select("query_id", "id", "new_rank")


@query("vec4_similar_cases", f"""WITH {PROBES}, {knn_sql(4)}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM near WHERE id <> query_id)
SELECT query_id, id, CAST(greatest(0, round_even((1 - distance) * 100, 0)) AS INT) AS similarity_pct, CASE quality WHEN 1 THEN 'TP' WHEN 0 THEN 'FP' END AS verdict
FROM o LEFT JOIN labels ON doc_id = id WHERE n <= 3""")
def vec4(spark, sf):
    verdicts = table(spark, sf, "labels").selectExpr("doc_id AS case_key", "case when quality = 1 then 'TP' else 'FP' end AS verdict")
    return V.similar_cases(table(spark, sf, "embeddings"), probes(spark, sf), verdicts)


@query("vec5_evidence_blocks", with_ne("""
SELECT case_id, string_agg('EVENT: ' || event_type || ' | process=' || coalesce(process_name, '?') || ' | host=' || hostname || ' | technique=' || coalesce(attack_technique, 'N/A'), chr(10) ORDER BY n) AS evidence,
  CAST(count(*) AS INT) AS n_events FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, timestamp, event_id) AS n
  FROM ne WHERE case_id IS NOT NULL) WHERE n <= 10 GROUP BY 1"""))
def vec5(spark, sf):
    return V.evidence_lines(events(spark, sf), "case_id")


@query("vec5_numbered_context", f"WITH {PROBES}, {knn_sql(3)} SELECT query_id, string_agg('[Evidence ' || rank || '] vector ' || id, chr(10) || chr(10) ORDER BY rank) AS context FROM near GROUP BY 1")
def vec5b(spark, sf):
    near = V.nearest(table(spark, sf, "embeddings"), probes(spark, sf), 5).withColumn("text", F.concat(F.lit("vector "), F.col("id").cast("string")))
    return V.numbered_context(near, "query_id", "rank", "text", 3)


CITED = "text || CASE conv_id % 3 WHEN 0 THEN ' see [ev-' || turn || '] and [ev-1]' WHEN 1 THEN ' see [ev-zzz]' ELSE ' [a] none' END"


@query("vec6_citation_check", f"""SELECT conv_id, turn, len(list_filter(regexp_extract_all(t, '\\[([^\\]]{{3,64}})\\]', 1), lambda c: c NOT IN ('ev-0', 'ev-1', 'ev-2'))) = 0 AS citations_ok
FROM (SELECT conv_id, turn, {CITED} AS t FROM conversations)""")
def vec6(spark, sf):
    text = F.expr("concat(text, case conv_id % 3 when 0 then concat(' see [ev-', turn, '] and [ev-1]') when 1 then ' see [ev-zzz]' else ' [a] none' end)")
    ids = F.array(*[F.lit(f"ev-{i}") for i in range(3)])
    return table(spark, sf, "conversations").select("conv_id", "turn", V.citations_valid(text, ids).alias("citations_ok"))


@query("vec7_answer_confidence", "SELECT conv_id, turn, round(CASE WHEN turn > 0 THEN 0.5 ELSE 0 END + CASE WHEN conv_id % 2 = 0 THEN 0.3 ELSE 0 END + CASE WHEN turn >= 5 THEN 0.1 ELSE 0 END, 4)::DOUBLE AS confidence FROM conversations")
def vec7(spark, sf):
    ids = F.when(F.col("turn") > 0, F.sequence(F.lit(1), F.col("turn").cast("int"))).otherwise(F.array().cast("array<int>"))
    return table(spark, sf, "conversations").select("conv_id", "turn", V.answer_confidence(ids, F.col("conv_id") % 2 == 0).alias("confidence"))


@query("vec8_evaluation_summary", """SELECT role AS model, CASE WHEN turn % 2 = 0 THEN 'even' ELSE 'odd' END AS prompt_type, count(*) AS rows, CAST(floor(avg(turn * 100)) AS BIGINT) AS avg_latency_ms,
  round(avg((CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'que') AS INT) + CAST(contains(lower(text), 'zzz') AS INT)) / 3), 2) AS avg_recall, CAST(sum(length(text)) AS BIGINT) AS total_tokens
FROM conversations GROUP BY 1, 2""")
def vec8(spark, sf):
    words = F.array(F.lit("The"), F.lit("que"), F.lit("ZZZ"))
    rows = table(spark, sf, "conversations").select(
        F.col("role").alias("model"), F.when(F.col("turn") % 2 == 0, "even").otherwise("odd").alias("prompt_type"), (F.col("turn") * 100).alias("latency_ms"),
        V.keyword_recall(F.col("text"), words).alias("keyword_recall"), F.length("text").alias("tokens"))
    return V.evaluation_summary(rows)


@query("vec9_sanitize", "SELECT doc_id, CASE WHEN length(t) > 500 THEN left(t, 500) || ' [truncated]' ELSE t END AS clean FROM (SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g') AS t FROM documents)")
def vec9(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sanitize_field(F.concat(F.lit("\x05"), "text")).alias("clean"))
