"""Protocol corpus and retrieval queries."""

from pyspark.sql import functions as F

from caretide.functions import vectors as X
from caretide.operators import metric_index as M, retrieval as R, screening
from caretide.plans.inputs import ctes, load
from caretide.plans.registry import at, query
from caretide.sources import protocols as P
from caretide.sources.tables import table

_AS_OF = "2024-07-01"
_live = f"live AS (SELECT * FROM protocols WHERE expiry_date IS NULL OR expiry_date > TIMESTAMP '{_AS_OF}')"
_queries = "queries AS (SELECT concat('q-', CAST(vec_id AS STRING)) AS query_id, embedding AS q FROM embeddings)"
_similarity = "round(1 - (1 - list_cosine_similarity(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 12)"


def _query_vectors(spark, d):
    return table(spark, d, "embeddings").selectExpr("concat('q-', CAST(vec_id AS STRING)) AS query_id", "embedding")


_retrieved = f"""{ctes('protocols')}, {_live}, {_queries},
r AS (SELECT query_id, id, title, content, source_type, specialty, {_similarity} AS s,
  row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN source_type = 'hospital_curated' THEN 0 ELSE 1 END, {_similarity} DESC, id) AS rank FROM queries, live)
SELECT query_id, CAST(rank AS INT) AS rank, id, title, content, source_type, specialty, round(s, 6) AS similarity FROM r WHERE rank <= 5"""


@query("retrieve", _retrieved)
def retrieve(spark, d):
    """Every vector queries the whole live corpus."""
    out = R.retrieve(_query_vectors(spark, d), load(spark, d, "protocols"), at(_AS_OF))
    return out.withColumn("similarity", F.round("similarity", 6))


@query("retrieve_pruned", _retrieved)
def retrieve_pruned(spark, d):
    """The same by pivots and the triangle inequality, leaving out what cannot be among the first."""
    live = screening.filter_not_expired(load(spark, d, "protocols"), at(_AS_OF)).withColumn("layer", R.layer_of(F.col("source_type")))
    index = M.build(live)
    top, _ = M.search(_query_vectors(spark, d), index, 5)
    index[0].unpersist()
    return R.with_details(top, live).withColumn("similarity", F.round("similarity", 6))


@query(
    "expand_layered",
    f"""{ctes('protocols')}, {_live}, {_queries},
c AS (SELECT query_id, id, 0 AS layer, {_similarity} AS s FROM queries, live WHERE source_type = 'hospital_curated' AND hospital_id = 'h-3' AND specialty = 'emergency_medicine'),
p AS (SELECT query_id, id, 1 AS layer, {_similarity} AS s FROM queries, live WHERE source_type = 'fhir_public' AND specialty = 'emergency_medicine'),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY layer, s DESC, id) AS rank FROM (SELECT * FROM c UNION ALL SELECT * FROM p))
SELECT query_id, CAST(rank AS INT) AS rank, id, layer, round(s, 6) AS similarity FROM r WHERE rank <= 5""",
)
def expand_layered(spark, d):
    """Curated protocols of one hospital and specialty, back-filled with public ones."""
    live = screening.filter_not_expired(load(spark, d, "protocols"), at(_AS_OF))
    specialty, queries = F.lit("emergency_medicine"), _query_vectors(spark, d)
    curated = screening.protocol_scope(live.filter("source_type = 'hospital_curated'"), F.lit("h-3"), specialty)
    public = live.filter("source_type = 'fhir_public'").filter(F.col("specialty") == specialty)
    top = R.nearest(queries, R.layered_union(*(p.select("id", "embedding") for p in (curated, public))), 5)
    return top.select("query_id", "rank", "id", "layer", F.round(1 - F.col("distance"), 6).alias("similarity"))


@query("layered_union", f"{ctes('protocols')} SELECT CASE WHEN source_type = 'hospital_curated' THEN 0 ELSE 1 END AS layer, id FROM protocols")
def layered_union(spark, d):
    df = load(spark, d, "protocols").select("id", "source_type")
    out = R.layered_union(df.filter("source_type = 'hospital_curated'"), df.filter("source_type = 'fhir_public'"))
    return out.select("layer", "id")


@query("protocol_scope", f"{ctes('protocols')} SELECT id FROM protocols WHERE hospital_id = 'h-1' AND specialty = 'cardiology'")
def protocol_scope(spark, d):
    return screening.protocol_scope(load(spark, d, "protocols"), F.lit("h-1"), F.lit("cardiology")).select("id")


@query("filter_not_expired", f"{ctes('protocols')}, {_live} SELECT id, CAST(expiry_date AS STRING) AS expiry_date FROM live")
def filter_not_expired(spark, d):
    out = screening.filter_not_expired(load(spark, d, "protocols"), at(_AS_OF))
    return out.select("id", F.col("expiry_date").cast("string").alias("expiry_date"))


@query("cosine_distance", f"{ctes('protocols')} SELECT id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_reverse(CAST(embedding AS DOUBLE[]))), 6) AS distance FROM protocols")
def cosine_distance(spark, d):
    v = F.col("embedding")
    return load(spark, d, "protocols").select("id", F.round(X.cosine_distance(v, F.reverse(v)), 6).alias("distance"))


def _sum(column: str):
    return F.round(F.aggregate(column, F.lit(0.0), lambda a, x: a + x.cast("double")), 4)


@query(
    "normalize_dim",
    f"{ctes('protocols')} SELECT id, 100 AS padded_size, 40 AS cut_size, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS padded_sum, round(list_sum(CAST(embedding[1:40] AS DOUBLE[])), 4) AS cut_sum FROM protocols",
)
def normalize_dim(spark, d):
    df = load(spark, d, "protocols").select("id", "embedding")
    df = df.select("id", X.normalize_dim(F.col("embedding"), 100).alias("padded"), X.normalize_dim(F.col("embedding"), 40).alias("cut"))
    return df.select("id", F.size("padded").alias("padded_size"), F.size("cut").alias("cut_size"), _sum("padded").alias("padded_sum"), _sum("cut").alias("cut_sum"))


@query("redim_embeddings", f"{ctes('protocols')} SELECT id, 1024 AS size FROM protocols")
def redim_embeddings(spark, d):
    return P.redim_embeddings(load(spark, d, "protocols"), 1024).select("id", F.size("embedding").alias("size"))


def _some_missing(spark, d):
    """Protocols whose vector is absent or still the zero placeholder for some labels."""
    df = table(spark, d, "embeddings")
    vector = F.when(F.col("label") == 1, F.lit(None).cast("array<float>")).when(F.col("label") == 2, X.zero_vector(64)).otherwise(F.col("embedding"))
    return df.select(F.concat(F.lit("p-"), "vec_id").alias("id"), "label", vector.alias("embedding"))


@query("missing_embeddings", f"SELECT concat('p-', CAST(vec_id AS STRING)) AS id FROM embeddings WHERE label IN (1, 2)")
def missing_embeddings(spark, d):
    return P.missing_embeddings(_some_missing(spark, d)).select("id")


@query("write_embeddings", "SELECT concat('p-', CAST(vec_id AS STRING)) AS id, CASE WHEN label = 1 THEN NULL WHEN label = 2 THEN round(list_sum(CAST(embedding AS DOUBLE[])), 4) ELSE round(list_sum(CAST(embedding AS DOUBLE[])), 4) END AS total FROM embeddings")
def write_embeddings(spark, d):
    made = table(spark, d, "embeddings").filter("label <> 1").select(F.concat(F.lit("p-"), "vec_id").alias("id"), "embedding")
    out = P.write_embeddings(_some_missing(spark, d), made)
    return out.select("id", _sum("embedding").alias("total"))


@query("embedding_fallback", "SELECT concat('p-', CAST(vec_id AS STRING)) AS id, CASE WHEN label = 1 THEN 'secondary' ELSE 'primary' END AS provider FROM embeddings")
def embedding_fallback(spark, d):
    df = _some_missing(spark, d).withColumns({"first": F.col("embedding"), "second": X.zero_vector(3)})
    out = P.embedding_fallback(df, "first", "second")
    return out.select("id", F.when(F.size("embedding") == 3, "secondary").otherwise("primary").alias("provider"))


@query("zero_vector", "SELECT concat('p-', CAST(vec_id AS STRING)) AS id, 1024 AS size, 0.0 AS total FROM embeddings")
def zero_vector(spark, d):
    df = load(spark, d, "protocols").select("id", X.zero_vector(1024).alias("z"))
    return df.select("id", F.size("z").alias("size"), _sum("z").alias("total"))


@query("scan_protocols", f"{ctes('protocols')} SELECT id, title, content FROM protocols ORDER BY id")
def scan_protocols(spark, d):
    return P.scan_protocols(load(spark, d, "protocols"))


@query(
    "seed_protocols",
    f"""{ctes('protocols')}, seeds AS (SELECT title, CAST(1 + version % 3 AS INT) AS version FROM protocols UNION ALL SELECT title, version FROM protocols)
SELECT title, version FROM protocols UNION ALL SELECT title, version FROM seeds s WHERE NOT EXISTS (SELECT 1 FROM protocols p WHERE p.title = s.title AND p.version = s.version)""",
)
def seed_protocols(spark, d):
    existing = load(spark, d, "protocols").select("id", "title", "version")
    seeds = existing.withColumn("version", (1 + F.col("version") % 3).cast("int")).unionByName(existing)
    return P.seed_protocols(existing, seeds).select("title", "version")


@query("delete_seed", f"{ctes('protocols')} SELECT id FROM protocols WHERE NOT coalesce(effective_date = DATE '2024-01-01' AND version = 1, false)")
def delete_seed(spark, d):
    return P.delete_seed(load(spark, d, "protocols")).select("id")
