"""Role discovery over vectors: centroids, nearest centres, similar pairs and cluster quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.vectors import cosine
from quillspark.operators import clusters, density, metrics
from quillspark.operators.text import top
from quillspark.plans.registry import query, table

_C = """
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
c AS (SELECT label, list(m ORDER BY i) AS centroid FROM (SELECT label, i, avg(x) AS m FROM u GROUP BY label, i) GROUP BY label),
n AS (SELECT vec_id, e.label, c.label AS centre, list_dot_product(v, centroid) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(centroid, centroid))) AS sim FROM e, c),
b AS (SELECT vec_id, label, centre AS nearest, sim FROM n QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, centre) = 1)
"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.centroids(_vectors(spark, sf_dir), "label", "embedding")


@query(f"WITH {_C} SELECT label, i AS at, round(x, 6) AS mean FROM (SELECT label, unnest(centroid) AS x, generate_subscripts(centroid, 1) AS i FROM c)")
def centroid_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _centres(spark, sf_dir).select("label", F.posexplode("centroid").alias("at", "x"))
    return flat.select("label", (F.col("at") + 1).cast("long").alias("at"), F.round("x", 6).alias("mean"))


@query(f"WITH {_C} SELECT vec_id, nearest, round(sim, 6) AS similarity FROM b")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters.nearest(_vectors(spark, sf_dir), "vec_id", "embedding", _centres(spark, sf_dir), "label")
    return found.select("vec_id", "nearest", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_C} SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(sim, 9) DESC, vec_id) AS rank FROM n WHERE label = centre QUALIFY rank <= 3")
def central_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _vectors(spark, sf_dir).join(_centres(spark, sf_dir), "label")
    scored = joined.select("label", "vec_id", F.round(cosine(F.col("embedding"), F.col("centroid")), 9).alias("sim"))
    return top(scored, ["label"], [F.desc("sim"), F.asc("vec_id")], 3).drop("sim")


@query(
    f"WITH {_C} SELECT round(1 - max(list_dot_product(x.centroid, y.centroid) / (sqrt(list_dot_product(x.centroid, x.centroid)) * sqrt(list_dot_product(y.centroid, y.centroid)))), 6) AS separation FROM c x, c y WHERE x.label < y.label"
)
def cluster_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.separation(_centres(spark, sf_dir), "label").select(F.round("separation", 6).alias("separation"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT x.vec_id AS a, y.vec_id AS b, round(list_dot_product(x.v, y.v), 6) AS similarity FROM e x JOIN e y ON x.vec_id < y.vec_id WHERE list_dot_product(x.v, y.v) >= 0.45""")
def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs at cosine 0.45 or more (the vectors have length one; none here comes near the 0.85 of dedup)."""
    found = clusters.similar_pairs(_vectors(spark, sf_dir), "vec_id", "embedding", 0.45)
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query()
def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaders at cosine 0.45 over all vectors; tests hold it against a loop over all rows."""
    rows = _vectors(spark, sf_dir).select("vec_id", (F.col("vec_id") % 7).alias("frequency"), "embedding")
    return clusters.greedy_leaders(rows, "vec_id", "frequency", "embedding", 0.45)


@query()
def density_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors by density, named by their least vector, -1 for noise; tests hold them against a brute-force tree."""
    found = density.clustered(_vectors(spark, sf_dir), "vec_id", "embedding", least=3, samples=2)
    return found.select("vec_id", F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"), F.round("probability", 6).alias("probability"))


@query()
def title_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as titles: their roles by density, with the three titles nearest to each centroid."""
    from quillspark.config import Config
    from quillspark.plans import phases

    _, found = phases.roles(table(spark, sf_dir, "part").select(F.col("p_name").alias("title")), Config(min_cluster_size=4, cluster_epsilon=0.0))
    return found.select("role", "member_count", F.array_join("top_titles", "; ").alias("titles"), "noise_flag")


@query()
def reclustering_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far clusters of subsamples agree with the labels; tests hold the draws against brute force."""
    return density.stability(_vectors(spark, sf_dir), "vec_id", "label", "embedding", draws=20, least=3)


@query()
def label_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far three labellings of the vectors agree over draws: the labels, the nearest centroid, the strongest component."""
    near = clusters.nearest(_vectors(spark, sf_dir), "vec_id", "embedding", _centres(spark, sf_dir), "label").select("vec_id", "nearest")
    strongest = F.array_position("embedding", F.array_max("embedding"))
    rows = _vectors(spark, sf_dir).join(near, "vec_id").withColumn("strongest", strongest)
    return metrics.bootstrapped_rand(rows, "vec_id", ["label", "nearest", "strongest"])


@query(
    f"""WITH {_C}, k AS (SELECT label, nearest, count(*) AS n FROM b GROUP BY 1, 2),
t AS (SELECT sum(n * (n - 1) / 2.0) AS both_, sum(n) AS total FROM k), x AS (SELECT sum(s * (s - 1) / 2.0) AS a FROM (SELECT sum(n) AS s FROM k GROUP BY label)), y AS (SELECT sum(s * (s - 1) / 2.0) AS b FROM (SELECT sum(n) AS s FROM k GROUP BY nearest))
SELECT round((both_ - a * b / (total * (total - 1) / 2.0)) / ((a + b) / 2 - a * b / (total * (total - 1) / 2.0)), 6) AS ari FROM t, x, y"""
)
def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters.nearest(_vectors(spark, sf_dir), "vec_id", "embedding", _centres(spark, sf_dir), "label")
    both = _vectors(spark, sf_dir).select("vec_id", "label").join(found, "vec_id")
    return metrics.adjusted_rand(both, "label", "nearest").select(F.round("ari", 6).alias("ari"))


@query(
    f"""WITH {_C}, s AS (SELECT e.label, avg(list_distance(v, centroid)) AS s FROM e JOIN c USING (label) GROUP BY e.label),
r AS (SELECT x.label, max((sx.s + sy.s) / list_distance(x.centroid, y.centroid)) AS r FROM c x JOIN c y ON x.label <> y.label JOIN s sx ON sx.label = x.label JOIN s sy ON sy.label = y.label GROUP BY x.label)
SELECT round(avg(r), 6) AS davies_bouldin FROM r"""
)
def davies_bouldin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.davies_bouldin(_vectors(spark, sf_dir), "label", "embedding").select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query("""WITH e AS (SELECT vec_id, CASE WHEN vec_id = 0 THEN -1 ELSE label END AS l, embedding::DOUBLE[] AS v FROM embeddings), k AS (SELECT * FROM e WHERE l <> -1),
d AS (SELECT x.vec_id, x.l, y.l AS o, sum(list_distance(x.v, y.v)) AS s, count(*) AS n FROM k x, k y GROUP BY 1, 2, 3),
i AS (SELECT vec_id, max(CASE WHEN l = o THEN n END) AS own, max(CASE WHEN l = o AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN l <> o THEN s / n END) AS b FROM d GROUP BY vec_id)
SELECT round(avg(CASE WHEN own = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, (SELECT count(DISTINCT l) FROM k) AS n_clusters, 1::BIGINT AS n_noise FROM i""")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the labels as clusters; the first vector stands for noise."""
    rows = _vectors(spark, sf_dir).select("vec_id", F.when(F.col("vec_id") == 0, -1).otherwise(F.col("label")).alias("l"), "embedding")
    return clusters.silhouettes(rows, "vec_id", "l", "embedding").select(F.round("silhouette", 6).alias("silhouette"), "n_clusters", "n_noise")
