"""The queries opN_<name> and pipeline, with their DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import backoff_lm, block_kmeans, byte_cnn, chat_format, errata_trie, gif, hash_tree, html_blocks, langid, lz_fingerprint, minhash, mixing, packing
from quillspark.llm.sampling import remainder
from quillspark.llm.tables import table


def op1_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.with_next(table(spark, sf_dir, "documents"))


def op2_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extracted(table(spark, sf_dir, "pages"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.k + y.k - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(c) AS c FROM r GROUP BY node)
SELECT doc_id, coalesce(k, 0)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept
FROM documents JOIN m ON m.node = doc_id LEFT JOIN n USING (doc_id)
"""


def op5_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.place(table(spark, sf_dir, "documents"), hash_tree.tree(16))


def op7_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 5) == 1
    scores = backoff_lm.scored(table(spark, sf_dir, "documents"), ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.trained(docs, remainder(F.col("doc_id"), 3) != 1)
    return langid.predicted(docs, model).select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op6_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digests(gif.stored(table(spark, sf_dir, "documents")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = byte_cnn.trained(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    held_out = (remainder(F.col("doc_id"), 5) == 0).alias("held_out")
    return byte_cnn.scored(docs, network).select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

def op11_errata_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errata_trie.variants(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE
crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
o AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS k FROM o WHERE length(run) >= 6 GROUP BY ALL),
b AS (SELECT run, k, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 + (unicode(c) >> 6))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END)) AS bytes FROM r),
h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM b, crc),
s AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, k FROM h),
w AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM s WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
wild AS (SELECT word, n, i, substr(word, 1, i - 1) || '?' || substr(word, i + 1) AS pattern FROM p),
cut AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS shorter FROM p),
near AS (SELECT x.word, y.word AS other, y.n AS other_n FROM wild x JOIN wild y USING (i, pattern) WHERE x.word <> y.word
         UNION ALL SELECT cut.word, w.word, w.n FROM cut JOIN w ON shorter = w.word UNION ALL SELECT w.word, cut.word, cut.n FROM cut JOIN w ON shorter = w.word),
best AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
f AS (SELECT w.word, w.n, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n, coalesce(n_near, 0)::BIGINT AS n_near FROM w LEFT JOIN best USING (word)),
way AS (SELECT word, word AS at FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, way.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN way USING (word) JOIN f l ON l.word = way.at WHERE l.form IS NULL
"""


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = r"\### Assistant: </turn> ok"
    number, role = F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), number.alias("turn"), role.alias("role"), F.lit(own).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat_format.digests(chat_format.formatted(rows))


OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
p AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY k) <> role, true) AS opens,
        length(replace(replace(replace(replace(text, '\', '\\'), '<turn>', '\<turn>'), '<part>', '\<part>'), '</turn>', '\</turn>')) AS escaped,
        length(replace(replace(role, '%', '%25'), chr(10), '%0A')) AS named FROM o)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(escaped + CASE WHEN opens THEN 6 + named + 1 + 9 ELSE 8 END)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""


def op13_block_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_kmeans.clustered(table(spark, sf_dir, "embeddings")).drop("n_exact")


_ROUND = """
a{i} AS MATERIALIZED (SELECT vec_id, v, k, d FROM (SELECT vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i})
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1),
s{i} AS (SELECT k, i, sum(v[i])::HUGEINT AS t, count(*) AS n FROM a{i}, range(1, 65) r(i) GROUP BY k, i),
m{i} AS (SELECT k, list(((t - ((t % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{i} GROUP BY k),
c{j} AS MATERIALIZED (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k)),
"""
OP13_SQL = (
    """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, v AS c FROM v QUALIFY k < 16),
"""
    + "".join(_ROUND.format(i=i, j=i + 1) for i in range(4))
    + """
f AS (SELECT vec_id, k, d FROM a3)
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c3.c, ',')) AS centroid_sha256
FROM f JOIN c3 USING (k)
"""
)



def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_lz_fingerprint, op2_html_blocks, op3_minhash, op4_language, op5_hash_tree, op6_gif, op7_backoff_lm,
        op8_mixing, op9_packing, op10_quality, op11_errata_trie, op12_chat_format, op13_block_kmeans,
    )
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op3_minhash": OP3_SQL, "op11_errata_trie": OP11_SQL, "op12_chat_format": OP12_SQL, "op13_block_kmeans": OP13_SQL}
