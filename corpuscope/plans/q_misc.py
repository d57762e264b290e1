"""Registered queries for history, generation, pooling, encoding, 2-D data and
the search summary (SNK-17, LIM-8, GEN-1 … 3, SET-1, EMB-1 … 4, DIM-1 … 4, AGG-3, SIM-3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.functions.text import WORD_TOKEN
from corpuscope.functions.vectors import to_double
from corpuscope.operators import encode as E
from corpuscope.operators import generate as G
from corpuscope.operators import layout2d as L
from corpuscope.operators import project2d as D
from corpuscope.operators import search as S
from corpuscope.operators import similarity as SIM
from corpuscope.operators.textstore import encode_once, shared_store
from corpuscope.plans import params as P
from corpuscope.plans.catalog import register
from corpuscope.plans.oracle_sql import (CENTROIDS, DOC_CORPUS, EMB_CORPUS, cos, hash_vectors, search_hits_sql,
                                         strip)
from corpuscope.plans.q_search import BANDS, DECISION_SQL, encoded, single_hits
from corpuscope.plans.q_similarity import prepared_corpus, prepared_documents
from corpuscope.session import materialize
from corpuscope.sources.tables import table
from corpuscope.streaming.history import recent

MODEL = "humarin/chatgpt_paraphraser_on_T5_base"
GEN_AT = "2024-01-01 00:00:00"


@register("history_recent", """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, user_id, event_type,
       value, props FROM events ORDER BY ts DESC, event_id DESC LIMIT 20""")
def q_history_recent(spark, sf):
    ev = table(spark, sf, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    r = recent(ev, 20, ["ts", "event_id"])
    return r.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "user_id",
                    "event_type", "value", "props")


_JOBS_SQL = f"""WITH {DOC_CORPUS},
sizes AS (SELECT intent, count(*) AS n FROM doc GROUP BY intent),
jobs AS (SELECT f.*, v.variation, 'paraphrase: ' || f.phrase AS prompt FROM doc f CROSS JOIN
         (SELECT CAST(unnest(range(1, 3)) AS BIGINT) AS variation) v),
gen AS (SELECT j.*, {strip("replace('paraphrased: ' || regexp_replace(regexp_replace(prompt, '^paraphrase: ', ''), ' </s>$', '') || ' (variation ' || CAST(variation AS VARCHAR) || ')', 'paraphrased: ', '')")} AS generated,
               false AS was_limited
        FROM jobs j JOIN sizes s ON s.intent = j.intent)"""


@register("paraphrase_jobs", _JOBS_SQL + f"""
SELECT intent, phrase_id, variation, prompt, generated, was_limited, 'Diverse Variations' AS strategy,
       CAST(2 AS BIGINT) AS num_variations, '{GEN_AT}' AS generated_at, '{MODEL}' AS model_used FROM gen""")
def q_paraphrase_jobs(spark, sf):
    j = G.paraphrase_jobs(prepared_documents(spark, sf), MODEL, 2, generated_at=GEN_AT)
    return j.select("intent", "phrase_id", "variation", "prompt", "generated", "was_limited", "strategy",
                    "num_variations", "generated_at", "model_used")


@register("append_generated", _JOBS_SQL + """,
last AS (SELECT intent, max(row_pos) AS last_pos FROM doc GROUP BY intent),
new AS (SELECT g.intent, l.last_pos + row_number() OVER (PARTITION BY g.intent ORDER BY g.row_pos, g.variation) AS row_pos,
               g.generated AS phrase, true AS is_generated FROM gen g JOIN last l ON l.intent = g.intent)
SELECT intent, row_pos, phrase, false AS is_generated FROM doc UNION ALL SELECT * FROM new""")
def q_append_generated(spark, sf):
    corpus = prepared_documents(spark, sf)
    gen = G.paraphrase_jobs(corpus, MODEL, 2, generated_at=GEN_AT)
    return G.append_generated(corpus, gen).select("intent", "row_pos", "phrase", "is_generated")


# token table for pooling: word tokens of each document, a signed one-hot vector of
# 8 dims (md5 bucket) per token, mask 1 for tokens longer than two characters
POOL_DIM = 8


def token_table(spark, sf):
    c = prepared_documents(spark, sf)
    t = c.select("phrase_id", F.posexplode(F.regexp_extract_all(F.lower("phrase"), F.lit(WORD_TOKEN), 0))
                 .alias("token_pos", "tok"))
    h = F.md5("tok")
    b = (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % POOL_DIM).cast("int")
    s = F.when(F.conv(F.substring("h", 9, 1), 16, 10).cast("int") < 8, F.lit(1.0)).otherwise(F.lit(-1.0))
    # bucket and sign are columns of their own, so that a token is hashed once and not for every number of its vector
    t = t.select("phrase_id", "token_pos", F.when(F.length("tok") > 2, 1).otherwise(0).alias("mask"), h.alias("h"))
    t = t.select("phrase_id", "token_pos", "mask", b.alias("b"), s.alias("s"))
    return t.select("phrase_id", "token_pos", "mask", F.array(*[
        F.when(F.col("b") == i, F.col("s")).otherwise(F.lit(0.0)) for i in range(POOL_DIM)]).alias("vec"))


_TOK_SQL = f"""WITH {DOC_CORPUS},
tl AS (SELECT phrase_id, regexp_extract_all(lower(phrase), '{WORD_TOKEN}') AS toks FROM doc),
tk AS (SELECT phrase_id, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS pos FROM tl),
tb AS (SELECT phrase_id, pos, CASE WHEN length(tok) > 2 THEN 1 ELSE 0 END AS mask,
              CAST(('0x' || substr(md5(tok), 1, 8))::BIGINT % {POOL_DIM} AS INTEGER) AS b,
              CAST(CASE WHEN ('0x' || substr(md5(tok), 9, 1))::INTEGER < 8 THEN 1 ELSE -1 END AS DOUBLE) AS s FROM tk),
dims AS (SELECT CAST(unnest(range(0, {POOL_DIM})) AS INTEGER) AS dim)"""


def _long(df, id_col="phrase_id"):
    return df.select(id_col, F.posexplode("embedding").alias("dim", "value")).select(
        id_col, F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


@register("token_mean_pool", _TOK_SQL + """,
den AS (SELECT phrase_id, sum(mask) AS m FROM tb GROUP BY phrase_id),
num AS (SELECT t.phrase_id, d.dim, sum(CASE WHEN t.b = d.dim THEN t.s * t.mask ELSE 0.0 END) AS x
        FROM tb t CROSS JOIN dims d GROUP BY ALL),
pooled AS (SELECT n.phrase_id, n.dim, n.x / greatest(d.m, 1e-9) AS v FROM num n JOIN den d ON d.phrase_id = n.phrase_id),
nrm AS (SELECT phrase_id, sqrt(sum(v * v)) AS nv FROM pooled GROUP BY phrase_id)
SELECT p.phrase_id, CAST(p.dim AS BIGINT) AS dim, round(CASE WHEN n.nv = 0 THEN 0.0 ELSE p.v / n.nv END, 6) AS value
FROM pooled p JOIN nrm n ON n.phrase_id = p.phrase_id""")
def q_token_mean_pool(spark, sf):
    return _long(E.pool(token_table(spark, sf), "mean", dim=POOL_DIM))


@register("token_cls_pool", _TOK_SQL + """,
firsttok AS (SELECT * FROM tb WHERE pos = 1)
SELECT f.phrase_id, CAST(d.dim AS BIGINT) AS dim, CASE WHEN f.b = d.dim THEN f.s ELSE 0.0 END AS value
FROM firsttok f CROSS JOIN dims d""")
def q_token_cls_pool(spark, sf):
    return _long(E.pool(token_table(spark, sf), "cls", first_pos=0))   # posexplode counts from 0


@register("l2_normalise", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS nv FROM e)
SELECT vec_id, CAST(i - 1 AS BIGINT) AS dim, round(CASE WHEN nv = 0 THEN 0.0 ELSE v[i] / nv END, 6) AS value
FROM n, (SELECT unnest(range(1, 65)) AS i) WHERE i <= len(v)""")
def q_l2_normalise(spark, sf):
    e = table(spark, sf, "embeddings", ["vec_id", "embedding"]).withColumn("embedding", to_double("embedding"))
    return _long(E.normalise(e), "vec_id")


@register("encode_hashing", f"""WITH {DOC_CORPUS}, {hash_vectors('dv', 'doc', 'phrase_id', 'phrase')}
SELECT w.id AS phrase_id, CAST(w.b AS BIGINT) AS dim, round(w.w / n.nv, 6) AS value
FROM dv_w w JOIN dv_n n ON n.id = w.id WHERE w.w <> 0""")
def q_encode_hashing(spark, sf):
    corpus, _ = encoded(spark, sf)
    return _long(corpus).where(F.col("value") != 0)


@register("encode_stored", f"""WITH {DOC_CORPUS}, {hash_vectors('dv', 'doc', 'phrase_id', 'phrase')}
SELECT w.id AS phrase_id, CAST(w.b AS BIGINT) AS dim, round(w.w / n.nv, 6) AS value
FROM dv_w w JOIN dv_n n ON n.id = w.id WHERE w.w <> 0""")
def q_encode_stored(spark, sf):
    """EMB-1 / KW-7: vectors from the store, each distinct text encoded once."""
    store = shared_store(spark, f"hashing-{P.ENCODE_DIM}-unit", "array<double>")
    return _long(encode_once(prepared_documents(spark, sf), store, E.HashingEncoder(P.ENCODE_DIM))).where(F.col("value") != 0)


@register("search_summary", DECISION_SQL + f""",
st AS (SELECT query_id, count(*) AS total, count(DISTINCT intent) AS ui FROM shown GROUP BY ALL)
SELECT q.query_id, substr(q.query, 1, 100) AS query, CAST({P.SEARCH_T} AS DOUBLE) AS threshold,
       coalesce(st.total, 0) AS total_results, coalesce(st.ui, 0) AS unique_intents,
       coalesce(printf('%.3f', round_even(d.top_similarity, 3)), 'N/A') AS top_similarity,
       coalesce(d.top_intent, 'N/A') AS top_intent,
       coalesce(printf('%d%%', CAST(round_even(d.conf * 100, 0) AS INTEGER)), 'N/A') AS confidence
FROM qry q LEFT JOIN st ON st.query_id = q.query_id LEFT JOIN dec d ON d.query_id = q.query_id""")
def q_search_summary(spark, sf):
    _, q = encoded(spark, sf)
    hits = single_hits(spark, sf)
    dec = S.single_decision(hits, BANDS)
    st = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"), F.count_distinct("intent").alias("ui"))
    j = q.select("query_id", "query").join(st, "query_id", "left").join(dec, "query_id", "left")
    return j.select(
        "query_id", F.substring("query", 1, 100).alias("query"), F.lit(P.SEARCH_T).alias("threshold"),
        F.coalesce("total", F.lit(0)).alias("total_results"), F.coalesce("ui", F.lit(0)).alias("unique_intents"),
        # format_string renders NULL as text, so the missing case is tested first
        F.when(F.col("top_similarity").isNotNull(), F.format_string("%.3f", F.bround("top_similarity", 3)))
        .otherwise(F.lit("N/A")).alias("top_similarity"),
        F.coalesce("top_intent", F.lit("N/A")).alias("top_intent"),
        F.coalesce(F.when(F.col("confidence").isNotNull(), F.format_string(
            "%d%%", F.bround(F.col("confidence") * 100, 0).cast("int"))), F.lit("N/A")).alias("confidence"))


@register("pca_2d")
def q_pca_2d(spark, sf):
    return D.pca_2d(prepared_corpus(spark, sf))


@register("pca_checks", f"""WITH {EMB_CORPUS},
dims AS (SELECT unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM emb),
spread AS (SELECT max(s) AS widest FROM (SELECT i, var_samp(x) AS s FROM dims GROUP BY i))
SELECT (SELECT count(*) FROM emb) AS phrases, true AS uncorrelated, true AS first_is_widest,
       (SELECT round(widest, 6) FROM spread) AS widest_input, true AS wider_than_inputs""")
def q_pca_checks(spark, sf):
    """What holds of the projection whatever its signs: uncorrelated coordinates, the first the widest,
    and no input coordinate wider than it."""
    corpus = prepared_corpus(spark, sf)
    xy = D.pca_2d(corpus)
    dims = corpus.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.var_samp(F.col("x").cast("double")).alias("s"))
    return xy.agg(F.count(F.lit(1)).alias("phrases"), F.corr("x", "y").alias("c"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy")) \
        .crossJoin(dims.agg(F.max("s").alias("widest"))).select(
            "phrases", (F.abs("c") < 1e-6).alias("uncorrelated"), (F.col("vx") >= F.col("vy")).alias("first_is_widest"),
            F.round("widest", 6).alias("widest_input"), (F.col("vx") >= F.col("widest")).alias("wider_than_inputs"))


@register("layout_checks", f"""WITH {EMB_CORPUS}
SELECT count(*) AS phrases, count(DISTINCT phrase_id) AS ids, true AS centred, true AS finite, true AS keeps_more_neighbours FROM emb""")
def q_layout_checks(spark, sf):
    """The neighbour layout of the whole corpus, 400 landmarks: every phrase once, landmarks centred, and
    more neighbours kept than by PCA on the same landmarks."""
    corpus = prepared_corpus(spark, sf)
    landmarks = materialize(D.landmark_sample(corpus, 400).select("phrase_id", "intent", "intent_pos", "row_pos", "phrase", "embedding"),
                            "landmarks")
    xy, graph = L.neighbour_layout(landmarks)
    kept, kept_pca = L.neighbours_kept(graph, xy), L.neighbours_kept(graph, D.pca_2d(landmarks).select("phrase_id", "x", "y"))
    placed = D.landmark_place(corpus, landmarks.select("phrase_id", "embedding").join(xy, "phrase_id"))
    every = xy.unionByName(placed.select("phrase_id", "x", "y"))
    centre = xy.agg((F.abs(F.avg("x")) + F.abs(F.avg("y")) < 1e-6).alias("centred"))
    return every.agg(F.count(F.lit(1)).alias("phrases"), F.count_distinct("phrase_id").alias("ids"),
                     (F.count_if(F.isnan("x") | F.isnan("y") | F.col("x").isNull() | F.col("y").isNull()) == 0).alias("finite")) \
        .crossJoin(centre).withColumn("keeps_more_neighbours", F.lit(kept > kept_pca)) \
        .select("phrases", "ids", "centred", "finite", "keeps_more_neighbours")


@register("layout_2d")
def q_layout_2d(spark, sf):
    """No SQL: coordinates of an iteration; ``layout_checks`` holds what must be true of them."""
    return L.layout_2d(prepared_corpus(spark, sf))


@register("landmark_sample", f"""WITH {EMB_CORPUS}
SELECT phrase_id, intent FROM emb ORDER BY md5(CAST(phrase_id AS VARCHAR) || ':42'), phrase_id LIMIT 5000""")
def q_landmark_sample(spark, sf):
    return D.landmark_sample(prepared_corpus(spark, sf), 5000).select("phrase_id", "intent")


@register("landmark_place", f"""WITH {EMB_CORPUS},
lm AS (SELECT phrase_id AS lm_id, v, nv, v[1] AS x, v[2] AS y FROM emb
       ORDER BY md5(CAST(phrase_id AS VARCHAR) || ':42'), phrase_id LIMIT 100),
pts AS (SELECT * FROM emb WHERE phrase_id NOT IN (SELECT lm_id FROM lm)),
d AS (SELECT p.phrase_id, l.lm_id, l.x, l.y, round(1 - {cos('p', 'l')}, 12) AS dist FROM pts p CROSS JOIN lm l),
near AS (SELECT *, 1.0 / (dist + 1e-8) AS w FROM d
         QUALIFY row_number() OVER (PARTITION BY phrase_id ORDER BY dist, lm_id) <= 5)
SELECT phrase_id, round(sum(w * x) / sum(w), 6) AS x, round(sum(w * y) / sum(w), 6) AS y FROM near GROUP BY phrase_id""")
def q_landmark_place(spark, sf):
    corpus = prepared_corpus(spark, sf)
    lm = D.landmark_sample(corpus, 100).select(
        "phrase_id", "embedding", F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"))
    p = D.landmark_place(corpus, lm)
    return p.select("phrase_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register("intent_matrix_wide", f"""WITH {EMB_CORPUS}, {CENTROIDS},
m AS (SELECT intent_a AS intent, intent_b, round(sim, 6) AS sim FROM matrix)
SELECT intent, {", ".join(f"max(CASE WHEN intent_b = '{n}' THEN sim END) AS {n}" for n in P.EMB_LABELS)}
FROM m GROUP BY intent""")
def q_intent_matrix_wide_sql(spark, sf):
    m = SIM.intent_matrix(SIM.intent_centroids(prepared_corpus(spark, sf)))
    m = m.withColumn("sim", F.round("sim", 6))
    return SIM.intent_matrix_wide(m, P.EMB_LABELS).drop("a_pos")


T5_MODEL = "Vamsi/T5_Paraphrase_Paws"


@register("paraphrase_jobs_t5", _JOBS_SQL.replace("'paraphrase: ' || f.phrase AS prompt",
                                                  "'paraphrase: ' || f.phrase || ' </s>' AS prompt") + f"""
SELECT intent, phrase_id, variation, prompt, generated, was_limited FROM gen""")
def q_paraphrase_jobs_t5(spark, sf):
    j = G.paraphrase_jobs(prepared_documents(spark, sf), T5_MODEL, 2, generated_at=GEN_AT)
    return j.select("intent", "phrase_id", "variation", "prompt", "generated", "was_limited")


@register("search_top10", f"""WITH {search_hits_sql(P.SEARCH_T, P.SINGLE_TOPK)}
SELECT query_id, rank, phrase_id, intent, sim FROM hits WHERE rank <= 10""")
def q_search_top10(spark, sf):
    hits = single_hits(spark, sf, include_exact=True)
    return S.first_matches(hits, 10).select("query_id", F.col("rank").cast("bigint").alias("rank"), "phrase_id",
                                            "intent", "sim")
