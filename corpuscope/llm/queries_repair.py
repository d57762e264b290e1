"""Queries of conversation repair, personal data and phrase mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.llm.conversation_repair import repair_conversations
from corpuscope.llm.personal_data import personal_data
from corpuscope.llm.phrase_graph import collocations
from corpuscope.llm.queries import register


def damaged(rows):
    """``rows`` with a code 0 to 19 per row, a hash of its id and turn: 1 empties the text, 2 takes its
    sentence ends, 3 repeats the row, 4 makes it the user's; code 0 rows are to be dropped."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    coded = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"),
                        (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20).alias("code"))
    text = (F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    return coded.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
                        text.alias("text"), "code",
                        F.explode(F.sequence(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1))).alias("copy"))


OP11_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce(list_concat([b], [0, 0, 0, 0, 0, 0, 0, 0]),
                          lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS tbl
  FROM range(256) AS r(b)),
coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT)),
             lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS code
  FROM conversations, bits),
d AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE code WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE code <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS rn FROM d),
f AS (
  SELECT *, left(role, 1) AS c, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY rn) AS before
  FROM o),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (rn > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM f GROUP BY conv_id),
-- states: 0 nothing, s, u, a; a step inserts up to two rows and then edits row i + 1
way(conv_id, i, state, cost, audit, body) AS (
  SELECT conv_id, 0, '0', 0, '', '' FROM stats
  UNION ALL
  (WITH ready AS (
     SELECT w.conv_id, w.i, k,
            CASE k WHEN 0 THEN state WHEN 1 THEN CASE state WHEN 'u' THEN 'a' ELSE 'u' END
                   ELSE CASE state WHEN 'u' THEN 'u' ELSE 'a' END END AS st,
            cost + 3 * k AS cost, audit || repeat('I', k) AS audit,
            body || CASE k WHEN 0 THEN '' WHEN 1 THEN CASE state WHEN 'u' THEN chr(10) || 'assistant:' WHEN '0' THEN 'user:' ELSE chr(10) || 'user:' END
                    ELSE CASE state WHEN 'u' THEN chr(10) || 'assistant:' || chr(10) || 'user:'
                                    WHEN '0' THEN 'user:' || chr(10) || 'assistant:'
                                    ELSE chr(10) || 'user:' || chr(10) || 'assistant:' END END AS body
     FROM way AS w, range(3) AS ks(k)),
   edit AS (
     SELECT r.*, f.c, f.role, f.text, f.fault, e, CASE st WHEN 'u' THEN 'a' ELSE 'u' END AS due,
            CASE st WHEN '0' THEN '' ELSE chr(10) END AS sep
     FROM ready AS r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.rn = r.i + 1, (VALUES ('D'), ('K'), ('R')) AS es(e)
     WHERE e = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (e = 'R' OR f.c = CASE st WHEN 'u' THEN 'a' ELSE 'u' END OR (st = '0' AND f.c = 's'))))
   SELECT * FROM (SELECT conv_id, i + 1, CASE e WHEN 'D' THEN st WHEN 'K' THEN c ELSE due END AS state,
          cost + CASE e WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS cost,
          audit || e AS audit,
          body || CASE e WHEN 'D' THEN '' WHEN 'K' THEN sep || role || ':' || text
                         ELSE sep || CASE due WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text END AS body
   FROM edit) AS step QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1)),
ended AS (
  SELECT way.conv_id, cost + CASE state WHEN 's' THEN 6 WHEN 'u' THEN 3 ELSE 0 END AS cost,
         audit || CASE state WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END AS audit,
         body || CASE state WHEN 's' THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 'u' THEN chr(10) || 'assistant:' ELSE '' END AS body
  FROM way JOIN stats ON stats.conv_id IS NOT DISTINCT FROM way.conv_id AND way.i = stats.n),
best AS (SELECT * FROM ended QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM ids LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM ids.conv_id
         LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id"""


@register("op11_conversation_repair", OP11_SQL)
def op11_conversation_repair(spark, sf_dir):
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return repair_conversations(rows.where("code <> 0"), rows.where("code = 0").select("conv_id"))


@register("op12_personal_data")
def op12_personal_data(spark, sf_dir):
    """No SQL: the classifier is trained; tests hold the base spans against the plain patterns and the
    added spans against planted ones."""
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH w AS (
  SELECT lang, list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda x : x <> '') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), range(1, 5) AS ks(k) WHERE i + k - 1 <= len(ws)),
totals AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
covered AS (SELECT DISTINCT s.lang, s.phrase FROM
      (SELECT lang, k, a, ws, unnest(range(2, k)) AS j FROM c) AS l, range(1, 4) AS st(i), c AS s
      WHERE i + j - 1 <= l.k AND s.lang = l.lang AND s.phrase = array_to_string(l.ws[i:i + j - 1], ' ') AND 100 * l.a >= 80 * s.a),
cuts AS (SELECT lang, phrase, k, a, ws, unnest(range(1, k)) AS j FROM c ANTI JOIN covered USING (lang, phrase)),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.a, j, x.a AS l, y.a AS r, (2000000::HUGEINT * cuts.a) // (x.a + y.a) AS score
      FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.phrase = array_to_string(ws[1:j], ' ')
                JOIN f AS y ON y.lang = cuts.lang AND y.phrase = array_to_string(ws[j + 1:], ' ')),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


@register("op13_phrase_mining", OP13_SQL)
def op13_phrase_mining(spark, sf_dir):
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
