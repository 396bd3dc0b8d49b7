"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larchgraph.llm import conversation_repair, embedding_dedup, fill_in_middle, line_dedup, media, mixing, near_dedup, packing, pairwise_quality, quality_rules, sharding, token_counts, url_filter
from larchgraph.llm.common import stored, table

SHARDS = 40


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return media.read_back(media.text_media(docs))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = table(spark, sf_dir, "documents")
    docs = whole.select(
        "doc_id", sharding.sizes().alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    )
    placed = sharding.shards(docs, "doc_id", sharding.layout(SHARDS), sharding.layout(SHARDS + 1))
    placed = sharding.numbered(placed, "shard", ["doc_id", "text_crc32", "size"], "slot", whole.count())
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.dealt(mixing.mix(docs))
    return mixed.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = stored(pairwise_quality.features(docs).select("doc_id", "_features"))
    model = pairwise_quality.learn(docs, table(spark, sf_dir, "labels"), measured=True)
    held = pairwise_quality.held_out("doc_id").alias("held_out")
    return pairwise_quality.scored(docs, model, measured=True).select("doc_id", held, "score", "predicted")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), docs.count())


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, tokenizer("byte_bpe_50k.json"), 512)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.cleaned(docs, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines",
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fill_in_middle.fill_in_middle(docs)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256")
    )


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows, edits = conversation_repair.repair(conversation_repair.damaged(turns), copies="copies")
    conversations = turns.select(F.col("conv_id").alias("conv")).distinct()
    return conversation_repair.reports(rows, edits, conversations).withColumnRenamed("conv", "conv_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_media_columns": op1_media_columns,
    "op2_url_filters": op2_url_filters,
    "op3_sharding": op3_sharding,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_packing": op6_packing,
    "op7_mixing": op7_mixing,
    "op8_token_counts": op8_token_counts,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_conversation_repair": op13_conversation_repair,
    "pipeline": pipeline,
}
_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"
_RULES = "(VALUES " + ", ".join(f"('{r.name}', '{r.verdict}', '{r.host}', '{r.path}')" for r in url_filter.RULES) + ") r(name, verdict, host, path)"

#: Shingles are compared as text, links on whole sets, components by the closure of links.
_NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s), e AS (SELECT doc_id, unnest(s) AS g FROM s), rare AS (SELECT g FROM e GROUP BY g HAVING count(*) > 1),
c AS (SELECT doc_id, g FROM e JOIN rare USING (g)),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM c a JOIN c b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, b.y FROM r JOIN b ON b.x = r.y)
SELECT n.doc_id, n.n AS n_shingles, min(r.y) AS component_id, n.doc_id = min(r.y) AS kept FROM n JOIN r ON r.x = n.doc_id GROUP BY n.doc_id, n.n"""

_LINES = f"""WITH l AS (SELECT doc_id, line, pos, trim({_LOWER.format("line")}, {_WS}) AS k FROM (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
f AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT l.*, f.k IS NOT NULL AS gone FROM l LEFT JOIN f USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""

_QUALITY = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(trim(x, {_WS})) > 0) AS l FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2]) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE k > 1) GROUP BY 1),
m AS (SELECT doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '{quality_rules.SYMBOLS}', '')) AS BIGINT) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
 coalesce(n_repeat_words, 0) AS n_repeat_words, len(list_filter(w, lambda x: list_contains([{", ".join(f"'{x}'" for x in quality_rules.STOP_WORDS)}], {_LOWER.format("x")}))) AS n_stop_words, len(l) AS n_lines,
 len(list_filter(l, lambda x: ltrim(x, ' ')[1] IN ('-', '*', '•'))) AS n_bullet_lines, len(list_filter(l, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…')) AS n_ellipsis_lines FROM d LEFT JOIN r USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {quality_rules.rules_sql()} AS kept FROM m"""

_MIX = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
a AS (SELECT *, 2.0 * n AS cap, 1.5 * sum(n) OVER () AS total FROM s),
b AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM a),
t AS (SELECT source, n, least(cap, coalesce((SELECT arg_min(level, cap / w) FROM b WHERE cap / w >= level), 1e300) * w) AS target FROM b),
c AS (SELECT d.*, t.n, t.target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY o) - size AS BIGINT) AS start FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, n AS source_size, CAST(target AS DOUBLE) AS target, CAST(floor(target / greatest(n, 1)) * size + greatest(0, least(size, round(target - floor(target / greatest(n, 1)) * n) - start)) AS BIGINT) AS taken FROM c"""

_FIM = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS w FROM documents),
n AS (SELECT *, len(w) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(w) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(w) + 1) AS y,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain' WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(w[1:least(x, y)], '') AS a, array_to_string(w[least(x, y)+1:greatest(x, y)], '') AS b, array_to_string(w[greatest(x, y)+1:], '') AS c FROM n)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || c || '<P>' || a || '<M>' || b ELSE '<P>' || a || '<S>' || c || '<M>' || b END) AS output_sha256, sha256(CASE form WHEN 'plain' THEN t ELSE a || b || c END) AS restored_sha256 FROM p"""

_VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id"""

#: crc32 by a fold over bits; costs backwards, row by row, from each state (b0 nothing yet, bs, bu, ba); letters forwards.
_REPAIR = f"""WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(k) + 1), lambda i: [ord(k[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END)), 4294967295::BIGINT) % 20 AS c FROM t),
d AS (SELECT conv_id, turn, CASE c WHEN 4 THEN 'user' ELSE role END AS role, CASE c WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE c WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE c <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, {_WS}) AS bare FROM d),
f AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN bare[-1] IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault, role[1] AS r FROM o),
q AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
 FROM (SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM f) GROUP BY conv_id),
b AS (SELECT conv_id, n + 1 AS i, 0 AS b0, 4 AS bs, 2 AS bu, 0 AS ba FROM q
 UNION ALL SELECT conv_id, i, least(x0, 2 + least(xu, 2 + xa)), least(xs, 2 + least(xu, 2 + xa)), least(xu, 2 + least(xa, 2 + xu)), least(xa, 2 + xu) FROM
 (SELECT b.conv_id, f.i, least(3 + b0, u, z + CASE r WHEN 'u' THEN bu WHEN 's' THEN bs ELSE 1000000 END) AS x0, least(3 + bs, u, z + CASE r WHEN 'u' THEN bu ELSE 1000000 END) AS xs, least(3 + bu, 2 + z + ba, z + CASE r WHEN 'a' THEN ba ELSE 1000000 END) AS xu, least(3 + ba, u, z + CASE r WHEN 'u' THEN bu ELSE 1000000 END) AS xa
  FROM b JOIN (SELECT *, CASE fault WHEN 3 THEN 1 WHEN 0 THEN 0 ELSE 1000000 END AS z FROM f) f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i - 1, LATERAL (SELECT 2 + z + bu AS u))),
w AS (SELECT conv_id, i, b0, bs, bu, ba, lead(b0) OVER p AS n0, lead(bs) OVER p AS ns, lead(bu) OVER p AS nu, lead(ba) OVER p AS na FROM b WINDOW p AS (PARTITION BY conv_id ORDER BY i)),
g AS (SELECT w.*, f.role, f.text, f.r, CASE f.fault WHEN 3 THEN 1 WHEN 0 THEN 0 ELSE 1000000 END AS z FROM w LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i),
e AS (SELECT conv_id, 1::BIGINT AS i, '0' AS s, '' AS audit, []::VARCHAR[] AS said, 0 AS step FROM q
 UNION ALL SELECT conv_id, CASE WHEN x = 'I' THEN i ELSE i + 1 END, CASE WHEN x = 'D' THEN s WHEN x = 'K' THEN r WHEN s = 'u' THEN 'a' ELSE 'u' END, audit || x,
  CASE x WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text) ELSE list_append(said, CASE s WHEN 'u' THEN 'assistant:' ELSE 'user:' END || CASE x WHEN 'R' THEN text ELSE '' END) END, step + 1 FROM
  (SELECT e.*, g.role, g.text, g.r, CASE WHEN g.role IS NOT NULL AND 3 + after = cost THEN 'D' WHEN 2 + other = cost THEN 'I' WHEN g.role IS NULL THEN NULL
     WHEN z + CASE WHEN r = 'u' AND e.s <> 'u' THEN nu WHEN r = 'a' AND e.s = 'u' THEN na WHEN r = 's' AND e.s = '0' THEN ns ELSE 1000000 END = cost THEN 'K' ELSE 'R' END AS x
   FROM e JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id AND g.i = e.i,
   LATERAL (SELECT CASE e.s WHEN '0' THEN b0 WHEN 's' THEN bs WHEN 'u' THEN bu ELSE ba END AS cost, CASE e.s WHEN '0' THEN n0 WHEN 's' THEN ns WHEN 'u' THEN nu ELSE na END AS after, CASE e.s WHEN 'u' THEN ba ELSE bu END AS other)) WHERE x IS NOT NULL),
l AS (SELECT conv_id, arg_max(audit, step) AS audit, sha256(array_to_string(arg_max(said, step), chr(10))) AS repaired_sha256 FROM e GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(b0 AS BIGINT), 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.i = 1"""

ORACLES: dict[str, str] = {
    "op4_minhash_near_dedup": _NEAR,
    "op7_mixing": _MIX,
    "op9_line_dedup": _LINES,
    "op10_quality_rules": _QUALITY,
    "op11_fill_in_middle": _FIM,
    "op12_embedding_near_dedup": _VECTORS,
    "op13_conversation_repair": _REPAIR,
}
