"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from cohort_engine.llm import (collocations, decontaminate, licenses, lm_score, mixing, near_vectors, ngram_join, passages, quality, tokenstore,
                               topk, turn_repair, warc)
from cohort_engine.llm.store import table, written

TOKENIZER = "byte_bpe_50k.json"


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every document; a seventh of the ids is held out."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    model = lm_score.train(spark, docs.filter(~held))
    return (lm_score.score(spark, docs.select("doc_id", "text"), model, ["doc_id"])
            .select("doc_id", held.alias("held_out"), "n_tokens", "n_known",
                    F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items inside documents."""
    return decontaminate.contained(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP2_SQL = rf"""
WITH i AS (
  SELECT item_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), d AS (
  SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), ish AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS k,
         unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda p: array_to_string(w[p:p + least(len(w), 5) - 1], ' '))) AS s
  FROM i WHERE len(w) > 0
), n AS (
  SELECT item_id, count(*) AS n_shingles FROM ish GROUP BY item_id
), dsh AS (
  SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS s
  FROM d CROSS JOIN (SELECT DISTINCT k FROM ish) WHERE len(w) >= k
), f AS (
  SELECT dsh.doc_id, ish.item_id, count(*) AS n_found FROM dsh JOIN ish USING (k, s) GROUP BY ALL
)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment
FROM f JOIN n USING (item_id) WHERE 4 * n_found >= 3 * n_shingles
"""


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat between documents."""
    return passages.repeated_passages(spark, table(spark, sf_dir, "documents"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to shards and read back."""
    manifest = tokenstore.token_store(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return tokenstore.read_store(manifest)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return ngram_join.link_components(spark, table(spark, sf_dir, "documents"))


OP5_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
                                                lambda p: array_to_string(w[p:p + 4], ' '))) AS g
  FROM d WHERE len(w) > 0
), n AS (
  SELECT d.doc_id, count(s.g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN n nx ON nx.doc_id = a JOIN n ny ON ny.doc_id = b WHERE 100 * c >= 75 * (nx.n + ny.n - c)
), reach AS (
  SELECT doc_id, doc_id AS other FROM n
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
)
SELECT n.doc_id, n.n AS n_shingles, min(reach.other) AS component_id FROM n JOIN reach USING (doc_id) GROUP BY ALL
"""


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    sizes = written(mixing.sized(table(spark, sf_dir, "documents")), "op6-sizes")
    sources = written(mixing.source_targets(sizes), "op6-sources")
    taken = mixing.mix(spark, sizes, sources).groupBy("row").agg(F.sum("n_words").alias("taken"))
    return (sizes.join(sources, sizes["source"].eqNullSafe(sources["source"]))
            .select("row", "doc_id", "size", "source_size", "target")
            .join(taken, "row", "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('42|' || CAST(doc_id AS VARCHAR)) AS h,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS lim FROM s
), lev AS (
  SELECT a.k, a.lim / CAST(a.weight AS DOUBLE) AS ratio,
         CAST((SELECT sum(source_size) FROM w) - coalesce(sum(b.lim) FILTER (
           b.lim / CAST(b.weight AS DOUBLE) < a.lim / CAST(a.weight AS DOUBLE)
           OR (b.lim / CAST(b.weight AS DOUBLE) = a.lim / CAST(a.weight AS DOUBLE) AND b.k < a.k)), 0) AS DOUBLE)
         / CAST(sum(b.weight) FILTER (
           b.lim / CAST(b.weight AS DOUBLE) > a.lim / CAST(a.weight AS DOUBLE)
           OR (b.lim / CAST(b.weight AS DOUBLE) = a.lim / CAST(a.weight AS DOUBLE) AND b.k >= a.k)) AS DOUBLE) AS level
  FROM w a CROSS JOIN w b GROUP BY a.k, a.lim, a.weight
), water AS (
  SELECT arg_min(level, (ratio, k)) AS level FROM lev WHERE ratio > level
), t AS (
  SELECT w.source, w.source_size,
         CASE WHEN water.level IS NULL OR w.lim <= water.level * w.weight
              THEN CAST(w.lim AS DOUBLE) ELSE water.level * CAST(w.weight AS DOUBLE) END AS target, w.lim
  FROM w CROSS JOIN water
), laid AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         least(CAST(floor(t.target + 0.5) AS BIGINT), CAST(t.lim AS BIGINT)) AS want,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN CAST(0 AS BIGINT) ELSE CAST((want // source_size) * size
       + greatest(0, least(size, want - (want // source_size) * source_size - start)) AS BIGINT) END AS taken
FROM laid
"""


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back: responses with their
    payloads, revisits by their headers alone."""
    folder = warc.archive(spark, table(spark, sf_dir, "pages"))
    read = lambda payload: spark.read.format("warc").option("payload", payload).load(folder)
    full = (read("read").filter(F.col("record_type") == "response")
            .select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
                    F.sha1("payload").alias("payload_digest"), "record_type", "refers_to"))
    again = (read("skip").filter(F.col("record_type") == "revisit")
             .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    return full.unionByName(again)


OP7_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT payload_digest, max(page_id) AS keep FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN keep IS NOT NULL AND page_id IS DISTINCT FROM keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keep IS NOT NULL AND page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of a third of the ids are held out."""
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = quality.train(docs, table(spark, sf_dir, "labels").filter(F.coalesce(fold != 1, F.lit(False))))
    return (quality.score(spark, docs.select("doc_id", "text"), model)
            .select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_topk(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.scan_licenses(spark, table(spark, sf_dir, "documents"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations repaired at the least cost, with the repaired
    lines' hash.  Conversations that lost all rows have zeros, an empty audit
    and the hash of an empty text."""
    conversations = table(spark, sf_dir, "conversations")
    repaired = turn_repair.repair(spark, turn_repair.damaged(conversations))
    key = turn_repair.conversation_key(F.col("conv_id"))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    report = repaired.report.select(key.alias("conv"), *counts, "audit")
    ids = conversations.select("conv_id").distinct().select(key.alias("conv"), "conv_id")
    return (ids.join(report, "conv", "left").join(turn_repair.text_hashes(repaired.turns), "conv", "left")
            .select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")))


def _op11_sql() -> str:
    """The cheapest edits row by row; a state is its cost, 12 digits, and its
    audit, so that the least text is the cheapest and ASCII-least."""
    plus = lambda x, k, a: f"(lpad(CAST(CAST(left({x}, 12) AS BIGINT) + {k} AS VARCHAR), 12, '0') || substr({x}, 13) || '{a}')"
    least = lambda *x: f"least({', '.join(x)})"
    user = least("u", plus("z", 2, "I"), plus("s", 2, "I"), plus("a", 2, "I"))
    asst = least("a", plus("u", 2, "I"), plus("z", 4, "II"), plus("s", 4, "II"))
    near = least("z", "s", "ia")
    keep = lambda x, role: f"CASE WHEN r.fault IN (0, 3) AND r.initial = '{role}' THEN {plus(x, 'r.extra', 'K')} END"
    turn = lambda x: f"CASE WHEN r.fault IN (0, 3) THEN {plus(x, '2 + r.extra', 'R')} END"
    return rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(CAST(role AS VARCHAR), ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                        lambda c: CAST(ascii(c) AS BIGINT)) AS b
  FROM conversations
), kinds AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x:
      list_reduce(list_prepend(xor(c, x), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))),
      CAST(4294967295 AS BIGINT)) % 20 AS kind
  FROM src
), rows_ AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM rows_
), faults AS (
  SELECT *, left(role, 1) AS initial,
         CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2
              WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 3 ELSE 0 END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair
  FROM placed
), r AS (
  SELECT *, CASE WHEN fault = 3 THEN 1 ELSE 0 END AS extra FROM faults
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM r GROUP BY conv_id
), dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, '000000000000' AS z, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a
  FROM counted
  UNION ALL
  SELECT q.conv_id, r.pos, {plus("z", 3, "D")}, {least(plus("s", 3, "D"), keep("z", "s"))},
         {least(plus("iu", 3, "D"), keep(near, "u"), turn(near))}, {least(plus("ia", 3, "D"), keep("iu", "a"), turn("iu"))}
  FROM (SELECT *, {user} AS iu, {asst} AS ia FROM dp) q JOIN r ON r.conv_id IS NOT DISTINCT FROM q.conv_id AND r.pos = q.pos + 1
), best AS (
  SELECT dp.conv_id, {least("z", "a", plus("u", 2, "I"), plus("s", 4, "II"))} AS w
  FROM dp JOIN counted c ON c.conv_id IS NOT DISTINCT FROM dp.conv_id AND c.n = dp.pos
), letters AS (
  SELECT conv_id, unnest(string_split(substr(w, 13), '')) AS letter, generate_subscripts(string_split(substr(w, 13), ''), 1) AS step FROM best
), steps AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY step) AS pos,
         count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY step) AS place
  FROM letters WHERE letter <> ''
), lines AS (
  SELECT t.*, r.role, r.text, max(CASE WHEN place = 1 AND letter = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY t.conv_id) AS led
  FROM steps t LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.pos = t.pos AND letter <> 'I'
), hashed AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                    || ':' || coalesce(text, ''), chr(10) ORDER BY step)) AS h
  FROM lines WHERE letter <> 'D' GROUP BY conv_id
)
SELECT i.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
       coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(CAST(left(b.w, 12) AS BIGINT), 0) AS cost,
       coalesce(substr(b.w, 13), '') AS audit, coalesce(h.h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN hashed h ON h.conv_id IS NOT DISTINCT FROM i.conv_id
"""


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose cosine is 0.95 or more, and their components."""
    return near_vectors.near_vectors(spark, table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), fit AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id, vec_id AS other FROM v
  UNION
  SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.other
), comp AS (
  SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
), n AS (
  SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN n USING (vec_id)
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of every language."""
    return collocations.collocations(spark, table(spark, sf_dir, "documents"))


_OP13_GRAMS = "\n  UNION ALL\n  ".join(
    f"SELECT lang, {k} AS k, array_to_string(w[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM pieces)"
    for k in range(1, 6))
OP13_SQL = rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_ASCII_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents)
), grams AS (
  {_OP13_GRAMS}
), f AS (
  SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL
), total AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= 100
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, t.n, x.a AS l, y.a AS r,
         CAST(1000 AS HUGEINT) * c.a * t.n // (CAST(x.a AS HUGEINT) * y.a) AS score, cut
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN total t USING (lang)
  JOIN f x ON x.lang = c.lang AND x.k = cut AND x.phrase = array_to_string(w[1:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.k = c.k - cut AND y.phrase = array_to_string(w[cut + 1:], ' ')
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT DISTINCT s.lang, s.phrase FROM c b, unnest(range(2, b.k)) AS m(size), unnest(range(1, b.k - m.size + 2)) AS o(start)
  JOIN c s ON s.lang = b.lang AND s.k = m.size AND s.phrase = array_to_string(b.w[o.start:o.start + m.size - 1], ' ')
  WHERE 100 * b.a >= 100 * s.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored
  ANTI JOIN inside USING (lang, phrase)
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py over documents."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_decontaminate": op2_decontaminate,
    "op3_passages": op3_passages,
    "op4_token_store": op4_token_store,
    "op5_ngram_join": op5_ngram_join,
    "op6_mix_sources": op6_mix_sources,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_exact_topk": op9_exact_topk,
    "op10_license_scan": op10_license_scan,
    "op11_turn_repair": op11_turn_repair,
    "op12_near_vectors": op12_near_vectors,
    "op13_collocations": op13_collocations,
    "pipeline": pipeline,
}
SQL: dict[str, str] = {"op2_decontaminate": OP2_SQL, "op5_ngram_join": OP5_SQL, "op6_mix_sources": OP6_SQL, "op7_warc": OP7_SQL, "op9_exact_topk": OP9_SQL,
                       "op11_turn_repair": _op11_sql(), "op12_near_vectors": OP12_SQL, "op13_collocations": OP13_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
