"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrid.llm import quality
from driftgrid.llm.alignment import alignment_scores
from driftgrid.llm.fill_in_middle import fill_in_middle, restored
from driftgrid.llm.fingerprints import fingerprint_edits
from driftgrid.llm.mixing import mix_sources
from driftgrid.llm.near_duplicates import near_duplicates
from driftgrid.llm.packing import pack
from driftgrid.llm.pseudonyms import pseudonymize
from driftgrid.llm.sharding import shuffle_into_shards
from driftgrid.llm.substrings import remove_repeats
from driftgrid.llm.topk import top_k
from driftgrid.llm.toxicity import held_out, score, train
from driftgrid.llm.warc import read_archives, run_folder, write_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    utf8 = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length("text") + F.lit(16)).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32"))
    docs = docs.withColumn("size", F.coalesce("size", F.lit(16).cast("long")))
    out = shuffle_into_shards(docs, shards=40, seed=7)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s
)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 20
"""


# Parameters of the production mix: a source's domain is its number modulo 4.
MIX_WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "fr": 2, "de": 2, "*": 1}, "source": {"*": 1}}


def mix_levels() -> dict[str, Column]:
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT)")
    return {"domain": F.concat(F.lit("d"), (number % 4).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


def mix_tokens() -> Column:
    """Tokens as they are estimated for budgets: one for every four characters begun."""
    return F.expr("(length(coalesce(text, '')) + 3) div 4")


def mixed(docs: DataFrame) -> DataFrame:
    return mix_sources(docs, mix_levels(), MIX_WEIGHTS, tokens=mix_tokens(), budget=(1, 1), max_epochs=4, seed=11)


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixed(docs).select("doc_id", "lang", "source", "epoch", F.col("mix_tokens").alias("tokens"))


OP3_LEVEL = """
{name} AS (
  SELECT n.*, b.budget FROM (SELECT {path}, sum(cap) AS cap, {weight} AS w FROM tree GROUP BY {path}) n
  JOIN {above} b ON {on} WHERE {weight_check}
), {name}_a AS (
  SELECT *, budget - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap::DOUBLE / w::DOUBLE, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
         sum(w) OVER (PARTITION BY {parent} ORDER BY cap::DOUBLE / w::DOUBLE, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws,
         row_number() OVER (PARTITION BY {parent} ORDER BY cap::DOUBLE / w::DOUBLE, {child}) AS n
  FROM {name} WHERE cap > 0 AND w > 0
), {name}_b AS (
  SELECT *, min(CASE WHEN room * w < cap * ws THEN n END) OVER (PARTITION BY {parent}) AS lead_n FROM {name}_a
), {name}_c AS (
  SELECT {path}, (CASE WHEN lead_n IS NULL OR n < lead_n THEN cap
         ELSE w * max(CASE WHEN n = lead_n THEN room END) OVER (PARTITION BY {parent}) // max(CASE WHEN n = lead_n THEN ws END) OVER (PARTITION BY {parent}) END)::HUGEINT AS budget
  FROM {name}_b
)"""


def _op3_sql() -> str:
    levels = ["domain", "lang", "source"]
    weight = {
        "domain": "CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 WHEN 'd3' THEN 1 ELSE 1 END",
        "lang": "CASE lang WHEN 'en' THEN 5 WHEN 'fr' THEN 2 WHEN 'de' THEN 2 ELSE 1 END",
        "source": "1",
    }
    parts, above = [], "total"
    for i, level in enumerate(levels):
        on = " AND ".join(f"n.{x} = b.{x}" for x in levels[:i]) or "true"
        parts.append(OP3_LEVEL.format(name=f"l{i}", path=", ".join(levels[: i + 1]), weight=f"{weight[level]}::HUGEINT", weight_check="true", above=above, on=on, parent=", ".join(levels[:i]) or "1", child=level))
        above = f"l{i}_c"
    return f"""
WITH docs AS (
  SELECT doc_id, lang AS lang0, source AS source0, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
         coalesce('d' || (TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4)::VARCHAR, '(none)') AS domain,
         ((length(coalesce(text, '')) + 3) // 4)::HUGEINT AS t
  FROM documents
), tree AS (SELECT domain, lang, source, sum(t)::HUGEINT AS supply, 4 * sum(t)::HUGEINT AS cap FROM docs GROUP BY domain, lang, source),
total AS (SELECT sum(supply)::HUGEINT AS budget FROM tree),
{",".join(parts)},
leaf AS (
  SELECT c.*, t.supply, c.budget // t.supply AS whole, c.budget % t.supply AS rest
  FROM {above} c JOIN tree t USING (domain, lang, source) WHERE c.budget > 0
), drawn AS (
  SELECT d.*, l.whole, l.rest, sum(t) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY md5('11|' || l.whole::VARCHAR || '|' || coalesce(doc_id::VARCHAR, 'null')) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM docs d JOIN leaf l USING (domain, lang, source)
), n AS (SELECT *, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS copies FROM drawn)
SELECT doc_id, lang0 AS lang, source0 AS source, e::INTEGER AS epoch, t::BIGINT AS tokens
FROM (SELECT *, unnest(range(0, copies::BIGINT)) AS e FROM n)
"""


OP3_SQL = _op3_sql()


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs, PII_KEY, count_col="n_private")


#: The key of the registered query; a real run takes its own.
PII_KEY = "driftgrid-demo-key"


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_folder(spark, "warc")
    manifest = write_archives(_table(spark, sf_dir, "pages"), folder)
    return read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS h, body, min(page_id) OVER (PARTITION BY body) AS least FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (5 * k) // 4 + 1, 2))::INTEGER >> (3 - (5 * k) % 4)) & 31) + 1)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
FROM d
"""


def tokenizer_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(_table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS g
  FROM words WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 9 * shared >= 4 * (x.n + y.n)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM ends UNION SELECT r.a, e.b FROM reach r JOIN ends e ON r.b = e.a),
classes AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a),
counts AS (SELECT a AS doc_id, count(*) AS n FROM ends GROUP BY a)
SELECT d.doc_id, least(d.doc_id, coalesce(c.least, d.doc_id)) AS class_id, coalesce(n, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN classes c ON c.doc_id = d.doc_id LEFT JOIN counts k ON k.doc_id = d.doc_id
"""


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint_edits(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_chars", F.sha2(F.encode("edited_text", "UTF-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def toxicity_scores(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with score and predicted, by a model trained on the labelled documents of the folder."""
    model = train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return score(docs, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity_scores(spark, docs, sf_dir).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(range(0, len(w) - 19)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda k: array_to_string(w[k:k + 19], ' '))) AS g FROM t WHERE len(w) >= 20
), again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM again, range(0, 20) x(j)),
each AS (SELECT doc_id, unnest(range(0, len(w))) AS i, unnest(w) AS word FROM t),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS text, count(*) AS n FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i WHERE g.i IS NULL GROUP BY e.doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, i) || '<S>' || substr(t, j + 1) || '<M>' || substr(t, i + 1, j - i)
                      ELSE '<S>' || substr(t, j + 1) || '<P>' || substr(t, 1, i) || '<M>' || substr(t, i + 1, j - i) END AS output FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN i::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (j - i)::BIGINT END AS middle_chars,
       sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""


def pieces_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment_scores(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), pieces_path(), digest=True)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_shard": op1_shard,
        "op2_topk": op2_topk,
        "op3_mix": op3_mix,
        "op4_pii": op4_pii,
        "op5_warc": op5_warc,
        "op6_pack": op6_pack,
        "op7_jaccard": op7_jaccard,
        "op8_fingerprint": op8_fingerprint,
        "op9_toxicity": op9_toxicity,
        "op10_repeats": op10_repeats,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_align": op12_align,
        "op13_quality": op13_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": OP2_SQL, "op3_mix": OP3_SQL, "op5_warc": OP5_SQL, "op7_jaccard": OP7_SQL, "op10_repeats": OP10_SQL, "op11_fill_in_middle": OP11_SQL}
