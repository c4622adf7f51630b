"""One query per operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ziplore.llm import chat, language_model, merkle, near_dedup, packing, page_text, pieces, pii, quality, runs, secrets, urls, vector_dedup
from ziplore.llm.spans import listing

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counted(found: str, kinds: tuple[str, ...]) -> list:
    """How many spans there are of each kind."""
    return [
        F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in kinds
    ]


def span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return found.select(
        "doc_id",
        *counted("base", kinds),
        F.sha2(listing(F.col("base")), 256).alias("base_sha256"),
        listing(F.col("found")).alias("spans"),
    )


def op1_packing(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents"))


def op2_pii(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs, pii.train(spark))
    return span_digest(found.drop("text"), pii.BASE)


def op3_embedding_dedup(spark, sf):
    return vector_dedup.near_duplicate_vectors(table(spark, sf, "embeddings"))


def op4_url_filters(spark, sf):
    return urls.judge_urls(table(spark, sf, "pages").select("page_id", "url")).drop("url")


def op5_language_model(spark, sf):
    return language_model.score_documents(table(spark, sf, "documents"))


def op6_near_dedup(spark, sf):
    return near_dedup.near_duplicates(table(spark, sf, "documents"))


def op7_secret_scans(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return span_digest(secrets.find_secrets(docs), secrets.BASE)


def op8_sentencepiece(spark, sf):
    """Ids and score of every text, and the digest of the text that the ids decode to."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pieces.encode_texts(docs, decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        "ids",
        "score",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_quality_rules(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return quality.judge_documents(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "distance",
    )


def op10_chat(spark, sf):
    control = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame(
        [(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text").unionByName(extra)
    tree, members = chat.format_conversations(rows)
    return chat.digests(chat.read_back(tree, members), members)


def op11_periodic_runs(spark, sf):
    docs = runs.with_planted_period(table(spark, sf, "documents").select("doc_id", "text"))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = F.col("_best")
    return (
        runs.periodic_runs(docs)
        .withColumn("_best", runs.longest_run())
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            best["start"].alias("start"),
            (-best["less"]).alias("length"),
            best["period"].alias("period"),
            F.floor(best["less"] * -1000 / best["period"]).cast("long").alias("exponent_milli"),
            F.sha2(listed, 256).alias("runs_sha256"),
            F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )


def op12_html_extraction(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return page_text.extract_text(pages).withColumn("n_chars", F.char_length("text").cast("long"))


def op13_merkle_manifest(spark, sf):
    text = F.col("text")
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = lambda value: merkle.leaf_digest([F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [value])
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    docs = table(spark, sf, "documents").select(
        "doc_id", "source", leaf(text).alias("leaf"), F.when(touched, leaf(lowered)).alias("tampered")
    )
    proofs = merkle.prove(merkle.build_manifest(docs, "leaf", "source", "doc_id", ["doc_id", "tampered"]))
    return proofs.select(
        "doc_id", "leaf", "subroot", "root",
        merkle.digest(merkle.siblings()).alias("proof_sha256"),
        merkle.folded(F.coalesce("tampered", "leaf")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_pii": op2_pii,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_url_filters": op4_url_filters,
    "op5_language_model": op5_language_model,
    "op6_near_dedup": op6_near_dedup,
    "op7_secret_scans": op7_secret_scans,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_quality_rules": op9_quality_rules,
    "op10_chat": op10_chat,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_html_extraction": op12_html_extraction,
    "op13_merkle_manifest": op13_merkle_manifest,
}

# --- SQL twins ------------------------------------------------------------

OP4_SQL = r"""
WITH a AS (
  SELECT page_id, strpos(coalesce(url, ''), '://') AS pos, coalesce(url, '') AS u FROM pages
), b AS (
  SELECT page_id, CASE WHEN pos > 0 THEN substr(u, pos + 3) ELSE '' END AS r FROM a
), c AS (
  SELECT page_id,
         translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM b
), d AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM c
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN len(list_filter(string_split(host, '.'), lambda x:
      list_has_any(string_split(x, '-'), ['casino', 'bets', 'pills', 'adult', 'spam', 'ads']))) > 0 THEN 'block'
    ELSE 'allow' END AS verdict
FROM d
"""

#: Levels of a tree: node ``idx`` of ``n`` at its level, until one node remains.
_LEVELS = """
  SELECT tree, level + 1, idx // 16, max((n + 15) // 16), sha256(string_agg(digest, '' ORDER BY idx))
  FROM {name} WHERE n > 1 GROUP BY tree, level, idx // 16
"""
#: Siblings of a leaf's ancestors, one row a level.
_STEPS = """
  SELECT x.id, b.part * 1000 + a.level AS k,
         coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before,
         coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
  FROM {leaves} x
  JOIN {nodes} a ON a.tree = x.{tree} AND a.n > 1 AND a.idx = x.{idx} // (16 ** a.level)::BIGINT
  JOIN (SELECT *, {part} AS part FROM {nodes}) b ON b.tree = a.tree AND b.level = a.level AND b.idx // 16 = a.idx // 16
  GROUP BY x.id, b.part, a.level
"""

OP13_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256))::BIGINT AS i)
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM bits
), docs AS (
  SELECT row_number() OVER () AS id, doc_id, text, source, lang, n_chars,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(doc_id::VARCHAR, '.'), lambda d: ascii(d)::BIGINT)),
      lambda c, d: xor(c >> 8, t[(xor(c, d) & 255) + 1])), 4294967295) % 5 = 0 AS touched
  FROM documents, crc
), digests AS (
  SELECT id, doc_id, coalesce('1' || source, '0') AS tree,
    {{leaf_of_text}} AS leaf, CASE WHEN touched THEN {{leaf_of_lowered}} ELSE {{leaf_of_text}} END AS shown
  FROM docs
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY tree) AS n FROM digests
), nodes AS (
  SELECT tree, 0 AS level, idx, n, leaf AS digest FROM leaves UNION ALL {_LEVELS.format(name="nodes")}
), subroots AS (
  SELECT '' AS tree, tree AS of_tree, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n
  FROM nodes WHERE n = 1
), top AS (
  SELECT tree, 0 AS level, idx, n, digest FROM subroots UNION ALL {_LEVELS.format(name="top")}
), placed AS (
  SELECT l.*, s.digest AS subroot, s.idx AS top_idx, '' AS top_tree FROM leaves l JOIN subroots s ON s.of_tree = l.tree
), steps AS (
  SELECT id, before, after, row_number() OVER (PARTITION BY id ORDER BY k) AS k FROM (
    {_STEPS.format(leaves="placed", nodes="nodes", tree="tree", idx="idx", part=0)}
    UNION ALL
    {_STEPS.format(leaves="placed", nodes="top", tree="top_tree", idx="top_idx", part=1)}
  )
), folds AS (
  SELECT id, 0 AS k, shown AS held FROM placed
  UNION ALL
  SELECT f.id, f.k + 1, sha256(s.before || f.held || s.after) FROM folds f JOIN steps s ON s.id = f.id AND s.k = f.k + 1
), ends AS (
  SELECT id, max_by(held, k) AS folded_root FROM folds GROUP BY id
), proofs AS (
  SELECT id, string_agg(before || after, '' ORDER BY k) AS proof FROM steps GROUP BY id
)
SELECT doc_id, leaf, subroot, r.digest AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = r.digest AS verified
FROM placed JOIN ends USING (id) LEFT JOIN proofs USING (id), (SELECT digest FROM top WHERE n = 1) r
"""


def _leaf_sql(text: str) -> str:
    parts = (f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(parts)})"


ORACLES: dict[str, str] = {
    "op4_url_filters": OP4_SQL,
    "op13_merkle_manifest": OP13_SQL.format(leaf_of_text=_leaf_sql("text"), leaf_of_lowered=_leaf_sql("lowered")),
}


def llm_queries() -> dict[str, Query]:
    return dict(QUERIES)


def llm_oracles() -> dict[str, str]:
    return dict(ORACLES)
