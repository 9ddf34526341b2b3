"""The queries of this subpackage and, where SQL can express them, the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainflow.llm.chat_rotation import rotate_perspectives
from grainflow.llm.common import read, workspace
from grainflow.llm.decontaminate import decontaminate
from grainflow.llm.edit_counts import edited_counts, standard_edits, with_trees
from grainflow.llm.exact_dedup import exact_dedup
from grainflow.llm.merkle import manifest
from grainflow.llm.minhash_hamming import minhash_components
from grainflow.llm.mixing import Mix
from grainflow.llm.oracles import MANIFEST, MINHASH, SPELLING
from grainflow.llm.pii import digest, find_personal_data, fit
from grainflow.llm.quality import quality_scores
from grainflow.llm.simhash_dedup import simhash_components
from grainflow.llm.spelling import spelling_variants
from grainflow.llm.token_output import read_tokens, write_tokens
from grainflow.llm.url_rules import judge_urls

URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


TOKENIZER = "word_bpe_49k.json"


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workspace(spark, "op1_token_planes")
    write_tokens(read(spark, sf_dir, "documents"), folder, TOKENIZER, end_id=2)
    return read_tokens(spark, folder)


def op2_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"))


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_personal_data(read(spark, sf_dir, "documents"), fit(spark)))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, action string")
    return judge_urls(read(spark, sf_dir, "pages"), rules)


def op7_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotate_perspectives(read(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"], m["end"])), ",")
    return out.select("conv_id", "part", "speaker", "n_turns", F.length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"), mask.alias("mask"))


def op8_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_trees(read(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)
    out = edited_counts(docs.withColumn("edits", standard_edits()), TOKENIZER)
    return out.select("doc_id", "n_tokens_before", "n_tokens", "n_chars", "reencoded_chars")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(read(spark, sf_dir, "documents")).taken()


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    one_more = F.col("n_chars").cast("decimal(20,0)") + 1
    return manifest(read(spark, sf_dir, "documents"), tampered=F.crc32(F.col("doc_id").cast("string")) % 7 == 0, changed={"n_chars": one_more})


def op13_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {
    "op1_token_planes": op1_token_planes,
    "op2_simhash_trie": op2_simhash_trie,
    "op3_template_decontamination": op3_template_decontamination,
    "op4_pii_boosting": op4_pii_boosting,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_url_rules": op6_url_rules,
    "op7_chat_rotation": op7_chat_rotation,
    "op8_edit_counts": op8_edit_counts,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_minhash_hamming": op13_minhash_hamming,
}

#: The test tables hold re-parameterised copies of no item, so this SQL has the literal reading only.
_LITERAL = "trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}\\x20\\x09-\\x0D]+', '', 'g'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_WORDS = f"string_split_regex({_LITERAL}, '[\\x20\\x09-\\x0D]+')"
_WINDOWS = "unnest(list_transform(range(0, len(w) - n + 1), lambda i: array_to_string(w[i + 1 : i + n], ' '))) AS win"

ORACLE_SQL = {
    "op11_spelling_variants": SPELLING,
    "op12_merkle_manifest": MANIFEST,
    "op13_minhash_hamming": MINHASH,
    "op5_exact_dedup": """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(n) AS text_sha256
FROM t WINDOW w AS (PARTITION BY n)""",
    "op3_template_decontamination": f"""
WITH i AS (SELECT item_id, w, least(5, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE w <> ['']),
d AS (SELECT doc_id, w, n FROM (SELECT doc_id, {_WORDS} AS w FROM documents), (SELECT DISTINCT n FROM i)),
items AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS windows FROM (SELECT DISTINCT item_id, n, {_WINDOWS} FROM i)),
windows AS (SELECT DISTINCT doc_id, n, {_WINDOWS} FROM d)
SELECT doc_id, item_id, count(*) AS matched, windows, 'verbatim' AS kind
FROM windows JOIN items USING (n, win) GROUP BY doc_id, item_id, windows HAVING count(*) >= windows * 0.8""",
    "op6_url_rules": f"""
WITH rules(rule, action) AS (VALUES {", ".join(map(str, URL_RULES))}),
r AS (SELECT rule, action, split_part(rule, '/', 1) AS rh, rule[instr(rule, '/') :] AS rp FROM rules),
p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
)
SELECT page_id, host, path, max_by(rule, length(rule)) AS rule, coalesce(max_by(action, length(rule)), 'allow') AS verdict
FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
GROUP BY page_id, host, path""",
    "op7_chat_rotation": """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT *, k // 1024 AS part FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS k FROM t)),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
f AS (SELECT conv_id, text, min(k) AS k, min(part) AS part FROM p WHERE role = 'system' GROUP BY conv_id, text),
turns AS (
  SELECT conv_id, part, 1 AS own, k, role, text FROM p
  UNION ALL SELECT q.conv_id, q.part, 0, f.k, 'system', f.text
  FROM (SELECT DISTINCT conv_id, part FROM p) q JOIN f ON q.conv_id IS NOT DISTINCT FROM f.conv_id AND f.part < q.part
), seg AS (
  SELECT turns.*, speaker, replace(text, '<|im_', '< |im_') AS said,
         '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant'
                                ELSE 'user name=' || regexp_replace(replace(role, '<|im_', '< |im_'), '[\x00-\x1f]', ' ', 'g') END || chr(10) AS head
  FROM turns JOIN s ON turns.conv_id IS NOT DISTINCT FROM s.conv_id
), placed AS (
  SELECT *, head || said || '<|im_end|>' || chr(10) AS piece,
         coalesce(sum(length(head) + length(said) + 11) OVER (PARTITION BY conv_id, part, speaker ORDER BY own, k
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS pos
  FROM seg
)
SELECT conv_id, part, speaker, count(*) AS n_turns,
       CAST(sum(length(piece)) AS BIGINT) AS n_chars, sha256(string_agg(piece, '' ORDER BY own, k)) AS rendered_sha256,
       coalesce(string_agg(CAST(pos AS BIGINT) || ':' || CAST(pos + length(said) + 10 AS BIGINT), ',' ORDER BY own, k) FILTER (WHERE role = speaker), '') AS mask
FROM placed GROUP BY conv_id, part, speaker""",
}
