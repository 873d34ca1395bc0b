"""The registered queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import ann, chat, htmltext, langid, mixing, pieces, quality, repair, search, sharding, simhash, tokencount, urlfilter
from textloom.llm.common import SPACE_CLASS
from textloom.llm.sql import SEARCH_SQL, repair_sql, url_sql

SHARDS = [f"shard-{k:03d}" for k in range(64)]
TABLE_SIZE = 16381
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
PLANTED = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sharding.assign_shards(docs, "doc_id", SHARDS, TABLE_SIZE).select("doc_id", "source", "n_chars", "slot", "shard")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text", "lang", "source"))
    return found.select("doc_id", "lang", "source", F.col("li_lang").alias("detected"), F.col("li_text_lang").alias("text_detected"), F.col("li_posterior").alias("posterior"), F.col("li_kept").alias("kept"))


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: markup language, address suffix and host beside the text; text models from the documents."""
    docs, pages = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "pages")
    markup = F.regexp_extract("html", r"(?i)<html[^>]*\slang=[\"']?([A-Za-z]{2})", 1)
    read = htmltext.parsed_pages(pages, "html").select("page_id", "url", F.array_join("_page.blocks", " ").alias("text"), F.when(markup != "", markup).alias("lang"))
    model = langid.fit(docs, id_col="doc_id", text="text", label="lang", languages=["de", "en", "es", "fr"], sample=500)
    found = langid.identify(read, id_col="page_id", url="url", host=None, model=model)
    return found.select("page_id", "lang", F.col("li_lang").alias("detected"), F.col("li_posterior").alias("posterior"), F.col("li_kept").alias("kept"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string"))
    out = chat.format_turns(chat.canonical_turns(rows)).withColumn("turns", chat.parse(F.col("formatted")))
    out = out.withColumn("strings", chat.turn_strings(F.col("formatted"))).withColumn("learned", chat.loss_text(F.col("strings"), F.col("spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"), check="round_trip", keep_text=False)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "round_trip")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), query="id % 50 = 0", k=5)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokencount.with_token_counts(docs, tokenizer_file("byte_bpe_50k.json"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return counted.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # longer documents hold more of their source: their inclusion odds grow with the root of their size
    mixed = mixing.mix_sizes(table(spark, sf_dir, "documents"), relative=F.sqrt("size"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmltext.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = quality.with_quality(docs, quality.references(docs))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance", "share_distance"]
    return judged.select("doc_id", *[F.col(f"q_rules.{c}").alias(c) for c in names])


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), urlfilter.rules_frame(spark, RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_digests(table(spark, sf_dir, "conversations"), hurt=True)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), k=20)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_language_id": op2_language_id,
        "op3_chat_format": op3_chat_format,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_simhash_dedup": op5_simhash_dedup,
        "op6_nearest": op6_nearest,
        "op7_token_counts": op7_token_counts,
        "op8_source_mix": op8_source_mix,
        "op9_html_text": op9_html_text,
        "op10_quality": op10_quality,
        "op11_url_filter": op11_url_filter,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_ranked_search": op13_ranked_search,
        "llm_page_language": page_language,
    }


def shard_sql() -> str:
    filled = ",".join(str(k) for k in sharding.fill_table(SHARDS, TABLE_SIZE))
    return f"""
WITH placed AS (
  SELECT doc_id, source, n_chars, (('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT) % {TABLE_SIZE} AS slot FROM documents),
lookup AS (SELECT string_split('{filled}', ',') AS t)
SELECT doc_id, source, n_chars, slot, printf('shard-%03d', CAST(t[slot + 1] AS INTEGER)) AS shard FROM placed, lookup"""


CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
made AS (
  SELECT *, replace(replace(replace(text, '\', '\s'), '<turn>', '\lturn>'), '</turn>', '\l/turn>') AS body,
    replace(replace(replace(replace(role, '\', '\s'), '<turn>', '\lturn>'), '</turn>', '\l/turn>'), chr(10), '\n') AS head FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length('<turn>' || head || chr(10) || body || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM made GROUP BY conv_id"""


def mix_sql(seed: str = "mix", rounds: int = 12, apart: float = 0.05) -> str:
    draw = lambda salt, key: f"((('0x' || substr(md5('{salt}|' || {key}), 1, 13))::BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE"
    steps = ["scale0 AS (SELECT source AS s, max(gap) / sum(size * w) AS c FROM wanted GROUP BY source)"]
    for turn in range(rounds):
        steps.append(f"""
scale{turn + 1} AS (SELECT s, greatest(max(c), CASE WHEN sum(CASE WHEN c * w >= 1 THEN 0 ELSE size * w END) > 0
    THEN (max(gap) - sum(CASE WHEN c * w >= 1 THEN size ELSE 0 END)) / sum(CASE WHEN c * w >= 1 THEN 0.0::DOUBLE ELSE size * w END) END) AS c
  FROM wanted JOIN scale{turn} ON source IS NOT DISTINCT FROM s GROUP BY s)""")
    return f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS BIGINT) AS size FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, list_value(5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE)[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight FROM docs GROUP BY source),
level(step, lv, held) AS (
  SELECT 0, 1.5::DOUBLE * sum(source_size)::DOUBLE / sum(weight), 0 FROM per
  UNION ALL
  SELECT step + 1, new_lv, full_n FROM (
    SELECT l.step, l.held, (SELECT count(*) FROM per WHERE source_size * 2.0::DOUBLE < weight * l.lv) AS full_n,
      (1.5::DOUBLE * (SELECT sum(source_size) FROM per)::DOUBLE - (SELECT coalesce(sum(source_size * 2.0::DOUBLE), 0) FROM per WHERE source_size * 2.0::DOUBLE < weight * l.lv))
        / (SELECT sum(weight) FROM per WHERE NOT source_size * 2.0::DOUBLE < weight * l.lv) AS new_lv FROM level l) WHERE full_n > held),
targets AS (SELECT source, source_size, least(source_size * 2.0::DOUBLE, weight * (SELECT lv FROM level ORDER BY step DESC LIMIT 1)) AS target FROM per),
base AS (
  SELECT d.*, t.source_size, t.target, CAST(CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS BIGINT) AS whole, sqrt(size) AS w,
    {draw(seed, "CAST(doc_id AS VARCHAR)")} AS u
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
drawn AS (SELECT *, target - whole * source_size AS gap FROM base),
wanted AS (SELECT * FROM drawn WHERE size > 0 AND gap > 0),
{",".join(steps)},
ranked AS (
  SELECT *, row_number() OVER o AS place, sum(size) OVER (o ROWS UNBOUNDED PRECEDING) AS total FROM (
    SELECT *, CASE WHEN p >= 1 THEN 0.0::DOUBLE ELSE (u / (1 - u)) / (p / (1 - p)) END AS odds, size > gap * {apart}::DOUBLE AS big
    FROM (SELECT wanted.*, least(c * w, 1.0::DOUBLE) AS p FROM wanted JOIN scale{rounds} ON source IS NOT DISTINCT FROM s))
  WINDOW o AS (PARTITION BY source, big ORDER BY odds, doc_id, size)),
number AS (SELECT source AS s, floor(sum(p)) + CASE WHEN {draw(seed + " number", "coalesce(source, '')")} < sum(p) - floor(sum(p)) THEN 1 ELSE 0 END AS n FROM ranked WHERE big GROUP BY source),
large AS (SELECT r.* FROM ranked r JOIN number ON source IS NOT DISTINCT FROM s WHERE big AND place <= n),
used AS (SELECT source AS s, sum(size) AS words FROM large GROUP BY source),
small AS (SELECT r.*, gap - coalesce(words, 0) AS rest FROM ranked r LEFT JOIN used ON source IS NOT DISTINCT FROM s WHERE NOT big),
extra AS (SELECT rid FROM large UNION ALL SELECT rid FROM small WHERE total <= rest
  OR (total - size < rest AND {draw(seed + " end", "coalesce(source, '')")} * size < rest - (total - size)))
SELECT doc_id, source, size, source_size, target, CAST((whole + CASE WHEN rid IN (SELECT rid FROM extra) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM drawn"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": shard_sql(), "op3_chat_format": CHAT_SQL, "op8_source_mix": mix_sql(), "op11_url_filter": url_sql(RULES), "op12_conversation_repair": repair_sql(), "op13_ranked_search": SEARCH_SQL}


__all__ = ["SPACE_CLASS", "oracle_sql", "pipeline", "queries"]
