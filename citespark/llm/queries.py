"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tokenizer of op5 and of the pipeline; a file in the folder of public_tokenizers.
TOKENIZER = "word_bpe_49k.json"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citespark.llm.minhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), shingle=3, threshold=0.85)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archives and reads them back. Digests and sizes of responses are of the payload as read."""
    from citespark.llm.common import materialize
    from citespark.llm.warc import folder_for, read_warc, write_warc

    folder = folder_for(spark)
    archives = materialize(write_warc(_read(spark, sf_dir, "pages"), folder), "archives")
    got = read_warc(archives, folder)
    return got.select(
        "page_id",
        F.coalesce(F.length("payload"), "payload_bytes").cast("long").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), "payload_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citespark.llm.decontam import contamination

    found = contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citespark.llm.linededup import line_report

    return line_report(_read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citespark.llm.packing import pack_documents

    pieces = pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citespark.llm.quality import judged

    return judged(_read(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citespark.llm.pii import personal_data

    found = personal_data(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_added", (F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone") + F.col("n_added")).alias("n_spans"), F.sha2("base", 256).alias("base_sha256"), "spans")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citespark.llm.urlfilter import judged_urls

    return judged_urls(_read(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citespark.llm.substring import without_repeats

    return without_repeats(_read(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and one made up of control strings, and reads turns and loss back from the output."""
    from citespark.llm.chat import format_conversations, read_loss, read_turns, text_parts

    tricky = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = format_conversations(rows.withColumn("parts", text_parts(F.col("text"))))
    out = out.withColumn("_turns", read_turns(F.col("formatted"))).withColumn("_loss", read_loss(F.col("formatted"), F.col("loss_mask")))
    return out.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_warc,
        op3_decontamination,
        op4_line_dedup,
        op5_packing,
        op6_quality_rules,
        op7_personal_data,
        op8_url_filter,
        op9_substring_dedup,
        op10_chat_formatting,
    )
}

_WORDS3 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _escaped(text: str) -> str:
    from citespark.llm.chat import CONTROL

    for plain, code in CONTROL.items():
        text = f"replace({text}, '{plain}', '{code}')"
    return text


ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]))
             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS n, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (n - k)), d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT r.v, d.b FROM r JOIN d ON r.c = d.a),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, c = doc_id AS kept FROM s JOIN m ON v = doc_id""",
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, strlen(t) AS n, sha256(t) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d LEFT JOIN f ON d.h = f.h AND d.n >= 100""",
    "op3_decontamination": f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS3}') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORDS3}') AS w FROM benchmark),
k AS (SELECT item_id, w, least(len(w), 10) AS k FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM k)),
ks AS (SELECT DISTINCT k FROM win),
own AS (SELECT doc_id, i, k, array_to_string(w[i:i+k-1], ' ') AS g
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, own.k, item_id FROM own JOIN win ON own.k = win.k AND own.g = win.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS l
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.l, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op4_line_dedup": """
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
b AS (SELECT trim(line) AS t, min(doc_id) AS first FROM l WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 5),
j AS (SELECT doc_id, i, line, first IS NOT NULL AND doc_id <> first AS gone FROM l LEFT JOIN b ON trim(line) = t),
g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS r, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM j GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, CASE WHEN text IS NOT NULL THEN kept END AS text
FROM documents LEFT JOIN g USING (doc_id)""",
    "op10_chat_formatting": f"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
             sum(length('<|' || {_escaped("role")} || '|>' || chr(10) || {_escaped("text")} || '<|end|>' || chr(10))) AS chars
      FROM m GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM g""",
}
