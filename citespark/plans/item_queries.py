"""Registered queries of library items and of the smaller text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.functions import text as tx
from citespark.operators import cascade, graph, items, paging
from citespark.plans.tables import TITLES, read, titles

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return register


def _pairs(spark: SparkSession, sf_dir: str, halves: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Pairs of all orders; those of even keys are one half, those of odd ones the other."""
    o = read(spark, sf_dir, "orders").where((F.col("o_orderkey") % 2).isin(*halves))
    return o.select(F.col("o_custkey").alias("item_key"), (F.col("o_orderkey") % 97).alias("related_key")).distinct()


def _pairs_sql(half: int | None = None) -> str:
    return f"SELECT DISTINCT o_custkey AS item_key, o_orderkey % 97 AS related_key FROM orders{'' if half is None else f' WHERE o_orderkey % 2 = {half}'}"


_TURN = "SELECT related_key AS item_key, item_key AS related_key FROM"


@query(f"WITH n AS ({_pairs_sql()}) SELECT * FROM n UNION {_TURN} n")
def relations_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _pairs(spark, sf_dir)
    return items.with_relations(new.limit(0), new)


@query(f"""WITH n AS ({_pairs_sql()}), r AS (SELECT * FROM n UNION {_TURN} n), g AS (SELECT * FROM n WHERE item_key % 3 = 0)
SELECT * FROM r EXCEPT (SELECT * FROM g UNION {_TURN} g)""")
def relations_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _pairs(spark, sf_dir)
    return items.without_relations(items.with_relations(new.limit(0), new), new.where("item_key % 3 = 0"))


@query(f"""WITH n AS ({_pairs_sql(0)}), m AS ({_pairs_sql(1)}), r AS (SELECT * FROM n UNION {_TURN} n), h AS (SELECT * FROM m INTERSECT SELECT * FROM r), w AS (SELECT * FROM m EXCEPT SELECT * FROM h)
(SELECT * FROM r EXCEPT (SELECT * FROM h UNION {_TURN} h)) UNION SELECT * FROM w UNION {_TURN} w""")
def relation_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of even keys are there, and those of odd ones are toggled."""
    new = _pairs(spark, sf_dir, (0,))
    return items.toggled(items.with_relations(new.limit(0), new), _pairs(spark, sf_dir, (1,)))


@query(f"WITH n AS ({_pairs_sql()}) SELECT item_key, related_key, p_name AS title FROM n JOIN part ON p_partkey = related_key")
def own_related_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_key"), F.col("p_name").alias("title"))
    return items.related_items(_pairs(spark, sf_dir), lib).select("item_key", "related_key", "title")


@query("""SELECT p_partkey AS ref_id, CASE p_size % 3 WHEN 0 THEN 'journalArticle' WHEN 1 THEN 'book' ELSE 'preprint' END AS item_type, p_name AS title,
CASE WHEN p_partkey % 2 = 0 THEN '2020-1-5' ELSE '2019' END AS date, CASE WHEN p_size % 3 = 0 THEN p_brand END AS publication_title,
CASE WHEN p_size % 3 <> 1 THEN '10.1/' || p_partkey END AS doi, CASE WHEN p_partkey % 5 > 0 THEN 'https://x.org/' || p_partkey END AS url,
nullif(concat_ws(chr(10), CASE WHEN p_size % 3 = 1 THEN 'DOI: 10.1/' || p_partkey END, CASE WHEN p_partkey % 7 = 0 THEN 'PMID: ' || p_partkey END), '') AS extra, 'Ada Maria|Byron' AS creator FROM part""")
def item_from_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    s = k.cast("string")
    refs = read(spark, sf_dir, "part").select(
        k.alias("ref_id"), F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, "book").otherwise("preprint").alias("type"), F.col("p_name").alias("title"), F.lit("2019").alias("year"),
        F.when(k % 2 == 0, "2020-1-5").alias("publish_date"), F.col("p_brand").alias("primary_venue"), F.concat(F.lit("10.1/"), s).alias("doi"), F.when(k % 7 == 0, s).alias("pmid"), F.lit("").alias("arxiv"),
        F.when(k % 5 > 0, F.concat(F.lit("https://x.org/"), s)).otherwise("file:///x").alias("url"), F.array(F.lit(" Ada Maria  Byron "), F.lit("")).alias("authors"), F.lit("").alias("extra"),
    )
    out = items.item_rows(refs)
    return out.select("ref_id", "item_type", "title", "date", "publication_title", "doi", "url", "extra", F.array_join(F.transform("creators", lambda c: F.concat_ws("|", c["first"], c["last"])), ";").alias("creator"))


@query("""SELECT p_partkey AS ref_id, coalesce(CASE WHEN s_suppkey IS NOT NULL THEN s_name ELSE p_name END, 'Reference') AS title, CASE WHEN s_suppkey IS NOT NULL THEN 'lib' ELSE 'text' END AS abstract,
CASE WHEN s_suppkey IS NULL AND p_partkey % 2 = 0 THEN 'https://doi.org/10.1/' || p_partkey END AS url FROM part LEFT JOIN supplier ON p_partkey = s_suppkey""")
def card_local_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    k = F.col("p_partkey")
    refs = read(spark, sf_dir, "part").select(
        k.alias("ref_id"), k.alias("lib_item_id"), F.col("p_name").alias("title"), F.lit(None).cast("array<string>").alias("authors"), none.alias("year"), none.alias("venue"), F.lit("").alias("abstract"), F.lit("text").alias("text"),
        F.when(k % 2 == 0, F.concat(F.lit("10.1/"), k.cast("string"))).alias("doi"), none.alias("arxiv"), none.alias("pmid"),
    )
    lib = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item_id"), F.col("s_name").alias("title"), F.lit(None).cast("array<string>").alias("authors"), none.alias("year"), none.alias("venue"), F.lit("lib").alias("abstract"))
    return items.cards(refs, lib).select("ref_id", "title", "abstract", "url")


@query("""SELECT p_partkey AS id, concat_ws('|', CASE WHEN p_partkey % 10 = 0 THEN 'Retracted' END, 'tag', CASE WHEN p_partkey % 2 = 0 THEN 'DOI' END, CASE WHEN p_partkey % 3 = 0 THEN 'PMID' END,
CASE WHEN p_partkey % 4 = 0 THEN 'PDF' END, CASE WHEN p_partkey % 5 = 0 THEN 'Library' END, 'Scholar', CASE WHEN p_partkey % 3 > 0 THEN 'PubMed' END) AS chips FROM part""")
def card_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    s = k.cast("string")
    none = F.lit(None).cast("string")
    some = lambda n: F.when(k % n == 0, s)
    c = items.chips(F.array(F.lit("tag")), none, some(2), none, some(3), none, some(4), k % 10 == 0, F.when(k % 5 == 0, k), F.col("p_name"))
    return read(spark, sf_dir, "part").select(k.alias("id"), F.array_join(F.transform(c, lambda x: x["text"]), "|").alias("chips"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN '✓ ' ELSE '✗ ' END || CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN 'text' ELSE '#' || (o_orderkey + 1) END AS label FROM orders""")
def import_log_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    label = items.log_label(F.col("o_orderstatus") == "F", F.when(k % 3 == 0, F.col("o_orderpriority")).otherwise(""), F.when(k % 3 == 1, "text"), k)
    return read(spark, sf_dir, "orders").select(k.alias("id"), label.alias("label"))


@query("""WITH t AS (SELECT c_custkey AS id, ['note', 'book', 'journalArticle', 'thesis', 'attachment'][c_custkey % 5 + 1] AS t FROM customer)
SELECT id, t NOT IN ('attachment', 'note', 'annotation') AS regular, t NOT IN ('attachment', 'note', 'annotation') AND id % 2 = 0 AS graph, t NOT IN ('book', 'letter', 'note', 'thesis') AS refreshed FROM t""")
def item_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    t = F.element_at(F.array(*map(F.lit, ("note", "book", "journalArticle", "thesis", "attachment"))), (k % 5 + 1).cast("int"))
    c = read(spark, sf_dir, "customer").select(k.alias("id"), t.alias("t"), F.when(k % 2 == 0, "10.1/x").otherwise("").alias("doi"))
    return c.select("id", items.is_regular(F.col("t")).alias("regular"), items.has_graph(F.col("t"), F.col("doi"), F.lit(None).cast("string")).alias("graph"), items.is_refreshed(F.col("t")).alias("refreshed"))


@query("""SELECT c_custkey AS id, concat_ws('/', c_nationkey, c_name) AS key, CASE WHEN c_custkey % 3 = 0 THEN 'Byron 2001' ELSE 'A title that is rath…' END AS short,
CASE WHEN c_custkey % 3 = 0 THEN 'Byron 2001' ELSE 'A title that is ra' END AS label FROM customer""")
def labels_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    author, year, title = F.when(k % 3 == 0, " Ada Byron "), F.when(k % 3 == 0, "2001"), F.lit("A title that is rather long")
    return read(spark, sf_dir, "customer").select(k.alias("id"), items.cache_key(F.col("c_nationkey"), F.col("c_name")).alias("key"), items.short_label(author, year, title).alias("short"), graph.node_label(author, year, title).alias("label"))


_STRIPPED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(rf"""SELECT doc_id, regexp_replace({_STRIPPED.format("'[' || doc_id || ']  ' || text")}, '^(\[[0-9]+\]|[0-9]+[.)])\s*', '') AS plain,
CASE WHEN regexp_matches({_STRIPPED.format("text")}, '^[A-Z]{{1,3}}$') THEN '' ELSE regexp_replace(text, '[\s0-9]+', '', 'g') END AS bare, CASE WHEN doc_id % 2 = 0 THEN 'Poly' || lang ELSE 'Poly ' || lang END AS joined FROM documents""")
def small_text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    numbered = F.concat(F.lit("["), k.cast("string"), F.lit("]  "), "text")
    return read(spark, sf_dir, "documents").select("doc_id", tx.without_list_number(numbered).alias("plain"), tx.without_page_number("text").alias("bare"), tx.joined_lines(F.when(k % 2 == 0, "Poly-").otherwise("Poly"), F.col("lang")).alias("joined"))


def _encoded_sql(c: str) -> str:
    out = f"url_encode({c})"
    for a, b in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*"), ("%7E", "~")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


@query(f"""WITH {TITLES} SELECT page_id, {_encoded_sql("coalesce(title, '')")} AS encoded FROM ti""")
def encoded_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("page_id", tx.encode_component(F.coalesce("title", F.lit(""))).alias("encoded"))


@query("""SELECT p_partkey AS id, coalesce(CASE WHEN p_partkey % 7 = 0 THEN 's' || p_partkey END, CASE WHEN p_partkey % 2 = 0 THEN 'DOI:10.1/' || p_partkey END, CASE WHEN p_partkey % 3 = 0 THEN 'arXiv:' || p_partkey END,
CASE WHEN p_partkey % 5 = 0 THEN 'PMID:' || p_partkey END) AS paper, CASE WHEN p_partkey % 2 = 0 THEN 'F' || p_partkey END AS file_name, CASE WHEN p_partkey % 2 = 0 THEN 'CJFD' END AS db_code FROM part""")
def paper_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citespark.sources.records import s2_paper_id

    k = F.col("p_partkey")
    s = k.cast("string")
    p = s2_paper_id(F.when(k % 7 == 0, F.concat(F.lit("s"), s)), F.when(k % 2 == 0, F.concat(F.lit("10.1/"), s)), F.when(k % 3 == 0, s), F.when(k % 5 == 0, s))
    u = tx.cnki_url(F.concat(F.lit("https://x/?FileName=F"), s, F.when(k % 2 == 0, "&DbName=CJFD2015").otherwise("")))
    return read(spark, sf_dir, "part").select(k.alias("id"), p.alias("paper"), u.alias("u")).select("id", "paper", "u.file_name", "u.db_code")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey || ' / ' || o_orderkey WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE o_custkey || '+' END AS summary,
coalesce(CASE WHEN o_orderkey % 5 = 0 THEN 'lib' END, CASE WHEN o_orderkey % 7 = 0 THEN 'url' END, CASE WHEN o_orderkey % 11 = 0 THEN 'id' END) AS place FROM orders""")
def paging_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = paging.summary(F.col("o_custkey"), F.when(k % 2 == 0, k), k % 3 == 0)
    at = cascade.locate(F.when(k % 5 == 0, "lib"), F.when(k % 7 == 0, "url"), F.when(k % 11 == 0, "id"), F.lit(None).cast("string"))
    return read(spark, sf_dir, "orders").select(k.alias("id"), s.alias("summary"), at.alias("place"))


@query("""SELECT p_partkey AS id, round((0.2126 * (p_partkey % 256) + 0.7152 * (p_size % 256) + 0.0722 * 255) / 255, 6) AS luminance FROM part""")
def colour_luminance(spark: SparkSession, sf_dir: str) -> DataFrame:
    hexed = lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")
    colour = F.concat(F.lit(" #"), hexed(F.col("p_partkey") % 256), F.lower(hexed(F.col("p_size") % 256)), F.lit("FF "))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(items.luminance(colour), 6).alias("luminance"))
