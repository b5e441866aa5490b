"""Registered queries of the text functions, exports and change feeds, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.functions import text as tx
from citespark.operators import export
from citespark.plans.tables import TITLES, norm_sql, read, titles

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return register


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): the whole texts of documents, and of pages with negative ids."""
    p = read(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("id"), F.col("html").alias("text"))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(p)


_VALUES = "v AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - page_id, html FROM pages)"
_TIGHT = r"regexp_replace(text, '\s+', '', 'g')"
_DOI_SQL = rf"nullif(regexp_replace(regexp_extract({_TIGHT}, '10\.[0-9]{{4,9}}/[-._;()/:A-Za-z0-9<>]+[^.\]\s]'), '[.,;]+$', ''), '')"
_ARXIV_SQL = rf"coalesce(nullif(regexp_extract({_TIGHT}, '(?i)arXiv[.:]([0-9]{{4}}\.[0-9]{{4,5}}(?:v[0-9]+)?)', 1), ''), nullif(regexp_extract({_TIGHT}, '(?i)arXiv[.:]([a-z-]+(?:\.[A-Z]{{2}})?/[0-9]{{7}})', 1), ''))"
_PMID_SQL = r"nullif(regexp_extract(text, '(?i)PMID[:\s]*([0-9]{6,9})', 1), '')"


@query(f"WITH {_VALUES} SELECT id, {_DOI_SQL} AS doi, {_ARXIV_SQL} AS arxiv, {_PMID_SQL} AS pmid FROM v")
def extract_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("id", tx.identifiers("text").alias("i")).select("id", "i.*")


@query(f"WITH {_VALUES} SELECT id, nullif(regexp_extract(text, 'https?://[^\\s]+[^\\s.,;)\\]]'), '') AS url FROM v")
def extract_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("id", tx.first_url("text").alias("url"))


@query(rf"WITH {_VALUES} SELECT id, regexp_full_match(text, '10\.[0-9]{{4,9}}/[-._;()/:A-Za-z0-9<>]+[^.\]\s]') AND NOT regexp_matches(text, '(?i)cnki|issn') AS is_doi FROM v")
def is_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("id", tx.is_doi("text").alias("is_doi"))


@query("""WITH u AS (SELECT page_id, url FROM pages UNION ALL SELECT -page_id - 1, 'ftp' || url FROM pages UNION ALL SELECT page_id + 1000000, url || ' x' FROM pages)
SELECT page_id, regexp_full_match(url, '(?i)https?://\\S+') AS is_http FROM u""".replace("\\\\", "\\"))
def is_http_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    u = p.unionByName(p.select((-F.col("page_id") - 1).alias("page_id"), F.concat(F.lit("ftp"), "url").alias("url"))).unionByName(p.select((F.col("page_id") + 1000000).alias("page_id"), F.concat("url", F.lit(" x")).alias("url")))
    return u.select("page_id", tx.is_http_url("url").alias("is_http"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '10.1000/p' || page_id WHEN page_id % 4 = 0 THEN '10.2000/e' || page_id END AS doi,
CASE WHEN page_id % 5 = 0 THEN '2101.' || lpad(CAST(page_id AS VARCHAR), 5, '0') END AS arxiv, CASE WHEN page_id % 4 = 0 THEN CAST(page_id + 1000000 AS VARCHAR) END AS pmid FROM pages""")
def host_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    s = p.cast("string")
    doi = F.when(p % 3 == 0, F.concat(F.lit(" 10.1000/p"), s, F.lit(" "))).otherwise("  ")
    url = F.when(p % 5 == 0, F.concat(F.lit("http://arxiv.org/pdf/2101."), F.lpad(s, 5, "0"), F.lit(".pdf"))).otherwise(F.col("url"))
    extra = F.when(p % 4 == 0, F.concat(F.lit("tex: x\ndoi: 10.2000/e"), s, F.lit("\npmid: "), (p + 1000000).cast("string"))).otherwise("xDOI: 10.9/no")
    return read(spark, sf_dir, "pages").select("page_id", tx.host_identifiers(doi, url, extra).alias("i")).select("page_id", "i.*")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'https://doi.org/10.1/' || p_partkey WHEN p_partkey % 3 = 0 THEN 'https://arxiv.org/abs/' || p_partkey
WHEN p_partkey % 5 = 0 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || p_partkey || '/' WHEN p_partkey % 7 = 0 THEN 'https://openalex.org/W' || p_partkey END AS url FROM part""")
def identifier_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_partkey").cast("string")
    url = tx.identifier_url(F.when(k % 2 == 0, F.concat(F.lit("10.1/"), s)), F.when(k % 3 == 0, s), F.when(k % 5 == 0, s), None, F.when(k % 7 == 0, F.concat(F.lit("W"), s)))
    return read(spark, sf_dir, "part").select(k.alias("id"), url.alias("url"))


@query(f"SELECT doc_id, {norm_sql('text')} AS title_key FROM documents")
def normalize_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", tx.normalize_title("text").alias("title_key"))


def _plain_sql(c: str) -> str:
    out = rf"regexp_replace({c}, '</?[A-Za-z][^>]*>', '', 'g')"
    for entity, plain in tx.ENTITIES.items():
        out = f"replace({out}, '{entity}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return rf"regexp_replace(regexp_replace({out}, '\n+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


def _clean_sql(c: str) -> str:
    out = rf"regexp_replace({_plain_sql(c)}, '\s+', ' ', 'g')"
    out = rf"regexp_replace({out}, ' +([-–])(\S)', '\1\2', 'g')"
    out = rf"regexp_replace({out}, ' +([,.;:!?)])', '\1', 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '\( +', '(', 'g'), '^\s+|\s+$', '', 'g')"
    return f"CASE WHEN contains({c}, '<') OR contains({c}, '&') THEN {out} ELSE {c} END"


@query(f"WITH {TITLES} SELECT page_id, {_clean_sql('title')} AS title FROM ti")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("page_id", tx.clean_text("title").alias("title"))


@query(f"SELECT page_id, {_plain_sql(r'''regexp_extract(html, '<h1>(.*?)</h1>', 1)''')} AS heading FROM pages")
def html_title_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.regexp_extract("html", "<h1>(.*?)</h1>", 1)
    return read(spark, sf_dir, "pages").select("page_id", tx.html_text(h).alias("heading"))


@query("SELECT page_id, i - 1 AS pos, l AS href FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS l, generate_subscripts(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), 1) AS i FROM pages)")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    return p.select("page_id", F.col("pos").cast("long").alias("pos"), "href")


@query(rf"""WITH {_VALUES}, t AS (SELECT id, {_TIGHT} AS t FROM v)
SELECT id, 2 * (length(t) - length(regexp_replace(t, '[一-龥]', '', 'g'))) > length(t) AS is_chinese FROM t""")
def is_chinese(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("id", tx.is_chinese("text").alias("is_chinese"))


@query("SELECT doc_id, CASE WHEN length(text) > 35 THEN left(text, 35) || '…' ELSE text END AS short FROM documents")
def collapse_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", tx.collapse("text").alias("short"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'and')")
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where(tx.keyword_match("text", F.lit("The，and "))).select("doc_id")


@query(rf"""WITH {_VALUES}, t AS (SELECT id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM v)
SELECT id, CAST(coalesce(nullif(regexp_extract(t, '^[\[(]?([0-9]{{1,3}})\s*[\].)]\s*[^0-9\s.]', 1), ''),
nullif(regexp_extract(t, '^[\[(]?([0-9]{{1,3}})\s+[\p{{L}}\[(“"'']', 1), ''), '0') AS INT) AS number FROM t""")
def num_at_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("id", tx.list_number("text").alias("number"))


_CLASSES = " ".join(f"WHEN regexp_matches(t, '{p}') OR regexp_matches(s, '{p}') THEN {i}" for i, p in enumerate(tx.ENTRY_STARTS))


@query(rf"""WITH {_VALUES}, t AS (SELECT id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, {_TIGHT} AS s FROM v) SELECT id, CAST(CASE {_CLASSES} ELSE -1 END AS INT) AS class FROM t""")
def ref_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("id", tx.entry_class("text").alias("class"))


@query(rf"""WITH {_VALUES}, t AS (SELECT id, text, {_TIGHT} AS t FROM v)
SELECT id, regexp_matches(t, '(?i)参考文献|reference|bibliography') AND length(t) < 20 AND NOT regexp_matches(t, '(?i)references?\(?[0-9]') AS heading,
regexp_matches(text, '{tx.TRAILING.replace(chr(39), chr(39) * 2)}') AS trailing FROM t""")
def heading_and_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("id", tx.is_heading("text").alias("heading"), tx.is_trailing("text").alias("trailing"))


@query()
def parse_ref_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("id", tx.parse_reference("text", 2026).alias("p")).select("id", "p.*")


@query("""SELECT o_orderkey AS id, CAST(year(o_orderdate) AS VARCHAR) AS year, strftime(o_orderdate, '%b %Y') AS shown FROM orders""")
def year_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.date_format("o_orderdate", "yyyy-MM-dd")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), tx.year_in(F.concat(F.lit("on "), s)).alias("year"), tx.display_date(s).alias("shown"))


@query("""SELECT p_partkey AS id, coalesce(map_extract(MAP {'PROMO': 'report', 'STANDARD': 'book', 'ECONOMY': 'preprint'}, string_split(p_type, ' ')[1])[1], 'journalArticle') AS type FROM part""")
def type_map_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citespark.sources.records import mapped_type

    kind = F.get(F.split("p_type", " "), F.lit(0))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), mapped_type(kind, {"PROMO": "report", "STANDARD": "book", "ECONOMY": "preprint"}).alias("type"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents WHERE text <> '')
SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS abstract FROM w GROUP BY doc_id""")
def abstract_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts' words as an inverted index, and back."""
    from citespark.sources.records import abstract_of_index

    w = read(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    lists = w.groupBy("doc_id", "word").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    index = lists.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("index"))
    return index.select("doc_id", abstract_of_index(F.col("index")).alias("abstract"))


# ---------------------------------------------------------------- exports

_PART = "SELECT p_partkey AS k, p_name AS t, CASE WHEN p_partkey % 2 = 0 THEN 'https://x.org/' || p_partkey END AS url, CASE WHEN p_partkey % 3 = 0 THEN '10.1/\"' || p_partkey END AS doi FROM part"


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    s = k.cast("string")
    return read(spark, sf_dir, "part").select(k.alias("k"), F.col("p_name").alias("t"), F.when(k % 2 == 0, F.concat(F.lit("https://x.org/"), s)).alias("url"), F.when(k % 3 == 0, F.concat(F.lit('10.1/"'), s)).alias("doi"), "p_brand", "p_size")


@query(f"WITH p AS ({_PART}) SELECT k, '[' || k || '] ' || CASE WHEN k % 5 = 0 THEN t ELSE 'text ' || k END AS line FROM p")
def export_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return _part(spark, sf_dir).select("k", export.text_line(F.when(k % 7 > 0, k), k, F.when(k % 5 > 0, F.concat(F.lit("text "), k.cast("string"))).otherwise(""), F.col("t")).alias("line"))


@query(f"WITH p AS ({_PART}) SELECT k, k || '. ' || CASE WHEN coalesce(url, doi) IS NOT NULL THEN '[' || t || '](' || coalesce(url, 'https://doi.org/' || doi) || ')' ELSE t END AS line FROM p")
def export_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return _part(spark, sf_dir).select("k", export.markdown_line(F.col("k"), F.col("k"), none, F.col("t"), F.col("url"), F.col("doi")).alias("line"))


@query(f"""WITH p AS ({_PART}) SELECT k, k || ',"' || t || '","a; b","' || coalesce(replace(doi, '"', '""'), '') || '","' || coalesce(url, '') || '"' AS line FROM p""")
def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select("k", export.csv_line(F.col("k"), F.col("t"), F.array_join(F.array(F.lit("a"), F.lit("b")), "; "), F.col("doi"), F.col("url")).alias("line"))


@query("""SELECT p_partkey AS k, concat_ws(' ', CASE WHEN p_partkey % 5 > 3 THEN 'A1, A2, A3 et al.' WHEN p_partkey % 5 > 0 THEN array_to_string(['A1', 'A2', 'A3', 'A4'][1:p_partkey % 5], ', ') END,
CASE WHEN p_size > 5 THEN '(' || (1990 + p_size) || ').' END, p_name || '.', p_brand || '.', CASE WHEN p_partkey % 3 = 0 THEN 'https://doi.org/10.1/"' || p_partkey END) AS line FROM part""")
def citation_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    authors = F.slice(F.array(*(F.lit(f"A{i}") for i in range(1, 5))), F.lit(1), (F.col("k") % 5).cast("int"))
    year = F.when(F.col("p_size") > 5, (F.col("p_size") + 1990).cast("string"))
    return _part(spark, sf_dir).select("k", export.citation(authors, year, F.col("t"), F.col("p_brand"), F.col("doi")).alias("line"))


# ---------------------------------------------------------------- sequences and feeds


@query("""WITH e AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p, value FROM events),
g AS (SELECT *, sum(CASE WHEN event_type IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT event_id, CAST(run AS BIGINT) AS run, min(value) OVER (PARTITION BY user_id, run) AS column_offset FROM g""")
def gaps_islands_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citespark.operators.layout import column_runs

    e = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("part"), F.col("event_id").alias("seq"), F.col("event_type").alias("column"), F.lit(1).alias("page"), F.col("value").alias("x"))
    return column_runs(e).select("event_id", "run", F.col("offset").alias("column_offset"))


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CAST(floor(value) AS BIGINT) % 4 AS n FROM events),
s AS (SELECT a.user_id, min(a.i) AS start FROM e a WHERE a.n = 1 AND a.i <= 12 AND EXISTS (SELECT 1 FROM e b WHERE b.user_id = a.user_id AND b.n = 2 AND b.i > a.i AND b.i < a.i + 40) GROUP BY a.user_id)
SELECT user_id AS doc_id, start FROM s""")
def numbered_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citespark.operators.layout import numbered_starts

    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), (F.floor("value").cast("long") % 4).alias("number"))
    return numbered_starts(e)


@query("""WITH l AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS i FROM events)
SELECT user_id AS item_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'add' ELSE 'modify' END AS event FROM l WHERE i = 1 AND event_type <> 'error'""")
def change_feed_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citespark.streaming.feed import latest_items

    kind = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "delete").otherwise("modify")
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("item_id"), kind.alias("event"))
    return latest_items(e).select("item_id", "seq", "event")


@query("""SELECT a.user_id AS reader, a.event_id AS up_id, b.event_id AS nav_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click'
AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR""")
def nav_correlation_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hour instead of 300 ms, for these tables."""
    from citespark.streaming.feed import correlate

    e = read(spark, sf_dir, "events").select("ts", F.col("user_id").alias("reader"), "event_id", "event_type")
    ups = e.where("event_type = 'view'").select("ts", "reader", F.col("event_id").alias("up_id"))
    navs = e.where("event_type = 'click'").select("ts", "reader", F.col("event_id").alias("nav_id"))
    return correlate(ups, navs, "INTERVAL 1 HOUR").select("reader", "up_id", "nav_id")


# ---------------------------------------------------------------- sources


@query()
def source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all providers from sample answers."""
    from citespark.sources import samples as s

    return s.records(spark)


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
p AS (SELECT *, (i - 1) // 12 AS page FROM o),
e AS (SELECT *, translate(CAST(o_orderkey AS VARCHAR), '0123456789', 'abcdefghij') AS name FROM p)
SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CAST(i AS BIGINT) AS number, 'Smith K, Lee P. A study of ' || name || ' with many results of ' || name || '. Journal of Orders ' || year(o_orderdate) || '; 12: 1-9. doi:10.1000/o' || name AS text,
'10.1000/o' || name AS doi, 'https://doi.org/10.1000/o' || name AS url, CAST(page + 1 AS INT) AS page FROM e""")
def pdf_bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of made-up pages: those of each customer are its orders."""
    from citespark.operators.layout import bibliography
    from citespark.sources.samples import order_pages

    return bibliography(order_pages(read(spark, sf_dir, "orders"))).select("doc_id", "number", "text", "doi", "url", "page")
