"""Registered queries of the services' mappers: landed answers of table size, made of the driver tables, against SQL that
takes the same values from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.plans.tables import read
from citespark.sources import records as r

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return register


K = F.col
_LISTS = ("authors", "tags")


def _answers(spark: SparkSession, sf_dir: str, body) -> DataFrame:
    """(key, body) for each part, key its number; body(k, s) is JSON of the part's columns."""
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(k.cast("string").alias("key"), body(k, k.cast("string")).alias("body"))


def _named(**fields: Column) -> Column:
    return F.struct(*(c.alias(n.replace("__", "-")) for n, c in fields.items()))


def _shown(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("key", *(F.array_join(c, "|").alias(c) if c in _LISTS else F.col(c) for c in columns))


def _lit(*values: str) -> Column:
    return F.array(*map(F.lit, values))


_KEY = "CAST(p_partkey AS VARCHAR) AS key"
_COUNT = "CAST(p_partkey % 5 AS BIGINT) AS citation_count, CASE WHEN p_partkey % 5 > 0 THEN CAST(p_partkey % 5 AS VARCHAR) ELSE '' END AS tags"


def _kinds(codes: list[str], types: list[str]) -> str:
    return f"{types}[p_partkey % {len(codes)} + 1] AS type"


_CROSSREF_CODES = ["journal-article", "report", "posted-content", "book-chapter", "proceedings-article", "book", "other"]


@query(f"""SELECT {_KEY}, '10.1/' || p_partkey AS doi, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN 'Ng|Big Group' ELSE 'Big Group' END AS authors, CAST(1990 + p_size AS VARCHAR) AS year,
(1990 + p_size) || '-' || (p_partkey % 12 + 1) || '-' || (p_partkey % 28 + 1) AS publish_date, p_brand AS venue, p_type || ' One.' AS abstract, {_COUNT}, 'https://doi.org/10.1/' || p_partkey AS url,
{_kinds(_CROSSREF_CODES, ['journalArticle', 'report', 'preprint', 'bookSection', 'conferencePaper', 'book', 'journalArticle'])} FROM part""")
def crossref_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    def body(k, s):
        date = _named(date__parts=F.array(F.array(K("p_size") + 1990, (k % 12 + 1).cast("int"), (k % 28 + 1).cast("int"))))
        people = F.array(_named(family=F.when(k % 3 == 0, "Ng"), name=F.lit(None).cast("string")), _named(family=F.lit(None).cast("string"), name=F.lit("Big Group")))
        fields = _named(DOI=F.concat(F.lit("10.1/"), s), title=F.array(F.concat(F.lit("<i>"), "p_name", F.lit("</i>"))), author=people, published=F.when(k % 2 == 0, date), created=date, is__referenced__by__count=k % 5, type=F.element_at(_lit(*_CROSSREF_CODES), (k % 7 + 1).cast("int")), URL=F.concat(F.lit("https://doi.org/10.1/"), s), abstract=F.concat(F.lit("<p>"), "p_type", F.lit("</p>\n<p>One.</p>")), container__title=F.array("p_brand"))
        return F.to_json(fields)

    return _shown(r.crossref_works(_answers(spark, sf_dir, body)), "doi", "title", "authors", "year", "publish_date", "venue", "abstract", "citation_count", "tags", "url", "type")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS key, CAST(n AS BIGINT) AS number, CASE o_orderkey % 4 WHEN 0 THEN 'Lee et al., 2011, On order ' || o_orderkey || ', Geo, 3, 9' WHEN 1 THEN '2012, Series ' || o_orderkey WHEN 2 THEN 'doi:10.9/z' || o_orderkey ELSE 'k' || o_orderkey END AS text,
CASE o_orderkey % 4 WHEN 0 THEN 'On order ' || o_orderkey WHEN 1 THEN 'Series ' || o_orderkey END AS title, CASE WHEN o_orderkey % 4 = 0 THEN 'Lee' ELSE '' END AS authors, CASE o_orderkey % 4 WHEN 0 THEN '2011' WHEN 1 THEN '2012' END AS year,
CASE WHEN o_orderkey % 4 = 2 THEN '10.9/z' || o_orderkey END AS doi, CASE WHEN o_orderkey % 4 = 2 THEN 'https://doi.org/10.9/z' || o_orderkey END AS url, CASE WHEN o_orderkey % 4 = 1 THEN 'book' ELSE 'journalArticle' END AS type FROM o""")
def crossref_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A work a customer, whose references are its orders: some with all fields, a series, a DOI or a key only."""
    k = F.col("o_orderkey")
    s, some = k.cast("string"), lambda rest, c: F.when(k % 4 == rest, c)
    fields = {"author": some(0, F.lit("Lee")), "year": some(0, F.lit("2011")), "article-title": some(0, F.concat(F.lit("On order "), s)), "journal-title": some(0, F.lit("Geo")), "volume": some(0, F.lit("3")), "first-page": some(0, F.lit("9")), "series-title": some(1, F.concat(F.lit("Series "), s)), "DOI": some(2, F.concat(F.lit("10.9/z"), s)), "key": F.concat(F.lit("k"), s), "type": some(1, F.lit("book"))}
    fields["year"] = F.coalesce(fields["year"], some(1, F.lit("2012")))
    refs = F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), F.struct(*(c.alias(n) for n, c in fields.items())).alias("r")))), lambda x: x["r"])
    works = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("key")).agg(F.to_json(F.struct(refs.alias("reference"))).alias("body"))
    return r.crossref_references(works).select("key", "number", "text", "title", F.array_join("authors", "|").alias("authors"), "year", "doi", "url", "type")


_OPENALEX_CODES = ["article", "preprint", "book", "book-chapter", "dissertation", "editorial"]


@query(f"""SELECT {_KEY}, 'W' || p_partkey AS openalex, CASE WHEN p_partkey % 2 = 0 THEN '10.1/' || p_partkey END AS doi, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) END AS pmid, p_name AS title, 'A Ng' AS authors, CAST(1990 + p_size AS VARCHAR) AS year,
(1990 + p_size) || '-01-05' AS publish_date, p_brand AS venue, p_brand || ' and ' || p_type || ' and' AS abstract, {_COUNT}, CASE WHEN p_partkey % 2 = 0 THEN 'https://doi.org/10.1/' || p_partkey ELSE 'https://openalex.org/W' || p_partkey END AS url,
CASE WHEN p_partkey % 4 = 0 THEN 'https://x.org/' || p_partkey END AS oa_url, {_kinds(_OPENALEX_CODES, ['journalArticle', 'preprint', 'book', 'bookSection', 'thesis', 'journalArticle'])}, CASE WHEN p_partkey % 7 = 0 THEN true END AS retracted FROM part""")
def openalex_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    def body(k, s):
        index = F.create_map(K("p_brand"), F.array(F.lit(0)), F.lit("and"), F.array(F.lit(3), F.lit(1)), K("p_type"), F.array(F.lit(2)))
        people = F.array(_named(author=_named(display_name=F.lit("A Ng"))), _named(author=_named(display_name=F.lit(None).cast("string"))))
        fields = _named(id=F.concat(F.lit("https://openalex.org/W"), s), doi=F.when(k % 2 == 0, F.concat(F.lit("https://doi.org/10.1/"), s)), ids=_named(pmid=F.when(k % 3 == 0, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), s))), authorships=people, cited_by_count=k % 5, open_access=_named(oa_url=F.when(k % 4 == 0, F.concat(F.lit("https://x.org/"), s))), display_name=K("p_name"), publication_year=K("p_size") + 1990, publication_date=F.concat((K("p_size") + 1990).cast("string"), F.lit("-01-05")), primary_location=_named(source=_named(display_name=K("p_brand"))), abstract_inverted_index=index, is_retracted=k % 7 == 0, type=F.element_at(_lit(*_OPENALEX_CODES), (k % 6 + 1).cast("int")))
        return F.to_json(fields)

    return _shown(r.openalex_works(_answers(spark, sf_dir, body)), "openalex", "doi", "pmid", "title", "authors", "year", "publish_date", "venue", "abstract", "citation_count", "tags", "url", "oa_url", "type", "retracted")


@query("""WITH p AS (SELECT p_partkey, unnest([p_partkey + 1, p_partkey + 2, p_partkey + 3]) AS ref, unnest([0, 1, 0]) AS pos, unnest(['reference', 'reference', 'related']) AS kind FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS key, kind, CAST(pos AS INT) AS pos, 'W' || ref AS ref_id FROM p""")
def openalex_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = lambda k, *more: F.array(*(F.concat(F.lit("https://openalex.org/W"), (k + i).cast("string")) for i in more))
    return r.openalex_lists(_answers(spark, sf_dir, lambda k, s: F.to_json(_named(referenced_works=w(k, 1, 2), related_works=w(k, 3)))))


_S2_SQL = """'p' || {k} AS s2, CASE WHEN {k} % 2 = 0 THEN '10.1/' || {k} END AS doi, CASE WHEN {k} % 3 = 0 THEN '2101.' || {k} END AS arxiv, CASE WHEN {k} % 2 > 0 AND {k} % 3 = 0 THEN 'preprint' WHEN {k} % 5 = 0 THEN 'conferencePaper' ELSE 'journalArticle' END AS type,
CASE WHEN {k} % 2 = 0 THEN 'https://doi.org/10.1/' || {k} WHEN {k} % 3 = 0 THEN 'https://arxiv.org/abs/2101.' || {k} ELSE 'https://www.semanticscholar.org/paper/p' || {k} END AS url"""


def _paper(k: Column, title: Column) -> Column:
    s = k.cast("string")
    ids = _named(DOI=F.when(k % 2 == 0, F.concat(F.lit("10.1/"), s)), ArXiv=F.when(k % 3 == 0, F.concat(F.lit("2101."), s)))
    types = F.when(k % 5 == 0, _lit("Conference")).when(k % 5 == 1, _lit("Review", "JournalArticle", "Conference"))
    return _named(paperId=F.concat(F.lit("p"), s), externalIds=ids, title=title, abstract=F.lit("About"), year=F.lit(2021), publicationDate=F.lit("2021-01-02"), authors=F.array(_named(name=F.lit("A")), _named(name=F.lit("B"))), venue=F.lit("V"), citationCount=k % 5, referenceCount=k % 9, openAccessPdf=_named(url=F.when(k % 4 == 0, F.concat(F.lit("https://x.org/"), s))), publicationTypes=types)


@query(f"""SELECT {_KEY}, {_S2_SQL.format(k='p_partkey')}, p_name AS title, 'A|B' AS authors, '2021' AS year, '2021-01-02' AS publish_date, 'V' AS venue, 'About' AS abstract, {_COUNT}, CAST(p_partkey % 9 AS BIGINT) AS reference_count,
CASE WHEN p_partkey % 4 = 0 THEN 'https://x.org/' || p_partkey END AS oa_url FROM part""")
def s2_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = r.s2_papers(_answers(spark, sf_dir, lambda k, s: F.to_json(_paper(k, K("p_name")))))
    return _shown(got, "s2", "doi", "arxiv", "type", "url", "title", "authors", "year", "publish_date", "venue", "abstract", "citation_count", "tags", "reference_count", "oa_url")


@query(f"""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 7 > 0)
SELECT CAST(o_custkey AS VARCHAR) AS key, CAST(n AS BIGINT) AS number, CASE o_orderkey % 3 WHEN 0 THEN 'methodology: used ' || o_orderkey WHEN 1 THEN 'used ' || o_orderkey END AS description, {_S2_SQL.format(k='o_orderkey')} FROM o""")
def s2_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list a customer, of its orders; one in seven has no paper and isn't numbered."""
    k = F.col("o_orderkey")
    text = F.when(k % 3 < 2, F.array(F.concat(F.lit("used "), k.cast("string")))).otherwise(F.array().cast("array<string>"))
    edge = _named(citedPaper=F.when(k % 7 > 0, _paper(k, F.lit("T"))), contexts=text, intents=F.when(k % 3 == 0, _lit("methodology")).otherwise(F.array().cast("array<string>")))
    data = F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), F.to_json(edge).alias("e")))), lambda x: x["e"])
    lists = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("key")).agg(F.concat(F.lit('{"data":['), F.array_join(data, ","), F.lit("]}")).alias("body"))
    return r.s2_edges(lists).select("key", "number", "description", "s2", "doi", "arxiv", "type", "url")


@query(f"""SELECT {_KEY}, CAST(p_partkey AS VARCHAR) AS arxiv, '10.1/' || p_partkey AS doi, p_name AS title, 'First line second' AS abstract, 'A|B' AS authors, CAST(1990 + p_size AS VARCHAR) AS year, (1990 + p_size) || '-03-04T00:00:00Z' AS publish_date, '9 pages' AS venue,
'preprint' AS type, 'https://arxiv.org/abs/' || p_partkey AS url, 'cs.CL|cs.LG' AS tags FROM part""")
def arxiv_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    def body(k, s):
        return F.concat(F.lit("<feed><entry><title> "), "p_name", F.lit("\n</title><summary>First line\nsecond</summary><published>"), (K("p_size") + 1990).cast("string"), F.lit("-03-04T00:00:00Z</published><author><name>A</name></author><author><name>B</name></author><category term=\"cs.CL\"/><category term=\"cs.LG\"/><arxiv:comment>9 pages</arxiv:comment><arxiv:doi>10.1/"), s, F.lit("</arxiv:doi></entry></feed>"))

    return _shown(r.arxiv_entries(_answers(spark, sf_dir, body)), "arxiv", "doi", "title", "abstract", "authors", "year", "publish_date", "venue", "type", "url", "tags")


@query(f"""SELECT {_KEY}, CAST(p_partkey AS VARCHAR) AS pmid, CASE WHEN p_partkey % 2 = 0 THEN '10.1/' || p_partkey END AS doi, p_name AS title, 'Ng A' AS authors, CAST(1990 + p_size AS VARCHAR) AS year, p_brand AS venue, 'Text of ' || p_type AS abstract,
'journalArticle' AS type, 'https://pubmed.ncbi.nlm.nih.gov/' || p_partkey || '/' AS url, CASE WHEN p_partkey % 7 = 0 THEN true END AS retracted FROM part WHERE p_partkey % 11 > 0""")
def pubmed_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries with their abstracts; one in eleven is an error and gives no record."""

    def body(k, s):
        ids = F.array(_named(idtype=F.lit("pii"), value=F.lit("x")), _named(idtype=F.when(k % 2 == 0, F.lit("doi")).otherwise("pmc"), value=F.concat(F.lit("10.1/"), s)))
        kinds = F.when(k % 7 == 0, _lit("Journal Article", "Retracted Publication")).otherwise(_lit("Journal Article"))
        w = _named(authors=F.array(_named(name=F.lit("Ng A"))), pubdate=F.concat((K("p_size") + 1990).cast("string"), F.lit(" Mar 4")), articleids=ids, title=K("p_name"), fulljournalname=K("p_brand"), pubtype=kinds, error=F.when(k % 11 == 0, F.lit("cannot get")))
        return F.to_json(_named(result=F.create_map(s, w)))

    text = _answers(spark, sf_dir, lambda k, s: F.concat(F.lit("\nText of "), "p_type", F.lit("\n\nPMID: "), s, F.lit("\nDOI: x")))
    return _shown(r.pubmed_summaries(_answers(spark, sf_dir, body), text), "pmid", "doi", "title", "authors", "year", "venue", "abstract", "type", "url", "retracted")


@query(f"""SELECT {_KEY}, CAST(p_partkey AS VARCHAR) AS doi, p_name AS title, 'Ada Ng|Lee' AS authors, CAST(1990 + p_size AS VARCHAR) AS year, CASE WHEN p_partkey % 2 = 0 THEN 'https://x.org/a.pdf' ELSE 'https://x.org/a' END AS oa_url, p_brand AS venue,
CASE WHEN p_partkey % 2 = 0 THEN 'book' ELSE 'journalArticle' END AS type, CASE WHEN p_partkey % 3 = 0 THEN 'OA' END AS tags FROM part""")
def unpaywall_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    def body(k, s):
        none = F.lit(None).cast("string")
        people = F.array(_named(raw_author_name=F.lit("Ada Ng"), family=F.lit("Ng"), name=none), _named(raw_author_name=none, family=F.lit("Lee"), name=F.lit("x")), _named(raw_author_name=none, family=none, name=none))
        place = _named(url_for_pdf=F.when(k % 2 == 0, "https://x.org/a.pdf"), url=F.lit("https://x.org/a"))
        return F.to_json(_named(z_authors=people, best_oa_location=place, is_oa=k % 3 == 0, title=K("p_name"), year=K("p_size") + 1990, genre=F.when(k % 2 == 0, "book").otherwise("z"), journal_name=K("p_brand")))

    return _shown(r.unpaywall_records(_answers(spark, sf_dir, body)), "doi", "title", "authors", "year", "oa_url", "venue", "type", "tags")


@query(f"""SELECT '10.1/a' || p_partkey AS key, '10.1/a' || p_partkey AS doi, p_name AS title, 'A|B' AS authors, CAST(1990 + p_size AS VARCHAR) AS year, p_type AS abstract, p_brand AS venue, CASE WHEN p_partkey % 5 > 0 THEN 'CS|' || p_partkey % 5 ELSE 'CS' END AS tags FROM part WHERE p_partkey % 3 > 0""")
def readpaper_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits for DOIs; one in three has another DOI in its details and is left out."""

    def body(k, s):
        b = lambda c: F.concat(F.lit("<em>"), c, F.lit("</em>"))
        return F.to_json(_named(title=b("p_name"), year=(K("p_size") + 1990).cast("string"), authorList=F.array(_named(name=b(F.lit("A"))), _named(name=F.lit("B"))), summary=K("p_type"), primaryVenue=K("p_brand"), venueTags=_lit("CS"), citationCount=k % 5))

    doi = F.concat(F.lit("10.1/a"), "key")
    answers = _answers(spark, sf_dir, body).withColumn("key", doi)
    details = _answers(spark, sf_dir, lambda k, s: F.when(k % 3 > 0, F.concat(F.lit("10.1/A"), s)).otherwise("10.9/x")).select(doi.alias("key"), F.col("body").alias("doi"))
    return _shown(r.readpaper_records(answers, details), "doi", "title", "authors", "year", "abstract", "venue", "tags")


@query(f"""SELECT {_KEY}, '10.1/' || p_partkey AS doi, p_name AS title, 'A|B' AS authors, CAST(1990 + p_size AS VARCHAR) AS year, 'https://doi.org/10.1/' || p_partkey AS url, p_type AS abstract, p_brand AS venue, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 5 || '|3' ELSE '' END AS tags FROM part""")
def connectedpapers_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    def body(k, s):
        text = lambda c: _named(text=c)
        people = F.array(F.array(_named(name=F.lit("A"))), F.array(_named(name=F.lit("B")), _named(name=F.lit("C"))))
        info = _named(doi=F.concat(F.lit("10.1/"), s), doiUrl=F.concat(F.lit("https://doi.org/10.1/"), s))
        stats = F.when(k % 2 == 0, _named(numCitations=k % 5, numReferences=F.lit(3)))
        return F.to_json(_named(title=text(K("p_name")), year=text((K("p_size") + 1990).cast("string")), authors=people, doiInfo=info, paperAbstract=text(K("p_type")), venue=text(K("p_brand")), citationStats=stats))

    return _shown(r.connectedpapers_records(_answers(spark, sf_dir, body)), "doi", "title", "authors", "year", "url", "abstract", "venue", "tags")
