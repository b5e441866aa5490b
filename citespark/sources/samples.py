"""Made-up answers of the services, and made-up pages, for queries and tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citespark.sources import records as r

CROSSREF = """{"DOI":"10.1000/a1","title":["Growth of <i>things</i> &amp; more"],"author":[{"family":"Ng"},{"name":"Big Group"},{}],
"published":{"date-parts":[[2020,1,5]]},"is-referenced-by-count":7,"type":"posted-content","URL":"https://doi.org/10.1000/a1",
"abstract":"<p>One.</p>\\n<p>Two.</p>","container-title":["J. Growth"],"reference":[
{"unstructured":"Smith J. A study of things that happen often. J Stud. 2019; 12: 1. doi:10.1234/x.1"},
{"author":"Lee","year":"2011","article-title":"On lines","journal-title":"Geo","volume":"3","first-page":"9"},
{"series-title":"Lectures","year":"1999"},{"DOI":"10.9/z"},{"key":"k5"},{}]}"""
OPENALEX = """{"id":"https://openalex.org/W1","doi":"https://doi.org/10.1000/a1","ids":{"pmid":"https://pubmed.ncbi.nlm.nih.gov/123456"},
"authorships":[{"author":{"display_name":"A Ng"}},{"author":{}}],"cited_by_count":0,"open_access":{"oa_url":"https://x.org/a.pdf"},
"display_name":"Growth of things","publication_year":2020,"publication_date":"2020-01-05","primary_location":{"source":{"display_name":"J. Growth"}},
"abstract_inverted_index":{"of":[1],"Growth":[0,3],"things":[2]},"is_retracted":true,"type":"dissertation","referenced_works":["https://openalex.org/W2","https://openalex.org/W9"],"related_works":["https://openalex.org/W3"]}"""
S2 = """{"paperId":"p1","externalIds":{"ArXiv":"2101.00001"},"title":"Nets","abstract":"About nets","year":2021,"publicationDate":"2021-01-02",
"authors":[{"name":"B Li"}],"venue":"V","citationCount":3,"referenceCount":2,"openAccessPdf":{"url":"https://x.org/b.pdf"},"publicationTypes":["Conference"]}"""
S2_EDGES = """{"data":[{"citedPaper":{"paperId":"q1","title":"One"},"contexts":["as in"],"intents":["background"]},{"citedPaper":null},
{"citedPaper":{"paperId":"q2","title":"Two","externalIds":{"DOI":"10.1/q2"}}}],"next":3}"""
ARXIV = """<feed><entry><title>Nets
 for all</title><summary>We build
 nets.</summary><published>2021-01-02T00:00:00Z</published><author><name>B Li</name></author><author><name>C Wu</name></author>
<category term="cs.LG"/><category term="stat.ML"/><arxiv:comment>12 pages</arxiv:comment><arxiv:doi>10.1/n</arxiv:doi></entry></feed>"""
PUBMED = """{"result":{"123456":{"authors":[{"name":"Ng A"}],"pubdate":"2020 Jan 5","articleids":[{"idtype":"pii","value":"x"},{"idtype":"doi","value":"10.1000/a1"}],
"title":"Growth of things.","fulljournalname":"Journal of Growth","pubtype":["Journal Article","Retracted Publication"]}}}"""
PUBMED_TEXT = "1. J Growth. 2020.\n\nGrowth is good.\n\nDOI: 10.1000/a1\nPMID: 123456"
UNPAYWALL = """{"z_authors":[{"raw_author_name":"A Ng"},{"family":"Li"}],"best_oa_location":{"url":"https://x.org/c"},"is_oa":true,"oa_status":"gold","title":"Growth","year":2020,
"genre":"book-chapter","journal_name":"J. Growth","published_date":"2020-01-05"}"""
READPAPER = """{"title":"<b>Growth</b>","year":"2020","publishDate":"2020-01-05","authorList":[{"name":"A &amp; B"}],"summary":"s","primaryVenue":"J","venueTags":["Q1"],"citationCount":4}"""
CONNECTED = """{"title":{"text":"Growth"},"year":{"text":"2020"},"authors":[[{"name":"A Ng"}],[]],"doiInfo":{"doi":"10.1000/a1","doiUrl":"https://doi.org/10.1000/a1"},
"paperAbstract":{"text":"a"},"venue":{"text":"J"},"citationStats":{"numCitations":0,"numReferences":5}}"""
CNKI = """<table class="result-table-list"><tbody><tr><td class="seq"><input value="E1"/></td><td class="name"><a class="fz14" href="/kcms/a?filename=F1&dbname=CJFD2015">一种新的<font>方法</font></a></td>
<td class="author"><a>王小明</a>; <a>李雷</a></td><td class="source"><a>中国科学</a></td><td class="date">2015-03-01</td><td class="quote">12</td><td class="operat"><a data-dbname="CJFD2015" data-filename="F1"></a></td></tr></tbody></table>"""


def answers(spark: SparkSession, *rows: tuple[str, str]) -> DataFrame:
    return spark.createDataFrame(list(rows), "key string, body string")


def records(spark: SparkSession) -> DataFrame:
    a = lambda k, b: answers(spark, (k, b), ("broken", "{"))
    found = (
        r.crossref_works(a("10.1000/a1", CROSSREF)), r.openalex_works(a("W1", OPENALEX)), r.s2_papers(a("p1", S2)), r.arxiv_entries(answers(spark, ("2101.00001", ARXIV))),
        r.pubmed_summaries(a("123456", PUBMED), answers(spark, ("123456", PUBMED_TEXT))), r.unpaywall_records(a("10.1000/a1", UNPAYWALL)), r.readpaper_records(a("Growth", READPAPER)),
        r.connectedpapers_records(a("Growth", CONNECTED)), r.cnki_records(r.cnki_rows(answers(spark, ("一种新的方法", CNKI)))),
    )
    return reduce(DataFrame.unionByName, (f.where("title is not null") for f in found))


def order_pages(orders: DataFrame) -> DataFrame:
    """Text runs of a document a customer: a page of prose, a heading, and three lines an order, numbered from 1, twelve
    orders a page; a word is hyphenated between the first two lines."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = orders.select("o_custkey", "o_orderkey", F.year("o_orderdate").cast("string").alias("year"), F.row_number().over(w).alias("i"))
    name = F.translate(F.col("o_orderkey").cast("string"), "0123456789", "abcdefghij")
    first = F.concat(F.lit("["), F.col("i").cast("string"), F.lit("] Smith K, Lee P. A study of "), name, F.lit(" with many re-"))
    second = F.concat(F.lit("sults of "), name, F.lit(". Journal of Orders"))
    third = F.concat("year", F.lit("; 12: 1-9. doi:10.1000/o"), name)
    at = (F.col("i") - 1) % 12
    lines = o.select("o_custkey", (F.floor((F.col("i") - 1) / 12) + 1).alias("page"), F.posexplode(F.array(first, second, third)).alias("line", "str"), at.alias("at"))
    lines = lines.select("o_custkey", "page", (3 * F.col("at") + F.col("line") + 2).alias("seq"), "str", F.when(F.col("line") == 0, 60.0).otherwise(80.0).alias("x"))
    own = o.where("i = 1")
    heads = own.select("o_custkey", F.lit(1).alias("page"), F.lit(1).alias("seq"), F.lit("References").alias("str"), F.lit(60.0).alias("x"))
    prose = own.select("o_custkey", F.lit(0).alias("page"), F.posexplode(F.array(*(F.lit(f"{a} are what this page is about, and {b} too, at some length") for a, b in (("Orders", "parts"), ("Lines", "sums"), ("Prices", "dates"), ("Names", "keys"))))).alias("seq", "str"))
    prose = prose.withColumn("x", F.lit(60.0))
    every = lines.unionByName(heads).unionByName(prose.select("o_custkey", "page", "seq", "str", "x"))
    return every.select(F.col("o_custkey").cast("string").alias("doc_id"), F.col("page").cast("int").alias("page"), "seq", "str", "x", (760.0 - 14 * F.col("seq")).alias("y"), (5.0 * F.length("str")).alias("width"), F.lit(9.0).alias("height"), F.lit(None).cast("string").alias("url"))
