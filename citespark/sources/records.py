"""Records of works from the answers of scholarly services: one schema for all of them.

Every mapper takes a frame of answers (key, body) and returns key and the columns of RECORD. What a service doesn't
tell is null. Answers that can't be read give no row.
"""

from __future__ import annotations

from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citespark.functions.text import cnki_url, clean_text, found, html_text, identifier_url, is_chinese, missing, parse_reference, identifiers, first_url, strip, year_in

RECORD = {
    "doi": "string", "arxiv": "string", "pmid": "string", "openalex": "string", "s2": "string", "cnki": "string", "title": "string", "authors": "array<string>", "year": "string",
    "publish_date": "string", "venue": "string", "abstract": "string", "citation_count": "bigint", "reference_count": "bigint", "url": "string", "oa_url": "string", "type": "string",
    "retracted": "boolean", "tags": "array<string>", "source": "string",
}

# Item types of the services' type codes.
CROSSREF_TYPES = {"journal-article": "journalArticle", "report": "report", "posted-content": "preprint", "book-chapter": "bookSection", "proceedings-article": "conferencePaper", "book": "book"}
OPENALEX_TYPES = {"article": "journalArticle", "preprint": "preprint", "book": "book", "book-chapter": "bookSection", "dissertation": "thesis"}
DEFAULT_TYPE = "journalArticle"


def mapped_type(code: Column, table: dict[str, str], default: str = DEFAULT_TYPE) -> Column:
    return reduce(lambda c, t: c.when(code == t[0], t[1]), table.items(), F.when(F.lit(False), F.lit(default))).otherwise(F.lit(default))


def record(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    have = columns | {"source": F.lit(source)}
    return df.select("key", *((have[n] if n in have else F.lit(None)).cast(t).alias(n) for n, t in RECORD.items()))


def names(people: Column, *fields: str) -> Column:
    """The first of the fields that each person has; people without one go."""
    return F.filter(F.transform(people, lambda a: F.coalesce(*(missing(a[f]) for f in fields))), lambda n: n.isNotNull())


def counted(n: Column) -> Column:
    """A count as a tag, where it is more than 0."""
    return F.when(n > 0, F.array(n.cast("string"))).otherwise(F.array().cast("array<string>"))


def _parsed(answers: DataFrame, schema: str) -> DataFrame:
    return answers.select("key", F.from_json("body", schema).alias("w")).where("w is not null")


_DATE = "struct<`date-parts`:array<array<int>>>"
_CITED = "array<struct<unstructured:string,`article-title`:string,`volume-title`:string,`series-title`:string,`journal-title`:string,author:string,year:string,volume:string,`first-page`:string,DOI:string,key:string,type:string>>"
_CROSSREF = f"DOI string, title array<string>, author array<struct<family:string,name:string>>, published {_DATE}, created {_DATE}, `is-referenced-by-count` bigint, type string, URL string, abstract string, `container-title` array<string>, reference {_CITED}"


def crossref_works(answers: DataFrame) -> DataFrame:
    df = _parsed(answers, _CROSSREF)
    parts = F.coalesce(F.get(F.col("w.published.date-parts"), F.lit(0)), F.get(F.col("w.created.date-parts"), F.lit(0)))
    n = F.col("w.is-referenced-by-count")
    return record(
        df, "crossref", doi=F.col("w.DOI"), title=clean_text(F.get("w.title", F.lit(0))), authors=names(F.col("w.author"), "family", "name"), year=F.get(parts, F.lit(0)),
        publish_date=missing(F.array_join(parts.cast("array<string>"), "-")), venue=F.get("w.container-title", F.lit(0)), abstract=missing(html_text("w.abstract")), citation_count=n,
        url=F.col("w.URL"), type=mapped_type(F.col("w.type"), CROSSREF_TYPES), tags=counted(n),
    )


def crossref_references(answers: DataFrame, as_of_year: int = 2026) -> DataFrame:
    """key, number, text, title, authors, year, doi, arxiv, pmid, url, type of the works' reference lists. An entry's text
    is its unstructured citation, or is made up of its fields."""
    df = _parsed(answers, _CROSSREF).select("key", F.posexplode("w.reference").alias("pos", "r"))
    r = lambda n: missing(F.col(f"r.{n}"))
    entry = clean_text(F.coalesce(r("article-title"), r("volume-title"), r("series-title")))
    series = F.when(~entry.eqNullSafe(r("series-title")), r("series-title"))
    composed = missing(F.concat_ws(", ", F.concat(r("author"), F.lit(" et al.")), r("year"), entry, F.coalesce(r("journal-title"), series), r("volume"), r("first-page")))
    fallback = F.coalesce(F.concat(F.lit("doi:"), r("DOI")), r("key"), F.concat(F.lit("["), (F.col("pos") + 1).cast("string"), F.lit("]")))
    loose = clean_text(r("unstructured"))
    df = df.select("key", "pos", "r", entry.alias("entry"), loose.alias("loose"), F.coalesce(loose, composed, fallback).alias("text"))
    df = df.withColumn("i", F.when(F.col("loose").isNotNull(), identifiers("loose"))).withColumn("p", F.when(F.col("loose").isNotNull(), parse_reference("loose", as_of_year)))
    doi = F.coalesce(r("DOI"), F.col("i.doi"))
    own = identifier_url(doi, F.col("i.arxiv"), F.col("i.pmid"))
    author = F.when(r("author").isNotNull(), F.array(r("author"))).otherwise(F.coalesce("p.authors", F.array().cast("array<string>")))
    kind = F.coalesce(*(F.when(r("type") == a, F.lit(b)) for a, b in CROSSREF_TYPES.items()), F.when(F.col("i.arxiv").isNotNull(), "preprint"), F.lit(DEFAULT_TYPE))
    return df.select(
        "key", (F.col("pos") + 1).cast("long").alias("number"), "text", F.coalesce(missing("entry"), "p.title").alias("title"), author.alias("authors"), F.coalesce(r("year"), "p.year").alias("year"), doi.alias("doi"),
        F.col("i.arxiv").alias("arxiv"), F.col("i.pmid").alias("pmid"), F.when(r("DOI").isNotNull(), own).otherwise(F.coalesce(first_url("loose"), own)).alias("url"), kind.alias("type"),
    )


def best_title_hit(hits: DataFrame, skipped: tuple[str, ...] = ("component", "peer-review", "dataset")) -> DataFrame:
    """Of search hits(key, query, pos, title, type, ...) one a key: the first whose normalised title is the query's, else
    the first; hits of the skipped types don't count."""
    from citespark.functions.text import normalize_title

    w = Window.partitionBy("key").orderBy((normalize_title("title") != normalize_title("query")).cast("int"), "pos")
    return hits.where(~F.coalesce(F.col("type").isin(*skipped), F.lit(False))).withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def abstract_of_index(index: Column) -> Column:
    """Text of an inverted index from words to places; null if there are none."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return missing(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "))


_OPENALEX = "id string, doi string, ids struct<pmid:string>, authorships array<struct<author:struct<display_name:string>>>, cited_by_count bigint, open_access struct<oa_url:string>, display_name string, publication_year int, publication_date string, primary_location struct<source:struct<display_name:string>>, abstract_inverted_index map<string,array<int>>, is_retracted boolean, type string, referenced_works array<string>, related_works array<string>"


def bare_id(address: Column) -> Column:
    return missing(F.substring_index(address, "/", -1))


def openalex_works(answers: DataFrame) -> DataFrame:
    df = _parsed(answers, _OPENALEX)
    doi, n = missing(F.regexp_replace("w.doi", r"(?i)^https?://doi\.org/", "")), F.col("w.cited_by_count")
    return record(
        df, "openalex", openalex=bare_id(F.col("w.id")), doi=doi, pmid=found("w.ids.pmid", r"([0-9]+)/?\z", 1), title=clean_text("w.display_name"),
        authors=F.filter(F.transform("w.authorships", lambda a: missing(a["author"]["display_name"])), lambda x: x.isNotNull()), year=F.col("w.publication_year"), publish_date=F.col("w.publication_date"),
        venue=clean_text("w.primary_location.source.display_name"), abstract=abstract_of_index(F.col("w.abstract_inverted_index")), citation_count=n, url=F.coalesce(identifier_url(doi), F.col("w.id")),
        oa_url=missing("w.open_access.oa_url"), type=mapped_type(F.col("w.type"), OPENALEX_TYPES), retracted=F.when(F.col("w.is_retracted"), F.lit(True)), tags=counted(n),
    )


def openalex_lists(answers: DataFrame) -> DataFrame:
    """(key, kind, pos, ref_id) of the works' referenced and related works."""
    df = _parsed(answers, _OPENALEX)
    lists = [df.select("key", F.lit(k).alias("kind"), F.posexplode(f"w.{c}").alias("pos", "id")) for k, c in (("reference", "referenced_works"), ("related", "related_works"))]
    return lists[0].unionByName(lists[1]).select("key", "kind", "pos", bare_id(F.col("id")).alias("ref_id"))


_S2 = "paperId string, externalIds struct<DOI:string,ArXiv:string,PubMed:string>, title string, abstract string, year int, publicationDate string, authors array<struct<name:string>>, venue string, citationCount bigint, referenceCount bigint, openAccessPdf struct<url:string>, publicationTypes array<string>"


def s2_paper_id(s2: Column, doi: Column, arxiv: Column, pmid: Column) -> Column:
    """What a paper is asked for by, the service's own id first."""
    return F.coalesce(missing(s2), F.concat(F.lit("DOI:"), missing(doi)), F.concat(F.lit("arXiv:"), missing(arxiv)), F.concat(F.lit("PMID:"), missing(pmid)))


def _s2(df: DataFrame) -> DataFrame:
    doi, arxiv, pmid = (F.col(f"w.externalIds.{c}") for c in ("DOI", "ArXiv", "PubMed"))
    types = F.coalesce("w.publicationTypes", F.array().cast("array<string>"))
    kind = F.when(arxiv.isNotNull() & doi.isNull(), "preprint").when(F.array_contains(types, "JournalArticle"), DEFAULT_TYPE).when(F.array_contains(types, "Conference"), "conferencePaper").otherwise(DEFAULT_TYPE)
    return record(
        df, "semanticscholar", s2=F.col("w.paperId"), doi=doi, arxiv=arxiv, pmid=pmid, title=clean_text("w.title"), abstract=F.col("w.abstract"), year=F.col("w.year"), publish_date=F.col("w.publicationDate"),
        authors=F.coalesce(F.transform("w.authors", lambda a: a["name"]), F.array().cast("array<string>")), venue=F.col("w.venue"), citation_count=F.col("w.citationCount"), reference_count=F.col("w.referenceCount"), oa_url=F.col("w.openAccessPdf.url"),
        url=F.coalesce(identifier_url(doi, arxiv, pmid), F.concat(F.lit("https://www.semanticscholar.org/paper/"), F.col("w.paperId"))), type=kind, tags=counted(F.col("w.citationCount")),
    )


def s2_papers(answers: DataFrame) -> DataFrame:
    return _s2(_parsed(answers, _S2))


def s2_edges(answers: DataFrame, kind: str = "citedPaper") -> DataFrame:
    """Records of reference or citation lists, with number from 1 without gaps and description `intent: context`. Entries
    without a paper are left out before they are numbered."""
    schema = f"data array<struct<{kind}:struct<{_S2.replace(' array', ':array').replace(' struct', ':struct').replace(' string', ':string').replace(' int', ':int').replace(' bigint', ':bigint')}>,contexts:array<string>,intents:array<string>>>, next bigint"
    df = answers.select("key", F.from_json("body", schema).alias("b")).select(F.col("key").alias("list_key"), F.posexplode("b.data").alias("pos", "e"))
    df = df.where(F.col(f"e.{kind}").isNotNull()).withColumn("number", F.row_number().over(Window.partitionBy("list_key").orderBy("pos")).cast("long"))
    df = df.select("list_key", "number", F.col(f"e.{kind}").alias("w"), F.concat_ws(": ", F.get("e.intents", F.lit(0)), F.get("e.contexts", F.lit(0))).alias("description"))
    out = _s2(df.withColumn("key", F.to_json(F.struct("list_key", "number", "description"))))
    k = F.from_json("key", "list_key string, number long, description string")
    return out.withColumn("k", k).select(F.col("k.list_key").alias("key"), F.col("k.number").alias("number"), missing("k.description").alias("description"), *RECORD)


_ATOM = "entry struct<title:string,summary:string,published:string,author:array<struct<name:string>>,category:array<struct<_term:string>>,`arxiv:comment`:string,`arxiv:doi`:string>"


def arxiv_entries(answers: DataFrame) -> DataFrame:
    """Entries of Atom feeds, whose keys are the identifiers asked for; an entry without a title is none."""
    df = answers.select("key", F.from_xml("body", _ATOM, {"rowTag": "feed"}).alias("f")).select("key", F.col("f.entry").alias("w")).where(missing("w.title").isNotNull())
    flat = lambda c: strip(F.replace(F.col(c), F.lit("\n"), F.lit(" ")))
    return record(
        df, "arxiv", arxiv=F.col("key"), doi=F.col("w.arxiv:doi"), title=flat("w.title"), abstract=flat("w.summary"), authors=names(F.col("w.author"), "name"), year=F.substring("w.published", 1, 4), publish_date=F.col("w.published"),
        venue=F.col("w.arxiv:comment"), type=F.lit("preprint"), url=identifier_url(None, F.col("key")), tags=F.filter(F.transform("w.category", lambda c: c["_term"]), lambda t: t.isNotNull()),
    )


_PUBMED = "result map<string,struct<authors:array<struct<name:string>>,pubdate:string,articleids:array<struct<idtype:string,value:string>>,title:string,fulljournalname:string,pubtype:array<string>,error:string>>"


def abstract_without_footer(raw: Column) -> Column:
    """An abstract's text up to the line of its identifiers."""
    return missing(strip(F.regexp_replace(strip(raw), r"(?is)\n\s*(PMID|DOI|PMCID)\s*:.*\z", "")))


def pubmed_summaries(answers: DataFrame, abstracts: DataFrame | None = None) -> DataFrame:
    """Summaries by PMID; abstracts(key, body) are joined where given."""
    df = answers.select("key", F.try_element_at(F.from_json("body", _PUBMED)["result"], F.col("key")).alias("w")).where("w is not null and w.error is null")
    if abstracts is not None:
        df = df.join(abstracts.select("key", F.col("body").alias("raw")), "key", "left")
    else:
        df = df.withColumn("raw", F.lit(None).cast("string"))
    doi = F.get(F.filter("w.articleids", lambda a: a["idtype"] == "doi"), F.lit(0))["value"]
    gone = F.exists("w.pubtype", lambda t: F.lower(t) == "retracted publication")
    return record(
        df, "pubmed", pmid=F.col("key"), doi=missing(doi), title=clean_text("w.title"), authors=names(F.col("w.authors"), "name"), year=year_in("w.pubdate"), venue=F.col("w.fulljournalname"), abstract=abstract_without_footer(F.col("raw")),
        type=F.lit(DEFAULT_TYPE), url=identifier_url(None, None, F.col("key")), retracted=F.when(gone, F.lit(True)),
    )


def pubmed_title_hit(hits: DataFrame, n: int = 3) -> DataFrame:
    """The first of a search's first n hits(key, pos, title, ...) that is no correction, erratum or retraction."""
    own = hits.where((F.col("pos") < n) & ~F.coalesce(F.col("title").rlike(r"(?i)^\s*(correction|erratum|corrigendum|retraction|retracted)"), F.lit(False)))
    rest = [c for c in hits.columns if c != "key"]
    return own.groupBy("key").agg(F.min_by(F.struct(*rest), "pos").alias("_r")).select("key", "_r.*")


_UNPAYWALL = "z_authors array<struct<raw_author_name:string,family:string,name:string>>, best_oa_location struct<url_for_pdf:string,url:string>, is_oa boolean, oa_status string, title string, year int, genre string, journal_name string, published_date string"


def unpaywall_records(answers: DataFrame) -> DataFrame:
    df = _parsed(answers, _UNPAYWALL)
    return record(
        df, "unpaywall", doi=F.col("key"), authors=names(F.col("w.z_authors"), "raw_author_name", "family", "name"), title=clean_text("w.title"), year=F.col("w.year"), type=mapped_type(F.col("w.genre"), CROSSREF_TYPES), venue=F.col("w.journal_name"),
        publish_date=F.col("w.published_date"), oa_url=F.coalesce(missing("w.best_oa_location.url_for_pdf"), missing("w.best_oa_location.url")), tags=F.when(F.col("w.is_oa"), F.array(F.lit("OA"))),
    )


_READPAPER = "title string, year string, publishDate string, authorList array<struct<name:string>>, summary string, primaryVenue string, venueTags array<string>, citationCount bigint"


def readpaper_records(answers: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """Search hits; with details(key, doi) of keys that are DOIs only hits whose DOI is the key, in any case."""
    df = _parsed(answers, _READPAPER)
    if details is not None:
        df = df.join(details.select("key", F.col("doi").alias("remote")), "key").where(F.upper("remote") == F.upper("key"))
    tags = F.concat(F.coalesce("w.venueTags", F.array().cast("array<string>")), counted(F.col("w.citationCount")))
    return record(
        df, "readpaper", doi=F.col("key") if details is not None else F.lit(None), title=html_text("w.title"), year=F.col("w.year"), publish_date=F.col("w.publishDate"), authors=F.transform("w.authorList", lambda a: html_text(a["name"])),
        abstract=html_text("w.summary"), venue=html_text("w.primaryVenue"), type=F.lit(DEFAULT_TYPE), tags=tags,
    )


_CONNECTED = "title struct<text:string>, year struct<text:string>, authors array<array<struct<name:string>>>, doiInfo struct<doi:string,doiUrl:string>, paperAbstract struct<text:string>, venue struct<text:string>, citationStats struct<numCitations:bigint,numReferences:bigint>"


def connectedpapers_records(answers: DataFrame) -> DataFrame:
    df = _parsed(answers, _CONNECTED)
    stats = F.col("w.citationStats")
    return record(
        df, "connectedpapers", doi=F.col("w.doiInfo.doi"), title=F.col("w.title.text"), authors=F.filter(F.transform("w.authors", lambda a: F.get(a, F.lit(0))["name"]), lambda n: n.isNotNull()), year=F.col("w.year.text"), type=F.lit(DEFAULT_TYPE),
        url=F.col("w.doiInfo.doiUrl"), abstract=F.col("w.paperAbstract.text"), venue=F.col("w.venue.text"),
        tags=F.when(stats.isNotNull(), F.array(stats["numCitations"].cast("string"), stats["numReferences"].cast("string"))).otherwise(F.array().cast("array<string>")),
    )


# ---------------------------------------------------------------- HTML


class _Rows(HTMLParser):
    """Rows of a search result's table: the texts of cells by class, and attributes of the elements that carry them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.row: dict | None = None
        self.cell, self.link, self.table = "", False, 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        kinds = (a.get("class") or "").split()
        if tag == "table" and "result-table-list" in kinds:
            self.table += 1
        elif tag == "tr" and self.table:
            self.row = {}
        elif self.row is not None:
            if tag == "td":
                self.cell = kinds[0] if kinds else ""
            elif tag == "a":
                self.link = True
                if "fz14" in kinds and "url" not in self.row:
                    self.row["url"] = a.get("href") or ""
            elif tag == "input" and self.cell == "seq":
                self.row.setdefault("export_id", a.get("value"))
            if self.cell == "operat" and a.get("data-dbname"):
                self.row.setdefault("dbname", a["data-dbname"])
                self.row.setdefault("filename", a.get("data-filename"))

    def handle_endtag(self, tag):
        if tag == "table" and self.table:
            self.table -= 1
        elif tag == "a":
            self.link = False
        elif tag == "td":
            self.cell = ""
        elif tag == "tr" and self.row is not None:
            if self.row.get("url"):
                self.rows.append(self.row)
            self.row = None

    def handle_data(self, data):
        if self.row is not None and self.cell in ("name", "author", "source", "date", "quote") and (self.cell != "name" or self.link):
            self.row[self.cell] = self.row.get(self.cell, "") + data


_CNKI_ROW = "array<struct<url:string,title:string,authors:array<string>,venue:string,date:string,citation:string,dbname:string,filename:string,export_id:string>>"


def _cnki_rows(html: pd.Series) -> pd.Series:
    import re

    def rows(h):
        p = _Rows()
        p.feed(h or "")
        text = lambda r, c: (r.get(c) or "").strip()
        return [{"url": r["url"], "title": text(r, "name"), "authors": [x for x in re.split(r"[;,\s]+", text(r, "author")) if x], "venue": text(r, "source"), "date": text(r, "date"), "citation": text(r, "quote"), "dbname": r.get("dbname"), "filename": r.get("filename"), "export_id": r.get("export_id")} for r in p.rows]

    return html.map(rows)


def cnki_rows(answers: DataFrame, host: str = "https://kns.cnki.net") -> DataFrame:
    """key, pos and the fields of the rows of search pages; relative addresses get the host."""
    df = answers.select("key", F.posexplode(F.pandas_udf(_cnki_rows, _CNKI_ROW)("body")).alias("pos", "r")).select("key", "pos", "r.*")
    return df.withColumn("url", F.when(F.col("url").startswith("http"), F.col("url")).otherwise(F.concat(F.lit(host), "url")))


def cnki_records(rows: DataFrame) -> DataFrame:
    """The first row of each search whose query, the key, is Chinese."""
    df = rows.where((F.col("pos") == 0) & is_chinese("key"))
    tags = F.when(F.col("citation").rlike("[0-9]"), F.array("citation")).otherwise(F.array().cast("array<string>"))
    return record(df, "cnki", cnki=F.col("url"), title=F.coalesce(missing("title"), "key"), authors=F.col("authors"), type=F.lit(DEFAULT_TYPE), venue=F.col("venue"), year=year_in("date"), url=F.col("url"), tags=tags)


def cnki_references(bibliography: DataFrame, refer: DataFrame) -> DataFrame:
    """key, number, text, title, url: each of bibliography(key, pos, title) with the first of refer(key, pos, title, file,
    table, db) whose title it contains. The pairs are formed within a key only, and the containment is a residual."""
    r = refer.select("key", F.col("pos").alias("rp"), F.col("title").alias("rt"), "file", "table", F.substring_index("db", "_", 1).alias("code"))
    joined = bibliography.join(r, (bibliography.key == r.key) & bibliography.title.contains(F.col("rt")), "left").drop(r.key)
    best = joined.groupBy("key", "pos", "title").agg(F.min_by(F.struct("rt", "file", "table", "code"), "rp").alias("m"))
    text = F.regexp_replace("title", r"^\[[0-9]+\]", "")
    url = F.concat(F.lit("https://kns.cnki.net/kcms/detail/detail.aspx?FileName="), F.col("m.file"), F.lit("&DbName="), F.col("m.table"), F.lit("&DbCode="), F.col("m.code"))
    return best.select("key", (F.col("pos") + 1).cast("long").alias("number"), text.alias("text"), F.coalesce(F.col("m.rt"), text).alias("title"), url.alias("url"))


def cnki_page(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds file_name, db_name and db_code of an address."""
    return df.withColumn("_u", cnki_url(url)).select("*", "_u.*").drop("_u")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data):
        self.parts.append(data)


def html_to_text(html: Column | str) -> Column:
    """Text content of HTML as a parser sees it, all entities read; html_text is the expression for the common cases."""
    return F.pandas_udf(_html_to_text, "string")(html)


def _html_to_text(html: pd.Series) -> pd.Series:
    import re

    def plain(h):
        if h is None:
            return None
        p = _Text()
        p.feed(h)
        p.close()
        return re.sub(r"\n+", " ", "".join(p.parts)).strip()

    return html.map(plain)
