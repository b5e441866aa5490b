"""Column functions over reference texts: identifiers, titles, languages, URLs, list numbers. All stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The identifier, URL and script patterns that results depend on.
DOI = r"10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9<>]+[^.\]\s]"
ARXIV = r"(?i)arXiv[.:]([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?)"
ARXIV_OLD = r"(?i)arXiv[.:]([a-z-]+(?:\.[A-Z]{2})?/[0-9]{7})"
PMID = r"(?i)PMID[:\s]*([0-9]{6,9})"
URL = r"https?://[^\s]+[^\s.,;)\]]"
HAN = r"[一-龥]"

#: White space as the web has it: Java's class lacks the no-break and typographic spaces.
SPACE = r"[\s   -     　﻿]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing(c: Column | str) -> Column:
    """An empty string as null."""
    return F.nullif(col(c), F.lit(""))


def found(text: Column | str, pattern: str, group: int = 0) -> Column:
    """The first match's group, null if there is none."""
    return missing(F.regexp_extract(col(text), pattern, group))


def squeeze(text: Column | str, by: str = "") -> Column:
    """All runs of white space replaced."""
    return F.regexp_replace(col(text), f"{SPACE}+", by)


def strip(text: Column | str) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(col(text), rf"^{SPACE}+|{SPACE}+\z", "")


def doi(text: Column | str, strict: bool = False) -> Column:
    """The first DOI. By default white space is taken out first, so that a DOI broken over lines is found and words right
    behind one stick to it; strict looks at the text as it is."""
    return F.regexp_replace(found(text if strict else squeeze(text), DOI), r"[.,;]+\z", "")


def arxiv(text: Column | str) -> Column:
    return F.coalesce(found(squeeze(text), ARXIV, 1), found(squeeze(text), ARXIV_OLD, 1))


def pmid(text: Column | str) -> Column:
    return found(text, PMID, 1)


def identifiers(text: Column | str, strict: bool = False) -> Column:
    """struct(doi, arxiv, pmid) of free text."""
    return F.struct(doi(text, strict).alias("doi"), arxiv(text).alias("arxiv"), pmid(text).alias("pmid"))


def host_identifiers(doi_field: Column | str, url: Column | str, extra: Column | str) -> Column:
    """struct(doi, arxiv, pmid) of a library row: the DOI field before an Extra line, the arXiv URL before Extra, an Extra
    line before the PubMed URL."""
    return F.struct(
        F.coalesce(missing(strip(doi_field)), found(extra, r"(?im)^DOI:\s*(10\.\S+)", 1)).alias("doi"),
        F.coalesce(found(url, r"(?i)arxiv\.org/(?:abs|pdf)/([^\s?#]+?)(?:\.pdf)?\z", 1), found(extra, ARXIV, 1)).alias("arxiv"),
        F.coalesce(found(extra, r"(?im)^PMID:\s*([0-9]+)", 1), found(url, r"pubmed\.ncbi\.nlm\.nih\.gov/([0-9]+)", 1)).alias("pmid"),
    )


def first_url(text: Column | str) -> Column:
    return found(text, URL)


def identifier_url(doi=None, arxiv=None, pmid=None, cnki=None, openalex=None) -> Column:
    """The address of the first identifier there is, in this order."""
    ways = ((doi, "https://doi.org/", ""), (arxiv, "https://arxiv.org/abs/", ""), (pmid, "https://pubmed.ncbi.nlm.nih.gov/", "/"), (cnki, "", ""), (openalex, "https://openalex.org/", ""))
    return F.coalesce(*(F.concat(F.lit(a), missing(c), F.lit(b)) for c, a, b in ways if c is not None), F.lit(None).cast("string"))


def is_http_url(url: Column | str) -> Column:
    return F.coalesce(col(url).rlike(r"(?i)^https?://\S+\z"), F.lit(False))


def is_doi(text: Column | str) -> Column:
    t = col(text)
    return F.coalesce((F.regexp_extract(t, DOI, 0) == t) & (t != "") & ~t.rlike("(?i)cnki|issn"), F.lit(False))


def is_chinese(text: Column | str) -> Column:
    """Whether more than half of the characters that aren't white space are Han characters."""
    t = squeeze(text)
    han = F.length(t) - F.length(F.regexp_replace(t, HAN, ""))
    return F.coalesce(2 * han > F.length(t), F.lit(False))


def clean_text(text: Column | str, plain: Column | None = None) -> Column:
    """Titles without markup: where the text has < or &, tags go and common entities are read (or `plain`, the text that
    an HTML parser made of it, is taken), and the spaces that markup leaves around punctuation go."""
    t = col(text)
    out = plain if plain is not None else html_text(t)
    out = squeeze(out, " ")
    out = F.regexp_replace(out, r" +([-–])(?=\S)", "$1")
    out = F.regexp_replace(out, r" +([,.;:!?)])", "$1")
    out = strip(F.regexp_replace(out, r"\( +", "("))
    return F.when(t.contains("<") | t.contains("&"), out).otherwise(t)


#: Entities that html_text reads; html_to_text reads all.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&amp;": "&"}


def html_text(html: Column | str) -> Column:
    """Tags out, common entities read (&amp; last, so that it is read once), line breaks as spaces."""
    t = F.regexp_replace(col(html), r"<!--(?s:.*?)-->|</?[A-Za-z][^>]*>", "")
    for entity, plain in ENTITIES.items():
        t = F.replace(t, F.lit(entity), F.lit(plain))
    return strip(F.regexp_replace(t, r"\n+", " "))


def normalize_title(title: Column | str) -> Column:
    """Lower case; only ASCII letters and digits and Han characters stay. Null gives an empty string."""
    return F.coalesce(F.regexp_replace(F.lower(col(title)), "[^0-9a-z一-龥]", ""), F.lit(""))


def collapse(text: Column | str, n: int | None = None) -> Column:
    """Cut with an ellipsis after n characters; by default 15 for Chinese text and 35 for other."""
    t = col(text)
    most = F.lit(n) if n is not None else F.when(is_chinese(t), 15).otherwise(35)
    return F.when(F.length(t) > most, F.concat(F.substring(t, F.lit(1), most), F.lit("…"))).otherwise(t)


def list_number(text: Column | str) -> Column:
    """The number of up to three digits that a line begins with, bracketed, followed by punctuation, or bare before a
    letter, bracket or quote; 0 if none."""
    return F.coalesce(
        found(strip(text), r"^[\[(]?([0-9]{1,3})(?:\s*[\].)]\s*(?=[^0-9\s.])|\s+(?=[\p{L}\[(“\"']))", 1).cast("int"), F.lit(0)
    )


# How reference entries begin, in the order in which they are tried.
ENTRY_STARTS = (
    r"^\([0-9]+\)",
    r"^\[[0-9]{0,3}\].",
    r"^［[0-9]{0,3}］.",
    r"^[0-9]+[,.，．]",
    r"^[0-9]+[^0-9\w]",
    r"^\[.+?\].",
    r"^[0-9]+\s",
    r"^[A-Z]\w.+?\([0-9]+[a-z]?\)|^[A-Z][A-Za-z]+|^.+?,.+.,|^[一-龥]{1,4}",
)


def entry_class(text: Column | str) -> Column:
    """Index of the first way of ENTRY_STARTS in which a line begins, as it is or without white space; -1 for none."""
    t, tight = strip(text), squeeze(text)
    out = F.lit(-1)
    for i in range(len(ENTRY_STARTS) - 1, -1, -1):
        out = F.when(t.rlike(ENTRY_STARTS[i]) | tight.rlike(ENTRY_STARTS[i]), F.lit(i)).otherwise(out)
    return F.coalesce(out, F.lit(-1))


def is_heading(text: Column | str) -> Column:
    """Whether a line heads a bibliography: fewer than 20 characters, one of the three words, no page range."""
    t = squeeze(text)
    return F.coalesce(t.rlike("(?i)参考文献|reference|bibliography") & (F.length(t) < 20) & ~t.rlike(r"(?i)references?\(?[0-9]"), F.lit(False))


# How trailing matter after a bibliography begins.
TRAILING = (
    r"(?i)^(open access|©|copyright|publisher'?s note|springer nature remains|correspondence|acknowledg|author contributions"
    r"|competing interests|conflict of interest|supplementary|received:|accepted:|funding|data availability|ethics|cite this article"
    r"|reprints and permissions|the author\(s\)|this article is licensed|figure legends?|figure [0-9]|fig\. [0-9]|table [0-9]|e-table"
    r"|e-figure|appendix)"
)


def is_trailing(text: Column | str) -> Column:
    return F.coalesce(strip(text).rlike(TRAILING), F.lit(False))


def without_list_number(text: Column | str) -> Column:
    """A citation without its leading [n], n. or n) and the space behind."""
    return F.regexp_replace(strip(text), r"^(\[[0-9]+\]|[0-9]+[.)])\s*", "")


def without_page_number(text: Column | str) -> Column:
    """Running heads compared across pages: one to three capitals are nothing, spaces and digits go."""
    t = strip(text)
    return F.when(t.rlike(r"^[A-Z]{1,3}\z"), F.lit("")).otherwise(F.regexp_replace(t, r"[\s0-9]+", ""))


def joined_lines(left: Column, right: Column) -> Column:
    """Two lines of an entry: a trailing hyphen goes, else one space comes between."""
    return F.when(left.endswith("-"), F.concat(F.regexp_replace(left, r"-\z", ""), right)).otherwise(F.concat_ws(" ", left, right))


def keyword_match(content: Column | str, keywords: Column | str) -> Column:
    """Whether a text contains all words of a filter, split at spaces and commas of either width; no words match all."""
    words = F.filter(F.split(F.lower(F.coalesce(col(keywords), F.lit(""))), "[ ,，]"), lambda k: k != "")
    return F.forall(words, lambda k: F.coalesce(F.lower(col(content)).contains(k), F.lit(False)))


def year_in(text: Column | str) -> Column:
    """The first four digits in a row."""
    return found(text, r"([0-9]{4})", 1)


def has_publication_year(text: Column | str) -> Column:
    return F.coalesce(col(text).rlike(r"\b(18|19|20)[0-9]{2}\b"), F.lit(False))


def display_date(text: Column | str) -> Column:
    """Month and year where the text is a date, else the text."""
    t = col(text)
    return F.coalesce(F.date_format(F.try_to_timestamp(t), "MMM yyyy"), t)


def encode_component(text: Column | str) -> Column:
    """Percent-encoding of a query value or path part: a space is %20, and !'()~ stay."""
    t = F.url_encode(col(text))
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def cnki_url(url: Column | str) -> Column:
    """struct(file_name, db_name, db_code) of the address; null without file or database. The code is by default the
    first four characters of the database's name."""
    u = col(url)
    file, db = found(u, r"(?i)filename=(\w+)", 1), found(u, r"(?i)dbname=(\w+)", 1)
    code = F.coalesce(found(u, r"(?i)dbcode=(\w+)", 1), F.substring(db, 1, 4))
    return F.when(file.isNotNull() & db.isNotNull(), F.struct(file.alias("file_name"), db.alias("db_name"), code.alias("db_code")))


def parse_reference(text: Column | str, as_of_year: int) -> Column:
    """struct(title, authors, year, venue) of a raw citation.

    A quoted span is the title. Else the text is cut at ". " (or at "." where there are fewer than two of those), and of
    the parts with three spaces or more the one with the smallest share of initials, punctuation and digits is taken, the
    longer of two equal ones. With no such part the whole text is the title, and nothing else is known. The authors stand
    before the title, the venue behind it up to a comma or digit. The year is the first of four digits between 1601 and
    next year, with a character that is no digit before, and one that is neither digit nor hyphen behind; as_of_year
    stands for the current year, so that results don't depend on the day."""
    return let(strip(squeeze(F.regexp_replace(col(text), r"^\[[0-9]+\]", ""), " ")), lambda t: let(_title_of(t), lambda m: _around_title(t, m, as_of_year)))


def let(value: Column, then) -> Column:
    """then(value), where value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _occurrences(s: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)))


def _title_of(t: Column) -> Column:
    """struct(match, title): the part of a citation that holds the title, and the title; nulls for none."""
    quoted = found(t, '[“"](.+?)[”"]')
    inner = F.regexp_replace(found(t, '[“"](.+?)[”"]', 1), r",\z", "")
    many = (F.length(t) - F.length(F.replace(t, F.lit(". "), F.lit("")))) >= 4

    def ranked(s, i):
        marks = _occurrences(s, r"[A-Z]\.") + _occurrences(s, r"[,.\-():]") + _occurrences(s, "[0-9]")
        return F.struct((marks / F.greatest(F.length(s), F.lit(1))).alias("score"), (-F.length(s)).alias("short"), i.alias("i"), s.alias("s"))

    segments = F.when(many, F.split(t, r"\. ")).otherwise(F.split(t, r"\."))
    good = F.filter(segments, lambda s: _occurrences(s, r"\s+") >= 3)
    best = F.when(quoted.isNull(), F.get(F.array_sort(F.transform(good, ranked)), F.lit(0))["s"])
    title = F.when(quoted.isNotNull(), inner).otherwise(F.regexp_replace(best, r"\[[A-Z]\]\z", ""))
    return F.struct(F.coalesce(quoted, best).alias("match"), strip(title).alias("title"))


def _without_once(s: Column, x: Column) -> Column:
    at = F.instr(s, x)
    return F.when(at > 0, F.concat(F.substring(s, F.lit(1), at - 1), F.substring(s, at + F.length(x), F.length(s)))).otherwise(s)


def _around_title(t: Column, m: Column, as_of_year: int) -> Column:
    """What stands before and behind the title."""
    match, at = m["match"], F.instr(t, m["match"])
    before = strip(F.substring(t, F.lit(1), at - 1))
    behind = F.substring(t, at + F.length(match), F.length(t))
    behind = let(behind, lambda b: F.when(F.instr(b, match) > 0, F.substring(b, F.lit(1), F.instr(b, match) - 1)).otherwise(b))
    venue = missing(strip(F.get(F.split(found(behind, r"[^.\s].+[^.]"), "[,0-9]"), F.lit(0))))
    years = F.regexp_extract_all(t, F.lit(r"[^0-9]([0-9]{4})[^0-9-]"), F.lit(1))
    year = F.get(F.filter(years, lambda y: (y.cast("int") > 1600) & (y.cast("int") <= as_of_year + 1)), F.lit(0))
    authors = let(before, lambda b: F.when(b.contains("et al."), F.concat(F.substring_index(b, "et al.", 1), F.lit("et al."))).otherwise(b))

    def made(x):
        clean = F.when(x["year"].isNotNull(), strip(_without_once(_without_once(x["authors"], F.concat(x["year"], F.lit("."))), x["year"]))).otherwise(x["authors"])
        known = match.isNotNull()
        return F.struct(
            F.coalesce(m["title"], t).alias("title"),
            F.when(known, F.filter(F.array(clean), lambda a: a != "")).otherwise(F.array().cast("array<string>")).alias("authors"),
            F.when(known, x["year"]).alias("year"),
            F.when(known, venue).alias("venue"),
        )

    return let(F.struct(year.alias("year"), authors.alias("authors")), made)
