"""Library items: rows made of references, relations between them, cards, chips and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citespark.functions.text import encode_component, identifier_url, is_chinese, is_http_url, missing, strip

# Item types without automatic refresh, and types of which a graph or list is shown for none.
NOT_REFRESHED = "book, letter, note, thesis"
NOT_REGULAR = ("attachment", "note", "annotation")


def creators(authors: Column) -> Column:
    """array<struct<first, last>>: the last word of a name is the surname; a Chinese name is one field."""
    named = F.filter(F.transform(authors, lambda a: strip(a)), lambda a: F.coalesce(a != "", F.lit(False)))

    def parts(a):
        words = F.split(a, r"\s+")
        first = F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")
        return F.when(is_chinese(a), F.struct(F.lit("").alias("first"), a.alias("last"))).otherwise(F.struct(first.alias("first"), F.element_at(words, -1).alias("last")))

    return F.transform(named, parts)


def item_rows(refs: DataFrame, doi_types: tuple[str, ...] = ("journalArticle", "preprint", "conferencePaper")) -> DataFrame:
    """ref_id, item_type, title, date, publication_title, doi, url, extra, creators from refs(ref_id, type, title, year,
    publish_date, primary_venue, doi, pmid, arxiv, url, authors, extra). Types without a DOI field carry the DOI in Extra,
    as every type does PMID and arXiv, so that the item is found again."""
    kind = F.coalesce(missing("type"), F.lit("journalArticle"))
    has_field = kind.isin(*doi_types)
    lines = F.concat_ws("\n", missing("extra"), F.when(~has_field, F.concat(F.lit("DOI: "), missing("doi"))), F.concat(F.lit("PMID: "), missing("pmid")), F.concat(F.lit("arXiv: "), missing("arxiv")))
    return refs.select(
        "ref_id", kind.alias("item_type"), missing("title").alias("title"), F.coalesce(missing("publish_date"), missing("year")).alias("date"), F.when(kind == "journalArticle", missing("primary_venue")).alias("publication_title"),
        F.when(has_field, missing("doi")).alias("doi"), F.when(is_http_url("url"), F.col("url")).alias("url"), missing(lines).alias("extra"), creators(F.col("authors")).alias("creators"),
    )


def with_relations(relations: DataFrame, new: DataFrame) -> DataFrame:
    """relations(item_key, related_key) with new pairs, both ways, each once."""
    turned = new.select(F.col("related_key").alias("item_key"), F.col("item_key").alias("related_key"))
    return relations.unionByName(new).unionByName(turned).distinct()


def without_relations(relations: DataFrame, gone: DataFrame) -> DataFrame:
    turned = gone.select(F.col("related_key").alias("item_key"), F.col("item_key").alias("related_key"))
    return relations.join(gone.unionByName(turned), ["item_key", "related_key"], "left_anti")


def toggled(relations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Related pairs are parted, others are tied."""
    have = pairs.join(relations, ["item_key", "related_key"], "left_semi")
    return with_relations(without_relations(relations, have), pairs.join(have, ["item_key", "related_key"], "left_anti"))


def related_items(relations: DataFrame, library: DataFrame) -> DataFrame:
    """item_key with the columns of its related items in library(item_key, ...)."""
    return relations.join(library.withColumnRenamed("item_key", "related_key"), "related_key")


def cards(refs: DataFrame, library: DataFrame) -> DataFrame:
    """ref_id, title, authors, year, venue, abstract, url: an item of the library as it is there, else the reference, whose
    text stands for an abstract and whose identifier gives the address."""
    lib = library.select(F.col("item_id").alias("_i"), *(F.col(c).alias(f"_{c}") for c in ("title", "authors", "year", "venue", "abstract")))
    own = refs.join(lib, F.col("lib_item_id") == F.col("_i"), "left")
    pick = lambda c, other: F.when(F.col("_i").isNotNull(), F.col(f"_{c}")).otherwise(other).alias(c)
    return own.select(
        "ref_id", pick("title", F.coalesce(missing("title"), F.lit("Reference"))), pick("authors", F.coalesce("authors", F.array().cast("array<string>"))), pick("year", F.col("year")), pick("venue", F.col("venue")),
        pick("abstract", F.coalesce(missing("abstract"), F.col("text"))), F.when(F.col("_i").isNull(), identifier_url(F.col("doi"), F.col("arxiv"), F.col("pmid"))).alias("url"),
    )


def chips(tags: Column, source: Column, doi: Column, arxiv: Column, pmid: Column, url: Column, oa_url: Column, retracted: Column, lib_item_id: Column, title: Column) -> Column:
    """array<struct<text, url>> of a card in order: retraction, own tags, source, identifiers, open access, library,
    searches by title (the medical one without a PMID and for titles that aren't Chinese)."""
    chip = lambda t, u=None: F.struct(F.lit(t).alias("text") if isinstance(t, str) else t.alias("text"), (F.lit(None).cast("string") if u is None else u).alias("url"))
    name = missing(strip(title))
    q = encode_component(name)
    own = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: chip(t))
    rest = F.array(
        F.when(source.isNotNull(), chip(source)), F.when(doi.isNotNull(), chip("DOI", F.coalesce(url, identifier_url(doi)))), F.when(arxiv.isNotNull(), chip("arXiv", identifier_url(None, arxiv))),
        F.when(pmid.isNotNull(), chip("PMID", identifier_url(None, None, pmid))), F.when(oa_url.isNotNull(), chip("PDF", oa_url)), F.when(lib_item_id.isNotNull(), chip("Library")),
        F.when(name.isNotNull(), chip("Scholar", F.concat(F.lit("https://scholar.google.com/scholar?q="), q))),
        F.when(name.isNotNull() & pmid.isNull() & ~is_chinese(name), chip("PubMed", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/?term="), q))),
    )
    first = F.when(retracted, F.array(chip("Retracted"))).otherwise(F.array().cast("array<struct<text:string,url:string>>"))
    return F.concat(first, own, F.filter(rest, lambda c: c.isNotNull()))


def log_label(ok: Column, title: Column, text: Column, place: Column) -> Column:
    return F.concat(F.when(ok, "✓ ").otherwise("✗ "), F.coalesce(missing(title), missing(text), F.concat(F.lit("#"), (place + 1).cast("string"))))


def is_regular(item_type: Column) -> Column:
    return ~F.coalesce(item_type.isin(*NOT_REGULAR), F.lit(False))


def has_graph(item_type: Column, doi: Column, pmid: Column) -> Column:
    return is_regular(item_type) & (missing(doi).isNotNull() | missing(pmid).isNotNull())


def is_refreshed(item_type: Column, excluded: str = NOT_REFRESHED) -> Column:
    return ~F.array_contains(F.split(F.lit(excluded), r",\s*"), item_type)


def cache_key(library_id: Column, item_key: Column) -> Column:
    return F.concat_ws("/", library_id.cast("string"), item_key)


def short_label(author: Column, year: Column, title: Column) -> Column:
    """Surname and year, else the title cut at 20 characters."""
    surname = missing(F.element_at(F.split(strip(author), r"\s+"), -1))
    cut = F.when(F.length(title) > 20, F.concat(F.substring(title, 1, 20), F.lit("…"))).otherwise(title)
    return F.coalesce(missing(F.concat_ws(" ", surname, missing(year))), cut)


def luminance(colour: Column) -> Column:
    """0 to 1 of #rgb or #rrggbb; null for anything else."""
    c = F.regexp_extract(F.trim(colour), r"^#([0-9a-fA-F]{3}|[0-9a-fA-F]{6})\z", 1)
    six = F.when(F.length(c) == 3, F.regexp_replace(c, "(.)", "$1$1")).otherwise(c)
    part = lambda i: F.conv(F.substring(six, i, 2), 16, 10).cast("double")
    return F.when(c != "", (0.2126 * part(1) + 0.7152 * part(3) + 0.0722 * part(5)) / 255)


def edited(refs: DataFrame, edits: DataFrame, as_of_year: int) -> DataFrame:
    """refs(ref_id, text, title, authors, year, venue, doi, arxiv, pmid, url, lib_item_id) with edits(ref_id, text) parsed
    again: their fields replace the old ones, and the link to the library goes."""
    from citespark.functions.text import first_url, identifiers, parse_reference

    e = edits.select("ref_id", F.col("text").alias("_text"), identifiers("text").alias("_i"), parse_reference("text", as_of_year).alias("_p"), first_url("text").alias("_u"))
    out = refs.join(e, "ref_id", "left")
    new = {
        "text": F.col("_text"), "title": F.col("_p.title"), "authors": F.col("_p.authors"), "year": F.col("_p.year"), "venue": F.col("_p.venue"), "doi": F.col("_i.doi"), "arxiv": F.col("_i.arxiv"), "pmid": F.col("_i.pmid"),
        "url": F.coalesce("_u", identifier_url(F.col("_i.doi"), F.col("_i.arxiv"), F.col("_i.pmid"))), "lib_item_id": F.lit(None).cast("long"),
    }
    return out.select("ref_id", *(F.when(F.col("_text").isNotNull(), v).otherwise(F.col(c)).alias(c) for c, v in new.items()))
