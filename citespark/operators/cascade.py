"""Ordered fallback between sources: which one answers for an item, and which one is asked first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sources asked for reference lists, citations and related works, in order.
REFERENCES = ("crossref", "semanticscholar", "openalex")
CITATIONS = ("semanticscholar", "openalex")
RELATED = ("semanticscholar", "openalex")
# Sources asked for a work's record by what is known of it, in order.
CANDIDATES = (
    ("arxiv", "arxiv", 0), ("arxiv", "semanticscholar", 1),
    ("doi", "crossref", 0), ("doi", "semanticscholar", 1), ("doi", "openalex", 2), ("doi", "unpaywall", 3), ("doi", "readpaper", 4),
    ("pmid", "pubmed", 0), ("pmid", "semanticscholar", 1), ("pmid", "openalex", 2),
    ("title_zh", "cnki", 0),
    ("title", "crossref", 0), ("title", "semanticscholar", 1), ("title", "openalex", 2), ("title", "pubmed", 3), ("title", "readpaper", 4), ("title", "connectedpapers", 5),
)


def first_answering(answers: DataFrame, order: tuple[str, ...], item: str = "item_id") -> DataFrame:
    """Rows of answers(item, source, ...) of the first source of `order` that has any for the item."""
    prio = reduce(lambda c, x: c.when(F.col("source") == x[1], x[0]), enumerate(order), F.when(F.lit(False), F.lit(-1)))
    ranked = answers.withColumn("_p", prio).where("_p is not null")
    best = ranked.groupBy(item).agg(F.min("_p").alias("_p"))
    return ranked.join(best, [item, "_p"]).drop("_p")


def staged(stages: list[DataFrame], item: str = "item_id") -> DataFrame:
    """The same for sources that are costly to ask: each stage's rows of items that no stage before has answered, so that
    a stage can be read with the items that are left."""
    out = stages[0]
    done = stages[0].select(item).distinct()
    for s in stages[1:]:
        new = s.join(done, item, "left_anti")
        out = out.unionByName(new)
        done = done.unionByName(new.select(item)).distinct()
    return out


def empty_or_missing(status: DataFrame, order: tuple[str, ...] = CITATIONS) -> DataFrame:
    """(item_id, source, n_items, outcome) from status(item_id, source, answered, n_items): the first source with rows;
    else the last of `order` that answered with none, as outcome empty; else outcome failed."""
    prio = reduce(lambda c, x: c.when(F.col("source") == x[1], x[0]), enumerate(order), F.when(F.lit(False), F.lit(-1)))
    s = status.withColumn("p", prio).where("p is not null")
    got = F.min_by(F.struct("source", "n_items"), F.when(F.col("answered") & (F.col("n_items") > 0), F.col("p")))
    none = F.max_by(F.struct("source", "n_items"), F.when(F.col("answered") & (F.col("n_items") == 0), F.col("p")))
    agg = s.groupBy("item_id").agg(got.alias("g"), none.alias("e"), F.max((F.col("answered") & (F.col("n_items") > 0)).cast("int")).alias("some"), F.max((F.col("answered") & (F.col("n_items") == 0)).cast("int")).alias("nil"))
    pick = F.when(F.col("some") == 1, F.col("g")).when(F.col("nil") == 1, F.col("e"))
    outcome = F.when(F.col("some") == 1, "rows").when(F.col("nil") == 1, "empty").otherwise("failed")
    return agg.select("item_id", pick["source"].alias("source"), F.coalesce(pick["n_items"], F.lit(0)).cast("long").alias("n_items"), outcome.alias("outcome"))


def best_key(arxiv: Column, doi: Column, pmid: Column, title: Column, chinese: Column) -> Column:
    """By what a record is looked up: arXiv before DOI, PMID and the title."""
    return F.when(arxiv.isNotNull(), "arxiv").when(doi.isNotNull(), "doi").when(pmid.isNotNull(), "pmid").when(title.isNotNull() & chinese, "title_zh").when(title.isNotNull(), "title")


def candidates(refs: DataFrame, key: str = "according") -> DataFrame:
    """refs with a row for each source that is asked for them: source, ord. The rules are a fixed small table."""
    spark = refs.sparkSession
    rules = spark.createDataFrame(list(CANDIDATES), f"{key} string, source string, ord int")
    return refs.join(F.broadcast(rules), key)


def preferred(cards: DataFrame, remembered: DataFrame | None = None) -> DataFrame:
    """Of cards(ref_id, ord, ...) the remembered one (ref_id, ord) where it answered, else the first."""
    rows = cards if remembered is None else cards.join(remembered.select("ref_id", F.col("ord").alias("_m")), "ref_id", "left")
    order = F.struct(F.when(F.col("ord") == F.col("_m"), 0).otherwise(1), "ord") if remembered is not None else F.struct("ord")
    rest = [c for c in cards.columns if c != "ref_id"]
    return rows.groupBy("ref_id").agg(F.min_by(F.struct(*rest), order).alias("_r")).select("ref_id", "_r.*")


def import_action(matched: Column, chinese: Column, doi: Column, arxiv: Column, pmid: Column, title_doi: Column, title: Column, has_authors: Column, year: Column) -> Column:
    """What importing a reference does: an item of the library is linked; Chinese references go by their own way; then
    identifiers, a DOI by title, and the reference's own fields; else it fails."""
    return (
        F.when(matched, "link")
        .when(chinese, "cnki")
        .when(doi.isNotNull(), "doi")
        .when(arxiv.isNotNull(), "arxiv")
        .when(pmid.isNotNull(), "pmid")
        .when(title_doi.isNotNull(), "doi_by_title")
        .when(title.isNotNull() & (has_authors | year.isNotNull()), "direct")
        .otherwise("fail")
    )


def tally(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Counts of outcome ok, fail and stopped."""
    return outcomes.groupBy(*by).agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("ok", "fail", "stopped")))


def locate(lib_url: Column, url: Column, id_url: Column, title_url: Column) -> Column:
    """Where a reference is opened: its library item, its address, its identifier's, the one found by title."""
    return F.coalesce(lib_url, url, id_url, title_url)
