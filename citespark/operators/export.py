"""References as text, Markdown, CSV and citation strings, one line each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citespark.functions.text import missing

HEADER = "number,title,authors,year,venue,doi,url,text"


def text_line(number: Column, pos: Column, text: Column, title: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(number, pos).cast("string"), F.lit("] "), F.coalesce(missing(text), missing(title), F.lit("")))


def markdown_line(number: Column, pos: Column, text: Column, title: Column, url: Column, doi: Column) -> Column:
    """A list entry, linked to the address or else to the DOI."""
    label = F.coalesce(missing(text), missing(title), F.lit(""))
    link = F.coalesce(missing(url), F.concat(F.lit("https://doi.org/"), missing(doi)))
    body = F.when(link.isNotNull(), F.concat(F.lit("["), label, F.lit("]("), link, F.lit(")"))).otherwise(label)
    return F.concat(F.coalesce(number, pos).cast("string"), F.lit(". "), body)


def csv_line(number: Column, *fields: Column) -> Column:
    """The number as it is, every other field in quotes, quotes doubled; a null field is empty."""
    quoted = (F.concat(F.lit('"'), F.replace(F.coalesce(f.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for f in fields)
    return F.concat_ws(",", F.coalesce(number.cast("string"), F.lit("")), *quoted)


def citation(authors: Column, year: Column, title: Column, venue: Column, doi: Column) -> Column:
    """Up to three authors (et al. for more), (year)., title., venue. and the DOI's address; what is missing is left out."""
    names = F.concat(F.array_join(F.slice(authors, 1, 3), ", "), F.when(F.size(authors) > 3, F.lit(" et al.")).otherwise(F.lit("")))
    dot = lambda c: F.concat(missing(c), F.lit("."))
    return F.concat_ws(" ", missing(names), F.concat(F.lit("("), missing(year), F.lit(").")), dot(title), dot(venue), F.concat(F.lit("https://doi.org/"), missing(doi)))


def write_lines(lines: DataFrame, path: str) -> None:
    """A one-column frame of lines as text files."""
    lines.write.mode("overwrite").text(path)
