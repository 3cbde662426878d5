"""Citation stems, inline citations and BibTeX entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a title that don't name it.
STEM_STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "into", "is", "of", "on", "or", "the", "to", "toward", "towards", "using", "via", "with")
# Characters that BibTeX gives a meaning.
BIBTEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def title_token(title: Column) -> Column:
    """The word that stands for a title: four ideographs, an acronym, or the first longer word."""
    ideographs = F.regexp_replace(title, r"[^\x{4E00}-\x{9FFF}]", "")
    stop = F.array(*map(F.lit, STEM_STOP))
    words = F.filter(F.split(title, "[^0-9A-Za-z]+"), lambda w: (w != "") & ~F.array_contains(stop, F.lower(w)) & (w.rlike("^[A-Z]{2,}$") | (F.length(w) > 3)))
    word = F.get(words, F.lit(0))
    return F.when(F.length(ideographs) >= 2, F.substring(ideographs, 1, 4)).when(word.rlike("^[A-Z]{2,}$"), word).otherwise(F.coalesce(F.lower(word), F.lit("untitled")))


def stem(authors: Column, year: Column, title: Column) -> Column:
    """Surname of the first author, year and title word."""
    first = F.get(authors, F.lit(0))
    words = F.filter(F.split(F.get(F.split(first, ","), F.lit(0)), r"(?U)\s+"), lambda w: w != "")
    surname = F.lower(F.regexp_replace(F.element_at(F.when(F.size(words) > 0, words), -1), r"[^0-9A-Za-z\x{4E00}-\x{9FFF}]", ""))
    surname = F.coalesce(F.nullif(surname, F.lit("")), F.lit("anon"))
    return F.concat(surname, F.when(F.coalesce(year, F.lit(0)) == 0, "nd").otherwise(year.cast("string")), title_token(title))


def inline(stem: Column, label: Column) -> Column:
    name = F.coalesce(F.nullif(F.btrim(stem), F.lit("")), F.lit("unknown"))
    return F.when(F.btrim(label) == "", F.concat(F.lit("("), name, F.lit(")"))).otherwise(F.concat(F.lit("("), name, F.lit(" "), F.btrim(label), F.lit(")")))


def escape(value: Column) -> Column:
    """Each special character replaced once."""
    table = F.create_map(*[F.lit(x) for pair in BIBTEX.items() for x in pair])
    return F.array_join(F.transform(F.split(value, ""), lambda c: F.coalesce(table[c], c)), "")


def reference_key(key: Column) -> Column:
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(key, r"""[\s,(){}\[\]"'\\~#%&=]""", "")), F.lit("")), F.lit("ref"))


def bibtex(s: Column) -> Column:
    """An entry for a struct of source fields; fields without a value are left out."""
    part = lambda name, value: F.concat(F.lit(f"  {name} = {{"), value, F.lit("}"))
    some = lambda c: F.nullif(c, F.lit(""))
    venue = some(s["venue"])
    kind = F.when(venue.isNotNull(), "article").otherwise("misc")
    fields = F.concat_ws(
        ",\n",
        part("title", escape(s["title"])),
        F.when(F.size(s["authors"]) > 0, part("author", escape(F.array_join(s["authors"], " and ")))),
        part("year", s["year"].cast("string")),
        part("journal", escape(venue)),
        part("doi", escape(some(s["doi"]))),
        part("url", escape(some(s["oa_url"]))),
        F.when(venue.isNull(), "  howpublished = {Preprint}"),
        F.when(s["retracted"], "  note = {RETRACTED}"),
    )
    return F.concat(F.lit("@"), kind, F.lit("{"), reference_key(stem(s["authors"], s["year"], s["title"])), F.lit(",\n"), fields, F.lit("\n}"))
