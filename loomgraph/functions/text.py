"""Column builders for surfaces, titles, dates and wiki markup: built-in expressions only, so that they stay in generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words stripped from both ends of a surface
STOP_WORDS = (
    "a an in the of it from with this that they he she some where what since his her their le la les il elle ce ça ci ceux ceci cela celle se cet cette "
    "dans avec con sans pendant durant avant après puis el lo la ese esto que qui quoi dont ou où si este esta cual eso ella depuis y a à su de des du los las "
    "un une una uno para asi later into dentro dedans depuis después desde al et por at for when why how with whether if thus then and but on during while as "
    "within was is est au fait font va vont sur en pour del cuando cuan do does until sinon encore to by be which have not were has also its isbn pp. &amp; p. ces o"
).split()
# fixed values: marks at an end that make a surface unusable
END_MARKS = "',-!.?:’"
# fixed values: what the titles of category pages begin with
CATEGORY_PREFIXES = "Category: Catégorie: Categorie: Categoría: Categoria: Kategorie: Kategoria: Категория: Kategori:".split()
# fixed values: what a page that redirects begins its link with
REDIRECT_WORDS = "#REDIRECT #weiterleitung #REDIRECCIÓN REDIRECIONAMENTO".split()
# fixed values: what the titles of pages that are no articles begin with
HIDDEN_TITLES = ("Wikipedia:", "Wikipédia:", "File:", "Media:", "Help:", "User:")


def parse_year(time: Column) -> Column:
    """The signed year of +1950-01-01T00:00:00Z or -0500-..., null if there is none."""
    return F.nullif(F.regexp_extract(time, r"^([+-]?\d+)-", 1), F.lit("")).cast("int")


def clean_title(title: Column) -> Column:
    """A link's target as a title: first character upper case, nothing from # on, blanks for underscores."""
    t = F.translate(F.substring_index(title, "#", 1), "_", " ")
    return F.concat(F.upper(F.substring(t, 1, 1)), t.substr(F.lit(2), F.length(t)))


def clean_surface(surface: Column) -> Column:
    """A link's text as a surface form: outer brackets, elisions, possessives and stop words gone, lower case; '' if unusable."""
    s = F.rtrim(surface)
    s = F.regexp_replace(s, r"^[()\[\]]+|[()\[\]]+$", "")
    unusable = F.length(s).eqNullSafe(0) | F.substring(s, 1, 1).isin(*END_MARKS) | F.substring(s, -1, 1).isin(*END_MARKS)
    s = F.regexp_replace(s, r"^[lLdDjJtT]'", "")
    s = F.regexp_replace(s, r"'s$", "")
    words = F.filter(F.split(s, r"[ \t\n\r]+"), lambda w: w != "")
    stop = "|".join(re.escape(w) for w in dict.fromkeys(STOP_WORDS))
    joined = F.lower(F.array_join(words, " "))
    joined = F.regexp_replace(joined, rf"^(?:(?:{stop})(?: |$))+", "")
    joined = F.regexp_replace(joined, rf"(?:(?:^| )(?:{stop}))+$", "")
    return F.when(surface.isNull(), F.lit(None).cast("string")).when(unusable, "").otherwise(joined)


def acceptable_surface(surface: Column) -> Column:
    """Whether a cleaned surface is a name at all: not empty, no number, ordinal or number with marks."""
    return F.coalesce((surface != "") & ~surface.rlike(r"^\d+$") & ~surface.rlike(r"^\d+(?:st|nd|rd|th)$") & ~surface.rlike(r"^[\d\s.,/:;%()+-]*$"), F.lit(False))


def name_alternates(name: Column) -> Column:
    """The name and what it may be the plural or the disambiguated form of; the first rule that fits decides."""
    alt = (
        F.when(name.endswith(")"), F.rtrim(F.regexp_extract(name, r"^(.*)\(", 1)))
        .when(name.endswith("ses"), F.concat(F.regexp_replace(name, "es$", ""), F.lit("is")))
        .when(name.endswith("ies"), F.concat(F.regexp_replace(name, "ies$", ""), F.lit("y")))
        .when(name.endswith("s"), F.regexp_replace(name, "s$", ""))
    )
    return F.when(alt.isNull(), F.array(name)).otherwise(F.array(name, alt))


def anchors(text: Column) -> Column:
    """Array of (anchor, target) of a text's links [[target|anchor]]; targets with a colon are other things and left out."""
    inner = F.regexp_extract_all(text, F.lit(r"\[\[([^\]\[:]*)\]\]"), F.lit(1))

    def parse(x: Column) -> Column:
        piped = x.contains("|")
        target = F.when(piped, F.trim(F.substring_index(F.trim(F.regexp_extract(x, r"^(.*)\|", 1)), "#", 1))).otherwise(F.trim(x))
        anchor = F.when(piped, F.trim(F.substring_index(x, "|", -1))).otherwise(F.trim(x))
        return F.struct(anchor.alias("anchor"), target.alias("target"))

    return F.filter(F.transform(inner, parse), lambda s: (s["anchor"] != "") & (s["target"] != ""))


def categories(text: Column) -> Column:
    """Array of category titles linked by a text, without what stands after a pipe."""
    names = "|".join(CATEGORY_PREFIXES)
    inner = F.regexp_extract_all(text, F.lit(rf"\[\[((?:{names})[^\]\[]*)\]\]"), F.lit(1))
    return F.transform(inner, lambda x: F.trim(F.when(x.contains("|"), F.substring_index(F.regexp_extract(x, r"^(.*)\|", 1), "#", 1)).otherwise(x)))


def redirect(text: Column) -> Column:
    """The title that a page redirects to, null if it is no redirect."""
    words = "|".join(REDIRECT_WORDS)
    inner = F.regexp_extract(text, rf"(?iu)(?:{words})\s*\[\[([^\]\[]*)\]\]", 1)
    return F.nullif(F.trim(F.substring_index(F.substring_index(inner, "|", 1), "#", 1)), F.lit(""))


def clean_markup(text: Column) -> Column:
    """Plain text of a page: line ends as \\n, no notes or templates, headings as sentences of their own, list marks set off by a blank."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"\t", " ")
    t = F.regexp_replace(t, r"(?s)<ref[^<>]*>.*?</ref>", " ")
    t = F.regexp_replace(t, r"(?s)\{\{[^{}]*\}\}", " ")
    t = F.regexp_replace(t, r"(?m)^==+ ?([^=\n]*?) ?==+[ \t]*$", "\n\n$1. ")
    return F.regexp_replace(t, r"(?m)^([*#]+) ?", "$1 ")


def fragments(text: Column) -> Column:
    """Array of (pos, text, dest) of a page in order: links with their target, and the stretches between them with a null dest."""
    parts = F.filter(F.split(F.regexp_replace(text, r"(\[\[[^\]\[]*\]\])", "\u0001$1\u0001"), "\u0001"), lambda x: x != "")

    def parse(x: Column, i: Column) -> Column:
        link = x.rlike(r"(?s)^\[\[[^\]\[]*\]\]$")
        inner = F.regexp_extract(x, r"(?s)^\[\[([^\]\[]*)\]\]$", 1)
        dest = F.nullif(F.trim(F.substring_index(inner, "|", 1)), F.lit(""))
        return F.struct(i.alias("pos"), F.when(link, F.substring_index(inner, "|", -1)).otherwise(x).alias("text"), F.when(link, dest).alias("dest"))

    return F.transform(parts, parse)


_WORD = r"[\p{L}\p{M}]+(?:'[\p{L}\p{M}]+)?|\p{Nd}+"
_MARK = r"[^\p{L}\p{M}\p{Nd}\p{Z}\s]"


def tokens(text: Column) -> Column:
    """Words, numbers and single marks in order, of any script: our own plain tokenizer, blanks dropped. Combining marks belong to words;
    a run of letters without blanks (Thai, Chinese) is one word."""
    return F.regexp_extract_all(text, F.lit(rf"{_WORD}|{_MARK}"), F.lit(0))


def pieces(text: Column) -> Column:
    """The tokens with the runs of blanks between them: joined they are the text."""
    return F.regexp_extract_all(text, F.lit(rf"{_WORD}|[\p{{Z}}\s]+|{_MARK}"), F.lit(0))


def token_lines(text: Column) -> Column:
    """The tokens with an empty one for each blank line between them."""
    lines = F.regexp_extract_all(text, F.lit(rf"{_WORD}|{_MARK}|\r?\n[ \t]*\r?\n"), F.lit(0))
    return F.transform(lines, lambda t: F.when(t.rlike(r"^[\r\n]"), "").otherwise(t))


def byte_codes(word: Column, size: int) -> Column:
    """A word's UTF-8 bytes between 255 and 256, filled up with -1 to `size` places; longer words are not cut."""
    hexed = F.hex(F.encode(word, "UTF-8"))
    n = F.length(hexed) / 2
    codes = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), lambda i: F.conv(F.substring(hexed, i * 2 - 1, F.lit(2)), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))
    whole = F.concat(F.array(F.lit(255)), codes, F.array(F.lit(256)))
    return F.concat(whole, F.array_repeat(F.lit(-1), F.greatest(F.lit(0), F.lit(size) - F.size(whole))))


def uppercase(word: Column) -> Column:
    """Whether a word begins with an upper-case letter of any script."""
    return word.rlike(r"^\p{Lu}")


def token_features(word: Column, size: int = 3) -> dict[str, Column]:
    """Features of a token by name: suffix, prefix, digits only, number of ASCII marks, upper-case beginning."""
    return {
        "suffix": F.substring(word, -size, size),
        "prefix": F.substring(word, 1, size),
        "digit": word.rlike(r"^\p{Nd}+$"),
        "punctuation_count": F.length(F.regexp_replace(word, r"[^!-/:-@\[-`{-~]", "")),
        "uppercase": uppercase(word),
    }
