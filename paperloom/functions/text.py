"""Text expressions: all are built-in functions, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it: Spark repeats an expression at each of its places."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def strip(text: Column) -> Column:
    """White space of any script off both ends. Most texts have none there: the pattern isn't tried on them."""
    at_end = lambda t: F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1)).rlike(r"(?U)\s")
    return let(text, lambda t: F.when(at_end(t), F.regexp_replace(t, r"(?U)^\s+|\s+$", "")).otherwise(t))


def collapsed(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """Pieces between white space; none for a blank text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and digits of three characters or more, repeats included."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: F.length(w) > 2)


def sentences(text: Column) -> Column:
    """Trimmed, non-empty pieces after white space that follows a full stop, ! or ?."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")


def has_any(text: Column, some: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for each in some:
        found = found | text.contains(each)
    return found


def n_contained(text: Column, some: tuple[str, ...]) -> Column:
    return sum((text.contains(each).cast("int") for each in some), F.lit(0))


def n_digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^0-9]", ""))


NUMBER = r"(\d{1,3}(?:,\d{3})*(?:\.\d+)?)"
UNITS = r"(?:\s*(%|USD|ETB|EUR|million|billion|thousand))?"
#: A number is not the middle of a word. Without thousands marks, its first three digits are taken: 2025 is 202.
NUMERIC = rf"(?iU)(?<!\w){NUMBER}{UNITS}"
#: The same, with any number of digits.
STRICT = rf"(?iU)(?<!\w)(\d+(?:,\d{{3}})*(?:\.\d+)?){UNITS}"


def number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).cast("double")


def written(value: Column) -> Column:
    """A number as text with its decimal point, never in powers of ten: 15.0, 12500000.0, 0.5."""
    digits = F.regexp_replace(value.cast("decimal(38,10)").cast("string"), "0+$", "")
    return F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)


def first_number(text: Column) -> Column:
    return number(F.nullif(F.regexp_extract(text, NUMERIC, 1), F.lit("")))


def year(text: Column) -> Column:
    return F.regexp_extract(text, r"(?U)\b((?:19|20)\d{2})\b", 1)


#: Month names, and their short forms.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SHORT_MONTHS = ("jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec")


def month(text: Column) -> Column:
    """The first month named, in full or in short, in lower case; empty where there is none."""
    return F.regexp_extract(F.lower(text), rf"(?U)\b({'|'.join(MONTHS + SHORT_MONTHS)})\b", 1)


def date_hint(sentence: Column) -> Column:
    """A quarter (with its year), else a year, else nothing."""
    quarter = F.regexp_extract(sentence, r"(?iU)\b(Q[1-4](?:\s+\d{4})?)\b", 1)
    return F.coalesce(F.nullif(quarter, F.lit("")), year(sentence))


def full_date(text: Column) -> Column:
    """The first `d Month yyyy` with the month in full, else the first with it in short; empty where there is none."""
    full, short = "|".join(MONTHS), "|".join(SHORT_MONTHS)
    long_first = let(F.regexp_extract(text, rf"(?iU)\b(\d{{1,2}}\s+(?:{full})\s+\d{{4}})\b", 1), lambda first: F.when(first != "", first).otherwise(F.regexp_extract(text, rf"(?iU)\b(\d{{1,2}}\s+(?:{short})\s+\d{{4}})\b", 1)))
    return F.when(text.rlike(r"(?U)\d"), long_first).otherwise(F.when(text.isNotNull(), ""))  # most texts have no digit: the dear patterns aren't tried on them


def first_sentence(text: Column) -> Column:
    """Up to the first `. `, else `? `, else `! `, of the collapsed text; else its first 240 characters."""
    flat = collapsed(text)
    out = F.substring(flat, 1, 240)
    for mark in ("! ", "? ", ". "):
        out = F.when(flat.contains(mark), F.concat(strip(F.substring_index(flat, mark, 1)), F.lit(mark[0]))).otherwise(out)
    return out


def summary(text: Column, most: int = 220) -> Column:
    return F.substring(collapsed(text), 1, most)


def excerpt(text: Column, keywords: Column, before: int = 60, size: int = 320, flat: bool = False) -> Column:
    """size characters of the collapsed text, from a little before its first keyword. flat: text is collapsed already."""
    places = lambda t: let(F.lower(t), lambda low: F.filter(F.transform(keywords, lambda k: F.instr(low, k)), lambda p: p > 0))
    start = lambda t: F.greatest(F.lit(1), F.coalesce(F.array_min(places(t)), F.lit(1)) - before)
    return let(text if flat else collapsed(text), lambda t: F.substring(t, start(t), F.lit(size)))


#: HTML entities in titles.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def title(text: Column) -> Column:
    """The section title that a chunk opens with, or null."""
    line = F.substring_index(strip(text), "\n", 1)
    for entity, plain in ENTITIES:
        line = F.replace(line, F.lit(entity), F.lit(plain))
    line = F.regexp_replace(strip(F.ltrim(strip(line), F.lit("#"))), r"(?U)^[-*]\s+", "")
    line = F.btrim(collapsed(line), F.lit(" :-"))
    shouted = lambda line: (F.upper(line) == line) & line.rlike("[A-Za-z]")

    def short(line: Column, own: Column) -> Column:
        capital = F.size(F.filter(own, lambda w: F.substring(w, 1, 1).rlike(r"\p{Lu}")))
        return F.size(own).between(2, 14) & (shouted(line) | (capital >= 0.7 * F.size(own)) & (F.length(line) <= 110))

    def opening(line: Column) -> Column:
        named = line.rlike(r"(?U)^\d+(?:[.:)\-]|\s)") | F.lower(line).rlike(r"(?U)^(?:chapter|section|appendix|glossary)\b") | F.when((F.length(line) <= 110) | shouted(line), let(words(line), lambda own: short(line, own))).otherwise(False)
        return F.when((line != "") & ~F.lower(line).isin("content", "statistical bulletin") & named, F.substring(line, 1, 120))

    return let(line, opening)


def normal_title(text: Column) -> Column:
    low = F.regexp_replace(strip(F.lower(text)), r"(?U)^section\s+\d+\s*[:.\-]?\s*", "")
    low = F.regexp_replace(low, r"^\d+\s*[:.\-]?\s*", "")
    return strip(F.regexp_replace(low, r"[^a-z0-9]+", " "))


def human_id(document_id: Column) -> Column:
    return strip(F.regexp_replace(document_id, r"[_\-]+", " "))


#: Words by which a title names its document.
DOCUMENT_WORDS = ("report", "statement", "bulletin", "review", "plan")


def names_document(title_: Column, document_id: Column) -> Column:
    mine, own = normal_title(title_), normal_title(human_id(document_id))
    return (mine == own) | ((mine != "") & F.contains(own, mine)) | has_any(F.lower(title_), DOCUMENT_WORDS)
