"""Text functions as column expressions: everything stays inside the JVM.

A null argument gives null unless said otherwise. White space and words are Unicode's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words the analyzer drops.
STOPWORDS = (
    "a an and are as at be been but by did do does for from had has have he her his how i in into is it its "
    "of on or our she that the their them they this to was we were what when where which who whom why will with "
    "you your not than then there these those about after before can could would should also more most"
).split()
# Titles dropped at the start of a name, and words whose full stop ends no sentence.
TITLES = ["DR", "MR", "MRS", "MS", "PROF", "THE"]
ABBREVIATIONS = ["Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "St.", "vs.", "e.g.", "i.e.", "etc."]
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def count_words(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"(?U)\S+"), F.lit(0)))


def count_tokens(c: Column) -> Column:
    """Four thirds of the number of words, rounded up; 0 for null and empty texts."""
    return F.coalesce(F.ceil(count_words(c) * 4 / F.lit(3.0)), F.lit(0)).cast("int")


def truncate_tokens(c: Column, most: int) -> Column:
    """The text if it fits, else as many first words as fit, joined by single spaces."""
    words = F.regexp_extract_all(c, F.lit(r"(?U)\S+"), F.lit(0))
    return F.when(count_tokens(c) <= most, c).otherwise(F.array_join(F.slice(words, 1, int(most * 3 / 4)), " "))


def analyze(c: Column) -> Column:
    """Lower-case ASCII words without stop words; a plural s of longer words is dropped."""
    words = F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(STOPWORDS))
    return F.transform(words, lambda w: F.when((F.length(w) > 4) & w.endswith("s") & ~w.endswith("ss"), w.substr(F.lit(1), F.length(w) - 1)).otherwise(w))


def overlap(a: Column, b: Column) -> Column:
    """Number of distinct analyzed words that two texts share."""
    return F.size(F.array_intersect(analyze(a), analyze(b)))


def normalize_name(c: Column) -> Column:
    """Upper case words of letters and digits, without possessives and leading titles."""
    words = F.array_join(F.regexp_extract_all(F.regexp_replace(F.upper(c), r"['’]S\b", ""), F.lit("[A-Z0-9]+"), F.lit(0)), " ")
    return F.regexp_replace(words, "^((" + "|".join(TITLES) + r")( |$))+", "")


def normalize_answer(c: Column) -> Column:
    """Lower case without ASCII punctuation, articles and surplus white space."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), PUNCTUATION, ""), r"(?U)\b(a|an|the)\b", " ")
    return F.array_join(F.regexp_extract_all(bare, F.lit(r"(?U)\S+"), F.lit(0)), " ")


def clean_field(c: Column) -> Column:
    """Without outer white space and quotes, and the white space inside them."""
    return F.regexp_replace(c, r"""(?U)^\s*"*'*\s*|\s*'*"*\s*$""", "")


def clean_cell(c: Column) -> Column:
    """Fit for a cell of a pipe table."""
    return F.regexp_replace(F.translate(c, "|\n", "/ "), r"(?U)^\s+|\s+$", "")


def clean_sentence(c: Column) -> Column:
    """Without bold marks, surplus white space and outer list marks."""
    flat = F.array_join(F.regexp_extract_all(F.regexp_replace(c, r"\*\*", ""), F.lit(r"(?U)\S+"), F.lit(0)), " ")
    return F.regexp_replace(flat, r"^[#*>\- ]+|[#*>\- ]+$", "")


def between(c: Column, start: str, end: str) -> Column:
    """What stands after the last start marker, up to the next end marker; empty without a start marker."""
    tail = F.substring_index(c, start, -1)
    return F.when(F.instr(c, start) == 0, F.lit("")).otherwise(F.substring_index(tail, end, 1))


def partial_date(c: Column) -> Column:
    """A date from yyyy, yyyy-mm or yyyy-mm-dd; null where there is none."""
    return F.try_to_timestamp(F.concat(c, F.when(F.length(c) == 4, "-01-01").when(F.length(c) == 7, "-01").otherwise("")), F.lit("yyyy-MM-dd")).cast("date")


def tolerant_json(c: Column, schema: str) -> Column:
    """The outermost {...} of a model's reply, read by the schema; null where it can't be read."""
    return F.from_json(F.regexp_extract(c, r"(?s)\{.*\}", 0), schema)


def protect_abbreviations(c: Column) -> Column:
    """Abbreviations' full stops become a mark that ends no sentence."""
    for a in ABBREVIATIONS:
        c = F.regexp_replace(c, r"(?<![A-Za-z])" + a.replace(".", r"\."), a.replace(".", "․"))
    return c


def sentences(c: Column) -> Column:
    """The sentences of a text: cut after [.!?] before white space and at line ends, not after abbreviations; blank ones dropped."""
    parts = F.split(protect_abbreviations(c), r"\n|(?<=[.!?])(?=[^\S\n])")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(F.translate(s, "․", "."), r"(?U)^\s+|\s+$", "")), lambda s: F.length(s) > 0)
