"""Accent-free text, slugs and tolerant search with a thesaurus."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _bare(letter: str) -> str:
    """The letter without its marks, compatibility forms (ligatures, wide letters) spelled out."""
    return "".join(c for c in unicodedata.normalize("NFKD", letter.lower()) if not unicodedata.combining(c)).lower()


# Built by rule: every letter of the Latin, Greek and Cyrillic blocks that has a plainer form.
_BLOCKS = (range(0xA0, 0x530), range(0x1D00, 0x2000), range(0x2C60, 0x2C80), range(0xA720, 0xA800), range(0xFB00, 0xFB07), range(0xFF21, 0xFF5B))
_LETTERS = {chr(c): _bare(chr(c)) for block in _BLOCKS for c in block if chr(c).isalpha()}
_FORMS = {c: plain for c, plain in _LETTERS.items() if plain and c == c.lower() and c != plain}
_ONE = {c: plain for c, plain in _FORMS.items() if len(plain) == 1}
_MANY = {c: plain for c, plain in _FORMS.items() if len(plain) > 1}
_MARKS = "".join(chr(c) for c in (*range(0x300, 0x370), *range(0x1AB0, 0x1B00), *range(0x1DC0, 0x1E00), *range(0x20D0, 0x2100)) if unicodedata.combining(chr(c)))


def strip_accents(text: Column | str) -> Column:
    """Lower case without accents, ligatures spelled out, runs of blanks collapsed; precomposed and combining forms alike."""
    text = F.lower(F.col(text) if isinstance(text, str) else text)
    # Characters without a counterpart (the combining marks) are dropped by translate.
    bare = F.translate(text, "".join(_ONE) + _MARKS, "".join(_ONE.values()))
    # Letters of several characters are rare; text without one costs a single test.
    spelled = bare
    for letter, plain in _MANY.items():
        spelled = F.replace(spelled, F.lit(letter), F.lit(plain))
    bare = F.when(bare.rlike("[" + "".join(_MANY) + "]"), spelled).otherwise(bare)
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def fold(text: str) -> str:
    """What ``strip_accents`` makes of a text, for the words of a query."""
    table = str.maketrans(_FORMS | dict.fromkeys(_MARKS, ""))
    return " ".join(text.lower().translate(table).split())


def slugify(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(strip_accents(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def contains_ci(query: str, *columns: str) -> Column:
    """Literal containment in any of the columns, ignoring case; ``%`` and ``_`` of the query are literal."""
    needle = query.lower()
    test = F.lit(False)
    for name in columns:
        test = test | F.contains(F.lower(F.col(name)), F.lit(needle))
    return test


def thesaurus_frame(spark: SparkSession, thesaurus: Mapping[str, Sequence[str]]) -> DataFrame:
    """``heading`` and ``term``: one row per synonym, both folded."""
    pairs = [(fold(heading), fold(term)) for heading, terms in thesaurus.items() for term in terms]
    return spark.createDataFrame(pairs, "heading string, term string")


def expansion(said: str, thesaurus: DataFrame) -> DataFrame:
    """The terms of all headings that a folded query names: a phrase anywhere in it, a single word as a word of it."""
    words = F.array(*[F.lit(w) for w in said.split(" ")])
    phrase = F.contains(F.col("heading"), F.lit(" "))
    named = (phrase & F.contains(F.lit(said), F.col("heading"))) | (~phrase & F.array_contains(words, F.col("heading")))
    return thesaurus.where(named & (F.col("term") != said)).select("term").distinct()


def synonym_search(df: DataFrame, columns: str | Sequence[str], query: str, thesaurus: Mapping[str, Sequence[str]] | DataFrame, most: int | None = None) -> DataFrame:
    """Rows with any term in the folded text of a column; ``synonym_only`` is 0 for literal hits, 1 for hits by synonym alone.

    All synonyms count unless the caller asks for ``most`` of them (the first in alphabetical order).
    """
    said = fold(query)
    if not said:
        return df.withColumn("synonym_only", F.lit(0))
    frame = thesaurus if isinstance(thesaurus, DataFrame) else thesaurus_frame(df.sparkSession, thesaurus)
    terms = F.array_sort(F.collect_set("term"))
    quoted = F.transform(terms if most is None else F.slice(terms, 1, most), lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E")))
    # One pattern, read as a scalar: the text is folded once per row, not once per term, and nothing is joined to it.
    pattern = expansion(said, frame).agg(F.concat_ws("|", F.array_append(quoted, F.lit(rf"\Q{said}\E")))).scalar()
    names = [columns] if isinstance(columns, str) else list(columns)
    folded = F.concat_ws("\n", *[strip_accents(F.col(c).cast("string")) for c in names])
    found = df.withColumn("_folded", folded).where(F.rlike(F.col("_folded"), pattern))
    return found.withColumn("synonym_only", F.when(F.contains(F.col("_folded"), F.lit(said)), 0).otherwise(1)).drop("_folded")
