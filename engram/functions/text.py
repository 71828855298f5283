"""Text functions: English terms, trigrams, chat text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop words of the Snowball project, in their usual order.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his
himself she her hers herself it its itself they them their theirs themselves what which
who whom this that these those am is are was were be been being have has had having do
does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on
off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just
don should now
""".split()

# The token separator and the weights of heading, summary and context.
TOKEN_SEPARATOR = r"[^\p{L}\p{N}]+"
HEADING_WEIGHT, SUMMARY_WEIGHT, CONTEXT_WEIGHT = 1.0, 0.4, 0.2
TRIGRAM_THRESHOLD = 0.3

TRIGRAM_WINDOW = r"(?=(..[^ ]|.[^ ] ))"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.array_remove(F.split(F.lower(text), TOKEN_SEPARATOR), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def is_stop_word(word: Column) -> Column:
    return word.isin(STOP_WORDS)


def _replace(word: Column, *rules: tuple[str, str]) -> Column:
    for pattern, replacement in rules:
        word = F.regexp_replace(word, pattern, replacement)
    return word


# Porter's step 1 as replacements; \x01 marks where -ed or -ing was cut off.
_PLURAL = [(r"(ss|i)es$", "$1"), (r"([^s])s$", "$1")]
_PAST = [
    (r"([aeiouy][^aeiouy].*)eed$", "$1ee"),
    (r"([aeiouy].*)(?:(?<!e)ed|ing)$", "$1\x01"),
    (r"(at|bl|iz)\x01$", "$1e"),
    (r"([bdfgmnprt])\1?\x01$", "$1"),
    (r"\x01$", ""),
]
_FINAL_Y = [(r"([aeiouy].*)y$", "$1i")]


def stem(word: Column) -> Column:
    """Step 1 of Porter's 1980 suffix stripping: plurals, -ed, -ing and final -y.

    The last letters decide which patterns are tried at all, since most words keep theirs.
    """
    return (
        F.when(F.length(word) <= 2, word)
        .when(word.endswith("s"), _replace(word, *_PLURAL, *_PAST, *_FINAL_Y))
        .when(word.endswith("ed") | word.endswith("ing"), _replace(word, *_PAST, *_FINAL_Y))
        .when(word.endswith("y"), _replace(word, *_FINAL_Y))
        .otherwise(word)
    )


def terms(text: Column) -> Column:
    """Stemmed words without stop words, in order."""
    return F.transform(F.filter(words(text), lambda w: ~is_stop_word(w)), stem)


def query_terms(text: Column) -> Column:
    """The distinct terms a plain-text query asks for; all of them must match."""
    return F.array_sort(F.array_distinct(terms(text)))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """Compute a value once per row and use it several times."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def trigrams(text: Column) -> Column:
    """Distinct three-letter grams of every word, padded two blanks before, one after.

    With the distinct words three blanks apart, the grams are all windows that do not end
    in two blanks; one pattern finds them in a single pass.
    """
    spaced = F.concat(
        F.lit("  "), F.array_join(F.array_distinct(words(text)), "   "), F.lit(" ")
    )
    return F.array_distinct(F.regexp_extract_all(spaced, F.lit(TRIGRAM_WINDOW), F.lit(1)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared share of two trigram sets; 0 when both are empty."""

    def share(sets: Column) -> Column:
        shared = F.size(F.array_intersect(sets["a"], sets["b"]))
        either = F.size(sets["a"]) + F.size(sets["b"]) - shared
        return F.coalesce(shared / F.nullif(either, F.lit(0)).cast("double"), F.lit(0.0))

    return once(F.struct(a.alias("a"), b.alias("b")), share)


def strip(text: Column) -> Column:
    """Remove white space of every kind at both ends (trim alone takes blanks only)."""
    return F.trim(text, F.lit(" \t\n\r\f\v"))


def first_turns(turns: Column, n: int = 3) -> Column:
    """The opening turns joined by a blank: the query of the duplicate check."""
    return F.array_join(F.slice(turns, 1, n), " ")


def embed_text_input(heading: Column, summary: Column) -> Column:
    return F.concat(heading, F.lit("\n\n"), summary)
