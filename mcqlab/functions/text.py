"""Rule-based text metrics as Column -> Column functions.

Every function returns null for a null text and stays inside the JVM.
White space and word characters are spelled as explicit classes, because the
short escapes differ between regex dialects.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that make a question negative.
NEGATIONS = (
    "not", "no", "don't", "doesn't", "isn't", "aren't", "wasn't", "weren't", "won't", "can't", "couldn't",
    "shouldn't", "wouldn't", "didn't", "haven't", "hasn't", "hadn't", "mustn't",
)
#: The words that open a question.
QUESTION_WORDS = ("who", "what", "where", "when", "why", "how", "does", "should", "do", "did", "could", "will", "would")
#: White space, in Java's dialect.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
NON_WORD = r"[^\p{L}\p{N}_]"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it inside its own lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def _opens_with(text: Column, words: Sequence[str]) -> Column:
    return strip(text).rlike(rf"(?i)^({'|'.join(words)})($|{NON_WORD})")


def starts_with_negation(text: Column) -> Column:
    return _opens_with(text, NEGATIONS)


def is_question(text: Column) -> Column:
    """Ends with a question mark or opens with a question word."""
    return strip(text).endswith("?") | _opens_with(text, QUESTION_WORDS)


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def syllable_count(word: Column) -> Column:
    """Runs of ASCII vowels, at least one."""
    return F.greatest(F.lit(1), F.regexp_count(F.lower(word), F.lit("[aeiouy]+")))


def readability(text: Column) -> Column:
    """Grade by words per sentence and syllables per word; null without a word or a sentence end."""
    n_sentences = F.length(text) - F.length(F.translate(text, ".!?", ""))

    def of(parts: Column) -> Column:
        n_words = F.size(parts)
        n_syllables = F.aggregate(parts, F.lit(0), lambda n, w: n + syllable_count(w))
        grade = F.lit(0.39) * (n_words / n_sentences) + F.lit(11.8) * (n_syllables / n_words) - F.lit(15.59)
        return F.when((n_words > 0) & (n_sentences > 0), grade)

    return bound(words(text), of)


def clean_tokens(text: Column, stopwords: Sequence[str] = (), lemmas: Column | None = None) -> Column:
    """Lower-cased words without stop words. lemmas: a map column from form to lemma."""
    tokens = F.split(F.trim(F.lower(F.regexp_replace(text, f"{NON_WORD}+", " "))), " +")
    tokens = F.filter(tokens, lambda w: (w != "") & ~w.isin(list(stopwords)) if stopwords else w != "")
    return tokens if lemmas is None else F.transform(tokens, lambda w: F.coalesce(F.try_element_at(lemmas, w), w))


def trigrams(tokens: Column) -> Column:
    """Distinct runs of three tokens; none below three tokens."""

    def of(t: Column) -> Column:
        n = F.size(t)
        grams = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.concat_ws(" ", F.get(t, i - 1), F.get(t, i), F.get(t, i + 1)))
        return F.when(n >= 3, F.array_distinct(grams)).when(n >= 0, F.array().cast("array<string>"))

    return bound(tokens, of)


def originality(question_grams: Column, sheet_grams: Column) -> Column:
    """Share of the question's trigrams that the sheet has not; 0 without a trigram."""

    def of(own: Column) -> Column:
        n = F.size(own)
        return F.when(n == 0, F.lit(0.0)).when(n > 0, F.size(F.array_except(own, sheet_grams)) / n)

    return bound(question_grams, of)


def length_score(text: Column, low: int, high: int) -> Column:
    """1 for a word count within the bounds, else the squared ratio to the nearer bound."""
    n = F.size(words(text)).cast("double")
    return F.when(n > high, F.pow(high / n, 2)).when(n < low, F.pow(n / low, 2)).when(n >= low, F.lit(1.0))


def sheet_id(name: Column) -> Column:
    return F.substring(name, 1, 12)


def extract_rubric(text: Column, marker: str = "Rubrique") -> Column:
    """Lines that hold the marker, joined, without the first ten characters, white space collapsed."""
    found = F.array_join(F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit(marker))), "\n")
    return strip(F.regexp_replace(F.substring(found, 11, 2**31 - 1), r"[ \t\n]+", " "))


def parse_score(text: Column) -> Column:
    """The integer that a judge answered, 0 for anything else."""
    return F.coalesce(F.when(strip(text).rlike(r"^[+-]?[0-9]+$"), strip(text).try_cast("int")), F.lit(0))
