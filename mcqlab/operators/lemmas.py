"""Lemmas by detachment of noun endings, for distinct tokens and by joins.

A form's candidates are itself and, for each ending it has, the form with that ending
replaced; if the exceptions name the form, itself and what they say. Of the candidates
that the lexicon holds, the shortest is the lemma (of several, the first in that order);
without one, a form is its own lemma. Lexicon and exceptions are tables of any size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mcqlab.operators.hot import dealt_join, discard, stored

#: Endings of English plural nouns, and what stands for them in the singular.
NOUN_ENDINGS = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"))
#: Changed forms up to this number are broadcast; they take some tens of bytes each.
BROADCAST_FORMS = 100_000


@dataclass(frozen=True)
class Lexicon:
    """words (word); exceptions (form, lemma), any number of lemmas a form."""

    words: DataFrame
    exceptions: DataFrame
    endings: tuple[tuple[str, str], ...] = NOUN_ENDINGS


def detached(form: Column, endings: tuple[tuple[str, str], ...]) -> Column:
    """The forms with an ending replaced, as an array; an ending that is the whole form is none."""
    every = [F.when(form.endswith(e) & (F.length(form) > len(e)), F.concat(F.substring(form, F.lit(1), F.length(form) - len(e)), F.lit(r))) for e, r in endings]
    return F.array_compact(F.array(*every))


def lemma_table(forms: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(form, ...) without repeats -> those rows with ``lemma``."""
    own = lexicon.exceptions.groupBy(F.col("form").alias("_f")).agg(F.array_sort(F.collect_set("lemma")).alias("_named"))
    known = forms.join(own, F.col("form") == F.col("_f"), "left")
    others = F.coalesce("_named", detached(F.col("form"), lexicon.endings))
    tried = known.select("form", F.posexplode(F.concat(F.array("form"), others)).alias("_at", "_c"))
    words = lexicon.words.select(F.col("word").alias("_c")).distinct()
    best = tried.join(words, "_c", "left_semi").groupBy(F.col("form").alias("_b")).agg(F.min_by("_c", F.struct(F.length("_c"), "_at")).alias("_l"))
    return forms.join(best, F.col("form") == F.col("_b"), "left").select(*forms.columns, F.coalesce("_l", "form").alias("lemma"))


def changes(rows: DataFrame, key: str, tokens: str, lexicon: Lexicon, broadcast_forms: int = BROADCAST_FORMS) -> DataFrame:
    """rows (key, tokens) -> a stored table (key, _changed): a map from form to lemma of those of the key's forms that differ from their lemma; no row for a key without such a form.

    A key may have several rows; its map is that of all of them.

    The lemmas of distinct forms are found first. If few of them differ from their form,
    these are broadcast, so that of all forms only the changed ones are shuffled; else
    both sides are joined, frequent forms apart.
    """
    own = rows.select(key, F.explode(F.array_distinct(tokens)).alias("form"))
    table = stored(lemma_table(own.groupBy("form").agg(F.count("*").alias("_uses")), lexicon).where("lemma <> form"))
    if table.count() <= broadcast_forms:
        met = own.join(F.broadcast(table.drop("_uses")), "form")
    else:
        met = dealt_join(own, table, ["form"], "_uses")
    out = stored(met.groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("form", "lemma"))).alias("_changed")))
    discard(table)
    return out


def replaced(tokens: Column, changed: Column) -> Column:
    """tokens with the lemmas of a map in the place of their forms; null for null."""
    return F.when(changed.isNull(), tokens).otherwise(F.transform(tokens, lambda w: F.coalesce(F.try_element_at(changed, w), w)))


def lemmatized(rows: DataFrame, key: str, tokens: str, lexicon: Lexicon, broadcast_forms: int = BROADCAST_FORMS) -> DataFrame:
    """rows (key, tokens), keys without repeats -> (key, tokens) with lemmas in the place of the forms, null for null.

    Tokens stay in their rows; only forms that change are taken out.
    """
    changed = changes(rows, key, tokens, lexicon, broadcast_forms)
    return rows.select(key, tokens).join(changed, key, "left").select(key, replaced(F.col(tokens), F.col("_changed")).alias(tokens))
