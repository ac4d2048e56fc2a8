"""Licence scan: windows of a text's words compared with licence templates by the Dice coefficient of word bigrams.

DataFrame functions only; each document is judged on its own row, so nothing is shuffled. Words are runs of letters and
digits in lower case, so line breaks and comment marks do not matter. A template of w words is compared with windows of w
words, begun at every sixteenth of w (the last window ends with the text; a shorter text is one window). Two lossless size
bounds come first: a window must hold b*t/(2-t) to b*(2-t)/t distinct bigrams for a template of b, and to reach the
threshold t it must share at least t*(b + its least size)/2 of them, so a document that shares fewer with the template as
a whole is not cut into windows at all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_or_empty
from .license_texts import TEMPLATES

THRESHOLD = 0.8
STEPS = 16


def normal_words(text: str) -> list[str]:
    out, word = [], ""
    for ch in text.lower() + " ":
        if ch.isalnum():
            word += ch
        elif word:
            out.append(word)
            word = ""
    return out


def bigrams(text: str) -> list[str]:
    w = normal_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def size_bounds(b: int, t: float) -> tuple[int, int]:
    return math.ceil(b * t / (2 - t) - 1e-9), math.floor(b * (2 - t) / t + 1e-9)


def least_shared(b: int, t: float) -> int:
    """Bigrams that a window must share with a template of b to reach t."""
    return math.ceil(t * (b + size_bounds(b, t)[0]) / 2 - 1e-9)


def normalised(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def word_pairs(norm: Column) -> Column:
    """Bigrams in the order of the text."""
    pairs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
    return let(F.split(norm, " "), lambda w: F.when(F.size(w) >= 2, pairs(w)).otherwise(F.array().cast("array<string>")))


def best_window(pairs: Column, n_words: int, own: list[str], threshold: float) -> Column:
    """Struct (neg_dice, start, name to come) of the best window for a template, null if none reaches the threshold."""
    last = F.greatest(F.size(pairs) + 1 - n_words, F.lit(0))
    step = max(1, n_words // STEPS)
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))
    low, high = size_bounds(len(own), threshold)
    template = F.array(*map(F.lit, own))

    def dice(s: Column) -> Column:
        def of(g: Column) -> Column:
            value = 2.0 * F.size(F.array_intersect(g, template)) / (F.size(g) + len(own))
            return F.when(F.size(g).between(low, high) & (value >= threshold), F.struct((-value).alias("neg_dice"), (s + 1).alias("word_no")))

        return let(F.array_distinct(F.slice(pairs, s + 1, n_words - 1)), of)

    return F.array_min(F.transform(starts, dice))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """doc_id, n_hits (templates found) and the best hit of each document: license_id, template, word_no (first word of the
    window, from 1), dice.

    Ties go to the earlier window, then to the smaller template name. No hit, a null or an empty text: n_hits 0 and nulls.
    Repeated rows are each returned; an empty table stays empty; other columns are dropped. A template needs two words.
    """
    templates = TEMPLATES if templates is None else templates
    grams = {k: bigrams(v) for k, v in sorted(templates.items()) if bigrams(v)}
    every = F.array(*map(F.lit, sorted({g for own in grams.values() for g in own}))).cast("array<string>")

    def named(template: str):
        return lambda b: F.when(b.isNotNull(), F.struct(b["neg_dice"].alias("neg_dice"), b["word_no"].alias("word_no"), F.lit(template).alias("template")))

    def hits(p: Column) -> Column:
        def shared(s: Column) -> Column:
            each = []
            for name, own in grams.items():
                enough = F.size(F.array_intersect(s, F.array(*map(F.lit, own)))) >= least_shared(len(own), threshold)
                best = F.when(enough, best_window(p, len(normal_words(templates[name])), own, threshold))
                each.append(let(best, named(name)))
            return F.array_compact(F.array(*each))

        none = F.array().cast("array<struct<neg_dice:double,word_no:int,template:string>>")
        if not grams:
            return none
        least = min(least_shared(len(own), threshold) for own in grams.values())
        return let(F.array_intersect(p, every), lambda s: F.when(F.size(s) >= least, shared(s)).otherwise(none))

    found = docs.select("doc_id", let(word_pairs(normalised(text_or_empty(F.col(text)))), hits).alias("_hits"))
    best = F.array_min("_hits")
    return found.select(
        "doc_id", F.size("_hits").cast("long").alias("n_hits"), F.substring_index(best["template"], "/", 1).alias("license_id"),
        best["template"].alias("template"), best["word_no"].cast("long").alias("word_no"), F.round(-best["neg_dice"], 6).alias("dice"),
    )
