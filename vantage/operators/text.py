"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and their plain forms, position by position, then ligatures.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
LIGATURES = {"œ": "oe", "æ": "ae", "ß": "ss", "ﬁ": "fi", "ﬂ": "fl"}
QUOTES, DASHES = "‘’‚‛´`“”„«»", "–—−‐‑"
# Words without content.
STOPWORDS = "le la les un une des de du et ou a au aux en dans sur par pour avec ce cette ces il elle est son sa".split()
# Words that mark a language.
MARKERS = {"fr": "le la les des est dans pour une que qui", "en": "the and of to in is that for was with"}
# Stems of verbs and nouns of combat.
BATTLE = "fight battle attack strike duel combat defeat war kill blade army siege clash".split()

WORDS = r"[^\p{L}\p{N}]+"


def unaccent(c: Column) -> Column:
    c = F.translate(c, MARKED, PLAIN)
    for a, b in LIGATURES.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def normalise(c: Column) -> Column:
    """Lower case, plain quotes and dashes, no marks on Latin letters, single blanks, trimmed."""
    c = F.translate(F.lower(c), QUOTES + DASHES, "''''''" + '"""""' + "-----")
    return F.trim(F.regexp_replace(unaccent(c), r"\s+", " "))


def name_key(c: Column) -> Column:
    """Letters and digits alone."""
    return F.regexp_replace(normalise(c), r"[^\p{L}\p{N}]", "")


def tokens(c: Column) -> Column:
    return F.filter(F.split(normalise(c), WORDS), lambda w: F.length(w) > 0)


def signature(c: Column) -> Column:
    """Sorted tokens, joined: equal for the same words in any order."""
    return F.array_join(F.array_sort(tokens(c)), " ")


def word_pad(c: Column) -> Column:
    """`` words `` between blanks, so that ``contains`` matches whole words."""
    return F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" "))


def content_tokens(c: Column) -> Column:
    """Distinct tokens of more than one character that are no stopwords."""
    return F.array_except(F.filter(tokens(c), lambda w: F.length(w) > 1), F.array(*map(F.lit, STOPWORDS)))


def capitalised(c: Column) -> Column:
    """Distinct words that begin with a capital, normalised, of more than one character: the names of a sentence, near enough."""
    first = lambda w: F.substring(w, 1, 1)
    big = F.filter(F.split(c, WORDS), lambda w: first(w) != F.lower(first(w)))
    return F.array_distinct(F.filter(F.transform(big, normalise), lambda w: F.length(w) > 1))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all, of two sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    """Shared over the smaller set; 0 if either is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def _grams(c: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, 3))


def trigrams_padded(c: Column) -> Column:
    """Distinct trigrams of the whole string between two blanks before and one after."""
    c = F.concat(F.lit("  "), normalise(c), F.lit(" "))
    return F.array_distinct(_grams(c))


def trigrams_by_word(c: Column) -> Column:
    """Distinct trigrams of each word by itself, padded."""
    return F.array_distinct(F.flatten(F.transform(tokens(c), lambda w: _grams(F.concat(F.lit("  "), w, F.lit(" "))))))


def dice(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 0.0).otherwise(2 * F.size(F.array_intersect(a, b)) / total)


def contains_all(c: Column, fragments: list[str]) -> Column:
    out = F.lit(True)
    for f in fragments:
        out = out & F.contains(c, F.lit(f))
    return out


def whole_word(c: Column, word: str) -> Column:
    """The word occurs with no letter or digit on either side."""
    return c.rlike(rf"(?<![\p{{L}}\p{{N}}])\Q{word}\E(?![\p{{L}}\p{{N}}])")


def marker_count(c: Column, lang: str) -> Column:
    return F.size(F.filter(F.split(F.lower(c), WORDS), lambda w: w.isin(MARKERS[lang].split())))


def detect_language(c: Column, sure: int = 8, ratio: float = 1.5) -> Column:
    """``fr`` or ``en`` where one's markers number ``sure`` at least and ``ratio`` times the other's, else null."""
    fr, en = marker_count(c, "fr"), marker_count(c, "en")
    return F.when((fr >= sure) & (fr >= ratio * en), "fr").when((en >= sure) & (en >= ratio * fr), "en")


def is_battle(c: Column) -> Column:
    return normalise(c).rlike("|".join(BATTLE))
