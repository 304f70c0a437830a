"""Labels and keys of fields, and the words of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import RESERVED_KEYS

# Words of a label that say nothing about similarity.
FILLER = ("no", "num", "number", "id", "ref", "reference", "the", "of")
# Words that retrieval passes over.
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "at", "by", "with", "is", "are", "was", "were", "be", "been", "this", "that", "these", "those", "it", "as", "from", "has", "have", "had", "do", "does", "did", "but", "not", "any")


def once(value: Column, then) -> Column:
    """then(value), with the value computed once however often `then` uses it: as an item of a list of one, it can't be copied into the expression."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _pieces(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def fold_label(text: Column) -> Column:
    """Equal for labels that differ in case and punctuation only."""
    return F.array_join(_pieces(text), "_")


def fold_for_similarity(text: Column) -> Column:
    """As fold_label, in words and without filler; with it where nothing else is left."""
    words = _pieces(text)
    kept = F.filter(words, lambda w: ~F.array_contains(_strings(FILLER), w))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), " ")


def slug(text: Column) -> Column:
    """A legal key for a label, or null."""
    plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))

    def legal(key: Column) -> Column:
        numbered = F.substring(key, 1, 1).between("0", "9")
        reserved = F.when(key.isin(*RESERVED_KEYS), F.concat(key, F.lit("_value"))).otherwise(key)
        cut = F.rtrim(F.substring(F.when(numbered, F.concat(F.lit("f_"), key)).otherwise(reserved), 1, 47), F.lit("_"))
        return F.when(key != "", cut)

    return once(plain, legal)


def lexical_tokens(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: ~w.isin(*STOP_WORDS))


def fold_token(text: Column) -> Column:
    """A word of a page or quote for comparison: no currency signs, thousands commas or edge punctuation."""
    t = F.regexp_replace(F.lower(text), "[$€£¥₹₩]", "")
    t = F.regexp_replace(t, r"(?<=\d),(?=\d{3}\b)", "")
    return F.trim(F.regexp_replace(t, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_%]+$", ""))


def fold_text(text: Column) -> Column:
    """A text of words, parted by blanks, with each word as of fold_token and without those of which nothing is left; four passes for all words, not four a word.

    Patterns begin with what few letters are. Marks go that begin a word, and those from the first of some marks on to a word's end; what is looked
    back at is one half of a letter beyond U+FFFF, so halves don't count as marks there.
    """
    t = F.regexp_replace(F.lower(text), "[$€£¥₹₩]", "")
    t = F.regexp_replace(t, r",(?<=\d,)(?=\d{3}\b)", "")
    t = F.regexp_replace(t, r"(?=[^a-z0-9\p{L}\p{N}_ ])(?:(?<![^ ])[^\p{L}\p{N}_ ]+|(?<![^\p{L}\p{N}_% \p{Cs}])[^\p{L}\p{N}_% ]++(?![^ ]))", "")
    return F.trim(F.regexp_replace(t, "  +", " "))


def excerpt(text: Column, most: int = 240) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…"))).otherwise(t)


def token_estimate(words: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(words * 4 / 3)).cast("int")


def indel_ratio(left: Column, right: Column) -> Column:
    """2 * LCS / (lengths) of two short strings, by a fold over a row of the table; 1 for two empty ones."""
    a, b = F.split(left, ""), F.split(right, "")
    zero = F.transform(F.concat(F.array(F.lit("")), b), lambda _: F.lit(0))

    def row(last: Column, x: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            return F.concat(acc, F.array(F.when(F.get(b, i - 1) == x, F.get(last, i - 1) + 1).otherwise(F.greatest(F.get(last, i), F.get(acc, i - 1)))))

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(b), F.lit(1))), F.array(F.lit(0)), step)

    total = F.length(left) + F.length(right)
    lcs = F.element_at(F.aggregate(a, zero, row), -1)
    return F.when(total == 0, 1.0).when((F.length(left) == 0) | (F.length(right) == 0), 0.0).otherwise(2.0 * lcs / total)


def label_similarity(left: Column, right: Column) -> Column:
    """Indel ratio of two labels' words in sorted order."""
    ordered = lambda c: F.array_join(F.array_sort(F.split(fold_for_similarity(c), " ")), " ")
    return indel_ratio(ordered(left), ordered(right))
