"""Character classes and word-level column functions.

Positions and lengths count code points. All of it is built-in Spark, so it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes of words, punctuation and white space.
ALNUM = r"A-Za-z0-9"
CJK = r"\x{4E00}-\x{9FFF}"
WHITE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
PUNCTUATION = r"\p{P}\p{S}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}"
BLOCK = rf"([{ALNUM}{CJK}]+|[^{ALNUM}{CJK}]+)"
LETTERS = r"([\p{L}\p{N}]+)"
INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Last characters that mark a place or a shop, so that a longer word is no noise.
PROTECTED = "市省区县店站路里院校园"

#: Grams of a long block are taken from pieces of so many starts.
PIECE = 512


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_punctuation(word: Column | str) -> Column:
    """Every character is punctuation; true of the empty string."""
    return ~_col(word).rlike(f"[^{PUNCTUATION}]")


def contains_punctuation(word: Column | str) -> Column:
    return _col(word).rlike(f"[{PUNCTUATION}]")


def has_chinese(word: Column | str) -> Column:
    """Some character is of the Han script."""
    return _col(word).rlike(r"\p{IsHan}")


def is_alnum(word: Column | str) -> Column:
    """Non-empty and of ASCII letters and digits alone."""
    return _col(word).rlike(f"^[{ALNUM}]+$") & ~_col(word).contains("\n")


def has_alnum(word: Column | str) -> Column:
    return _col(word).rlike(f"[{ALNUM}]")


def has_cjk(word: Column | str) -> Column:
    return _col(word).rlike(f"[{CJK}]")


def has_word_char(word: Column | str) -> Column:
    return _col(word).rlike(f"[{ALNUM}{CJK}]")


def trim_space(text: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(_col(text), f"^{WHITE}+|{WHITE}+$", "")


def fields(text: Column | str) -> Column:
    """Parts between runs of Unicode white space, none empty."""
    return F.filter(F.split(_col(text), f"{WHITE}+"), lambda x: x != "")


def split_blocks(text: Column | str) -> Column:
    """Runs of word characters and runs of others, in order; together they are the text."""
    return F.regexp_extract_all(_col(text), F.lit(BLOCK), F.lit(1))


def letter_blocks(text: Column | str) -> Column:
    """Runs of Unicode letters and numbers."""
    return F.regexp_extract_all(_col(text), F.lit(LETTERS), F.lit(1))


def protected_suffix(word: Column | str) -> Column:
    return F.substring(_col(word), -1, 1).isin(*PROTECTED)


def reverse_word(word: Column | str) -> Column:
    return F.reverse(_col(word))


def rest(word: Column | str) -> Column:
    """Without the first character."""
    w = _col(word)
    return F.substring(w, F.lit(2), F.char_length(w))


def stem(word: Column | str) -> Column:
    """Without the last character."""
    w = _col(word)
    return F.substring(w, F.lit(1), F.greatest(F.char_length(w) - 1, F.lit(0)))


def pieces(block: Column | str, overlap: Column | int, size: int = PIECE) -> Column:
    """The block in pieces of `size` characters and `overlap` more; one piece for short blocks."""
    b = _col(block)
    last = F.floor((F.char_length(b) - 1) / size).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(b, i * size + 1, F.lit(size) + overlap)
    )
    return F.when(F.char_length(b) <= size, F.array(b)).otherwise(cut)


def grams(piece: Column | str, longest: int, size: int = PIECE, shortest: int = 2) -> Column:
    """Substrings of `shortest` to `longest` characters that start in the first `size` of a piece."""
    p = _col(piece)
    n = F.char_length(p)
    starts = F.sequence(F.lit(1), F.least(n - (shortest - 1), F.lit(size)))
    if shortest == longest:
        every = F.transform(starts, lambda i: F.substring(p, i, F.lit(longest)))
    else:
        every = F.flatten(
            F.transform(
                starts,
                lambda i: F.transform(F.sequence(F.lit(shortest), F.least(F.lit(longest), n - i + 1)), lambda k: F.substring(p, i, k)),
            )
        )
    return F.when(n >= shortest, every).otherwise(F.array().cast("array<string>"))


def word_tags(word: Column | str) -> Column:
    """Tags B, M, E, S of a word's characters as 0, 1, 2, 3."""
    n = F.char_length(_col(word))
    inner = F.array_repeat(F.lit(1), F.greatest(n - 2, F.lit(0)))
    many = F.concat(F.array(F.lit(0)), inner, F.array(F.lit(2)))
    return F.when(n == 1, F.array(F.lit(3))).when(n > 1, many).otherwise(F.array().cast("array<int>"))


def characters(text: Column | str) -> Column:
    """The characters of a text."""
    return F.regexp_extract_all(_col(text), F.lit("(?s)."), F.lit(0))


def words_of_tags(chars: Column | str, tags: Column | str, compat_duplicate: bool = False) -> Column:
    """Words that tags cut characters into.

    B ends an open word and begins one, M goes on, E goes on and ends, S ends an open word and stands
    alone. `compat_duplicate` lists a word that S ends twice.
    """
    pairs = F.arrays_zip(_col(chars).alias("c"), _col(tags).alias("t"))
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        closed = F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        twice = F.when(acc["open"] != "", F.concat(closed, F.array(acc["open"]))).otherwise(closed)
        ended = twice if compat_duplicate else closed
        make = lambda done, open_: F.struct(done.alias("done"), open_.alias("open"))
        return (
            F.when(x["t"] == 0, make(closed, x["c"]))
            .when(x["t"] == 1, make(acc["done"], F.concat(acc["open"], x["c"])))
            .when(x["t"] == 2, make(F.concat(acc["done"], F.array(F.concat(acc["open"], x["c"]))), F.lit("")))
            .otherwise(make(F.concat(ended, F.array(x["c"])), F.lit("")))
        )

    return F.aggregate(
        pairs, state, step, lambda acc: F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
    )
