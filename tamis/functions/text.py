"""Column functions over text: tokens, entropy, n-grams, masks. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic. Fixed values.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can need must "
    "i me my we our you your he she it they them his her its this that these those what which who whom how when where why "
    "and but or nor not no so if then else for of to in on at by with from as into about up out off over under again "
    "there here all each every both few more most some any other just also than too very only even still already now well "
    "get got make made go going come take use used using like want know see look think said say tell let put set try "
    "please thanks thank yes ok okay sure 이 그 저 을 를 에 가 는 은 의 로 으로"
).split()


def text_or_empty(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def once(value: Column, f) -> Column:
    """f(value), where value is worked out once, however often f uses it. Inside a function over an array nothing is shared, so
    that what is written there again is worked out again for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def tokens(c) -> Column:
    """Lower-case words of a-z, Hangul, digits and hyphens, longer than one character, without stop words."""
    words = F.split(F.lower(text_or_empty(c)), "[^a-z가-힣0-9-]+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))  # a hash set in the plan


def bigrams(words: Column) -> Column:
    """Adjacent pairs, joined by a blank."""
    pairs = F.arrays_zip(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))).alias("a"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("b"))
    return F.transform(pairs, lambda p: F.concat(p["a"], F.lit(" "), p["b"]))


def raw_tokens(c) -> Column:
    """Everything between white space."""
    return F.filter(F.split(text_or_empty(c), "[ \\t\\n\\r\\f\\x0B]+"), lambda w: w != "")


def count_matches(c, pattern: str) -> Column:
    return F.regexp_count(text_or_empty(c), F.lit(pattern))


def mask(secret: Column) -> Column:
    """A secret with its middle starred: four characters and two stay, of short ones the first."""
    n = F.length(secret)
    short = F.concat(F.substring(secret, 1, 1), F.repeat(F.lit("*"), F.greatest(F.lit(3), n - 1)))
    return F.when(n <= 8, short).otherwise(F.concat(F.substring(secret, 1, 4), F.repeat(F.lit("*"), F.least(F.lit(12), n - 6)), F.right(secret, F.lit(2))))


def entropy_of(s: Column) -> Column:
    """Shannon entropy in bits of a short string's characters (quadratic in its length)."""
    chars = F.filter(F.split(s, ""), lambda x: x != "")
    n = F.size(chars)
    each = F.transform(F.array_distinct(chars), lambda d: F.size(F.filter(chars, lambda x: x == d)) / n)
    return F.aggregate(each, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def ascii_bounds(pattern: str) -> str:
    """A pattern whose word bounds are those of a-z, A-Z, 0-9 and the underline alone, in whichever Java it runs: before a
    letter or a group a word begins, elsewhere it ends. (One look to one side costs a third of testing for either.)"""
    parts = pattern.split("\\b")
    out = parts[0]
    for part in parts[1:]:
        begins = part[:1] == "(" or part[:1].isalnum()
        out += ("(?<![A-Za-z0-9_])" if begins else "(?![A-Za-z0-9_])") + part
    return out
