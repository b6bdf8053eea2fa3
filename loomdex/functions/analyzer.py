"""Tokens, positions, bigrams and stems as columns."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdex.config import CRAWL_STOP_WORDS, DEFAULT, STOP_WORDS, Config
from loomdex.functions.stemmer import stem as _stem
from loomdex.runtime import arrow_udf, flat_udf

#: Contractions that tokens are expanded by; others are cut at the apostrophe.
CONTRACTIONS = {f"{w}n't": f"{w} not" for w in "are could did do does had has have is must need should was were would".split()}
CONTRACTIONS |= {"can't": "cannot", "won't": "will not", "shan't": "shall not", "let's": "let us", "i'm": "i am"}
CONTRACTIONS |= {f"{w}'{a}": f"{w} {b}" for w in "i you he she it we they".split() for a, b in (("ll", "will"), ("d", "would"))}
CONTRACTIONS |= {f"{w}'{a}": f"{w} {b}" for w in "i you we they".split() for a, b in (("ve", "have"), ("re", "are"))}
CONTRACTIONS |= {f"{w}'s": f"{w} is" for w in "he she it that what who where there here how when why".split()}


def tokens(text: Column, config: Config = DEFAULT) -> Column:
    """Runs of a-z, 0-9 and ' of the lower-cased text; contractions expanded, then cut at apostrophes. Texts without ' take a shorter way."""
    plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    short = F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9']+)"), F.lit(1))
    if config.contractions:
        table = F.create_map(*[F.lit(x) for kv in CONTRACTIONS.items() for x in kv])
        found = F.transform(found, lambda t: F.when(F.contains(t, F.lit("'")), F.coalesce(F.try_element_at(table, t), t)).otherwise(t))
    return F.when(F.contains(text, F.lit("'")), F.filter(F.split(F.array_join(found, " "), "[ ']"), lambda t: t != "")).otherwise(short)


def bigrams(words: Column) -> Column:
    """Neighbouring pairs, space-joined."""
    n = F.size(words)
    return F.when(n > 1, F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


@flat_udf("array<int>")
def positions(words: pa.Array) -> pa.Array:
    """Each token's character offset in the space-joined text."""
    from loomdex.functions import tally

    return tally.offsets(words)


@arrow_udf("array<string>")
def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else [_stem(x) for x in w])


@arrow_udf("string")
def stem_word(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else _stem(w))


def stems(words: Column, config: Config = DEFAULT) -> Column:
    """Stems of a token array; workers remember stems, so each word is stemmed about once."""
    return _stems(words) if config.stem else words


def drop_stop_words(words: Column, config: Config = DEFAULT) -> Column:
    return F.filter(words, lambda t: ~t.isin(*STOP_WORDS) & (F.length(t) >= config.min_length))


def drop_stop_bigrams(pairs: Column) -> Column:
    """Pairs neither of whose tokens is a stop word."""
    return F.filter(pairs, lambda p: ~F.substring_index(p, " ", 1).isin(*STOP_WORDS) & ~F.substring_index(p, " ", -1).isin(*STOP_WORDS))


def query_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def all_stop_words(words: Column) -> Column:
    """Whether every raw word, case-sensitively, is a stop word; true of no words."""
    return F.forall(words, lambda w: w.isin(*STOP_WORDS))


def crawl_tokens(text: Column) -> Column:
    """Tokens of the crawl reports: letters, ' and -, two or more, without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z'-]{2,}"), F.lit(0)), lambda t: ~t.isin(*CRAWL_STOP_WORDS))


def split_words(words: Column, n: Column, k: Column) -> Column:
    """Part k of n contiguous parts, the first size % n of them one longer."""
    size = F.size(words)
    base, more = F.floor(size / n).cast("int"), size % n
    return F.slice(words, k * base + F.least(k, more) + 1, base + F.when(k < more, 1).otherwise(0))
