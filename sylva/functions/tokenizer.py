"""The full treebank tokenizer: a kernel over Arrow batches, for what regular expressions can't say.

A word between spaces is cut from left to right. What happens at a mark depends on the characters around it and on
whether the sentence goes on.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions.text import BRACKETS

#: Characters that can end a token.
MARKS = ".?!,:;'(){}`\"#$%*@]"
#: Contractions that are tokens after their word, and words that keep an apostrophe.
CLITICS = ("'s", "'S", "'m", "'d", "'t", "'N")
LONG_CLITICS = ("'re", "'ve", "'ll", "'em", "'n'", "'tis", "'til", "'cause")
WHOLE = ("goin'", "doin'", "lookin'", "fishin'", "A's", "O's", "R's", "Ca'", "Dell'")
PREFIXES = ("O'", "o'", "D'", "d'", "C'", "c'", "L'", "l'", "N'", "n'", "Y'", "y'")

_abbreviation = re.compile(r"(?:[A-Za-z]\.)+").fullmatch
_year = re.compile(r"'\d\ds?").fullmatch
_negation = re.compile(r"(?i)(.+?)(n't)(.*)", re.S).fullmatch


def _cut_at(word: str, following: str | None) -> int:
    """The place of the first mark at which the word is cut, or -1."""
    for i, c in enumerate(word):
        if c not in MARKS:
            continue
        after = word[i + 1 : i + 2]
        if i and c in ",.:" and after.isdigit():
            continue
        if c == ".":
            if after == "." or i and word[i - 1] == ".":
                return i
            rest_is_marks = not any(x.isalnum() for x in word[i + 1 :])
            ends = following is None or following.startswith("(")
            if i and (not rest_is_marks or _abbreviation(word[: i + 1])):
                continue
            if i and not after and not ends:
                continue
            return i
        if c == "'" and "-" in word[:i]:
            continue
        return i
    return -1


def split_word(word: str, following: str | None) -> list[str]:
    """Tokens of one word; following is the next word, None at the end of the sentence."""
    out: list[str] = []
    while word:
        if word in WHOLE or _year(word):
            return [*out, word]
        no = _negation(word)
        if no and (not no[3] or not no[3][0].isalnum()) and "'" not in no[1]:
            head = {"ca": "can", "wo": "will"}.get(no[1].lower(), no[1])
            out += [head if head == no[1] or no[1].islower() else head.capitalize(), no[2]]
            word = no[3]
            continue
        i = _cut_at(word, following)
        if i < 0:
            return [*out, word]
        if word[i] == "'" and word[: i + 1] in PREFIXES and word[i + 1 :].isalpha():
            return [*out, word]
        if i:
            out.append(word[:i])
            word = word[i:]
            continue
        n = _mark_length(word)
        token = word[:n]
        if token == '"':
            token = "``" if any(x.isalnum() for x in word[1:]) else "''"
        out.append(token)
        word = word[n:]
    return out


def _mark_length(word: str) -> int:
    """Characters of the token at a word's leading mark."""
    if word[0] == "'":
        low = word.lower()
        for clitic in LONG_CLITICS:
            if low.startswith(clitic) and not word[len(clitic) : len(clitic) + 1].isalpha():
                return len(clitic)
        if word[:2] in CLITICS and not word[2:3].isalpha():
            return 2
    if word[0] in "(){}]":
        return 1
    n = len(word) - len(word.lstrip(word[0]))
    # a run that ends the word leaves its last character as a token of its own
    return n - 1 if n > 1 and n == len(word) and word[0] in ".?!" else n


def tokenize(sentence: str) -> list[str]:
    words = sentence.split()
    out = [t for k, w in enumerate(words) for t in split_word(w, words[k + 1] if k + 1 < len(words) else None)]
    for plain, escaped in BRACKETS:
        out = [t.replace(plain, escaped) for t in out]
    return out


def tokenize_df(df: DataFrame, column: str = "sentence", out: str = "forms") -> DataFrame:
    """df with the tokens of a column; a null sentence has none."""
    fields = [f for f in df.schema.fields if f.name != out]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{out}` array<string>"])

    def run(batches):
        for batch in batches:
            tokens = pa.array([tokenize(s or "") for s in batch.column(column).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), tokens], [*(f.name for f in fields), out])

    return df.mapInArrow(run, schema)


def form_counts(df: DataFrame, column: str = "forms") -> DataFrame:
    return df.select(F.explode(column).alias("form")).groupBy("form").agg(F.count("*").alias("n"))
