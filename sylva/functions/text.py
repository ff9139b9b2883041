"""Scalar functions on sentences and tokens, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bracket escapes of treebank text.
BRACKETS = (("(", "-LRB-"), (")", "-RRB-"), ("[", "-LSB-"), ("]", "-RSB-"), ("{", "-LCB-"), ("}", "-RCB-"))

#: Lower bounds of the count buckets 1 to 14.
BUCKETS = (0.0, 0.003, 0.01, 0.033, 0.09, 0.33, 1.01, 2.01, 5.1, 12.0, 30.0, 80.0, 200.0, 600.0)


def escape_brackets(text: Column) -> Column:
    for plain, escaped in BRACKETS:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape_brackets(text: Column) -> Column:
    for plain, escaped in BRACKETS:
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def split_punctuation(text: Column) -> Column:
    """Tokens by white space, punctuation marks and brackets apart (the built-in fast path)."""
    spaced = F.trim(F.regexp_replace(text, "([.,!?;:()])", " $1 "))
    return F.array_remove(F.split(spaced, " +"), "")


def capital_class(form: Column) -> Column:
    """0 none, 1 first letter only, 2 all letters, for words of two characters or more; else 0."""
    first = F.substring(form, 1, 1)
    lowered, raised = F.lower(form), F.upper(form)
    return F.when(F.length(form) < 2, 0).when((form == raised) & (form != lowered), 2).when(first != F.lower(first), 1).otherwise(0)


def suffix2(form: Column) -> Column:
    """The last two characters of a lowered word of three or more, else null."""
    return F.when(F.length(form) >= 3, F.lower(F.substring(form, -2, 2)))


def quantize(n: Column) -> Column:
    """0, 1, 2; 3 and 4 are 4; more is 5."""
    return F.when(n <= 2, n).when(n <= 4, F.lit(4)).otherwise(F.lit(5)).cast("int")


def bucket(v: Column) -> Column:
    """How many of the bounds lie under v."""
    out = F.lit(0)
    for b in BUCKETS:
        out = out + F.when(v > b, 1).otherwise(0)
    return out


def term_parts(label: Column) -> tuple[Column, Column]:
    """A node label's category and its suffix: from the first of - = | that is not at its start."""
    return F.regexp_extract(label, "^(.[^-=|]*)", 1), F.regexp_extract(label, "^.[^-=|]*(.*)$", 1)


def parse_kv(text: Column) -> Column:
    """'k=v k2 k3=v3' as a map; a bare key has the value 1."""
    items = F.array_remove(F.split(text, "[ ,]+"), "")
    return F.map_from_entries(F.transform(items, lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)), F.when(F.instr(x, "=") > 0, F.split_part(x, F.lit("="), F.lit(2))).otherwise("1").cast("double"))))


def write_kv(values: Column) -> Column:
    """A map of numbers in key order; value 1 is left out."""
    entries = F.array_sort(F.map_entries(values))
    return F.array_join(F.transform(entries, lambda e: F.when(e["value"] == 1, e["key"].cast("string")).otherwise(F.concat_ws("=", e["key"].cast("string"), F.regexp_replace(e["value"].cast("string"), "[.]0$", "")))), ", ")


#: Abbreviations that keep their full stop.
ABBREVIATIONS = (
    "Ala. Ca. Calif. Conn. Fla. Ga. Ill. Ky. La. Mass. Me. Md. Mich. Mo. Pa. Va. Vt. Wash. Wyo. W.Va. Co. co. Ltd. Cos. cos. Corp. Inc. INC. CORP. Jr. Sr. Blvd. St. Ave."
).split()

#: verbs' tags, auxiliary words (upper case) and their contracted forms.
VERB_TAGS = "VB VBD VBG VBN VBP VBZ".split()
AUXILIARY_ENDINGS = "'VE 'M 'LL 'D 'S 'RE".split()
AUXILIARY_GERUNDS = "BEIN HAVING BEING".split()
AUXILIARIES = (
    "MAHT SHULD WILL WAS OUGHTA AHM NEED MAYE WILLYA WHADDYA HATH HAVE WERE IS HAS MUST DID HAD DO MIGHT WOULD SHALL SHOULD OUGHT COULD DOES HAFTA BE KIN CAN ART BEEN DONE ARE DOO MAY AM"
).split()

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column, language: str = "En") -> Column:
    """A to Z lowered and nothing else; Arabic (transliterated, where case tells letters apart) stays."""
    return text if language == "Ar" else F.translate(text, _UPPER, _LOWER)


def keeps_stop(form: Column) -> Column:
    """Whether a word's full stop belongs to it: letters and stops in turn, the last letter not s, or a known abbreviation."""
    return (F.length(form) > 3) & form.rlike(r"[A-Za-z][.][A-Za-rt-z][.]$") | form.isin(*ABBREVIATIONS)


def is_final(form: Column, finals: list[str]) -> Column:
    """Whether a word ends sentences: it is among the words that training saw as full stops or colons."""
    return form.isin(*finals)


def effective_end(form: Column, pos: Column, n: Column, after: Column, finals: list[str], last: Column) -> Column:
    """Whether a constituent that stops before this word may end the sentence: 1 at the place `last`, before a final word,
    and before a comma with a closing quote after it (three words or more before the end); else 0."""
    quoted = (form == ",") & (after == "''") & (pos <= n - 3)
    return F.when(pos > last, 0).when(pos == last, 1).when(is_final(form, finals) | F.coalesce(quoted, F.lit(False)), 1).otherwise(0)


def counted_capital(form: Column, pos: Column, before: Column) -> Column:
    """capital_class, but 0 for the first word and for the second after an opening quote or bracket."""
    skipped = (pos == 0) | ((pos == 1) & F.coalesce(before.isin("``", "-LCB-", "-LRB-"), F.lit(False)))
    return F.when(skipped, 0).otherwise(capital_class(form))


def log_bucket(v: Column, factor: float) -> Column:
    """1 more than the whole part of factor * ln v, from 0 to 14."""
    return F.when(v > 0, F.least(F.lit(14), (F.lit(float(factor)) * F.log(v)).cast("int") + 1)).otherwise(0)


def size_bin(n: Column) -> Column:
    """The bin of a constituent's width: up to 1, 3, 6, 10, 15, 21, 28, 36 words, or more."""
    out = F.lit(0)
    for b in (1, 3, 6, 10, 15, 21, 28, 36):
        out = out + (n > b).cast("int")
    return out


def label_number(label: Column) -> Column:
    """The number after ^ in a label, or null."""
    return F.nullif(F.regexp_extract(label, r"\^(\d+)$", 1), F.lit("")).cast("int")


def auxiliary_tag(form: Column, tag: Column) -> Column:
    """AUX for a verb's tag on an auxiliary or its contraction, AUXG on its gerund; other tags stay."""
    word = F.upper(form)
    is_aux = word.isin(*AUXILIARIES) | F.regexp_extract(word, "('.*)$", 1).isin(*AUXILIARY_ENDINGS)
    return F.when(tag.isin(*VERB_TAGS) & word.isin(*AUXILIARY_GERUNDS), "AUXG").when(tag.isin(*VERB_TAGS) & is_aux, "AUX").otherwise(tag)


def tree_words(tree: Column) -> Column:
    """The words of a bracketed text, from left to right, without empty ones (under -NONE-)."""
    return F.regexp_extract_all(tree, F.lit(r"\((?!-NONE- )[^\s()]+ +([^\s()]+)\)"), F.lit(1))


def reserved(form: Column) -> Column:
    """A word that the model uses itself (^^) as another one (^^^)."""
    return F.when(form == "^^", "^^^").otherwise(form)



def escaped_tokens(forms: Column) -> Column:
    """The tokens of a sentence that is already cut, brackets escaped."""
    return F.transform(forms, escape_brackets)
