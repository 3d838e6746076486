"""Basic (pre-)tokenisation as column expressions.

BERT-style: drop control characters and U+FFFD, turn whitespace into blanks,
keep the special tokens of the encoder whole, optionally lower-case and strip
accents, then split on whitespace and around every punctuation character
(Unicode P* plus the ASCII symbols $+<=>^`|~).
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadmill.functions import patterns as P

# other-category characters except tab, newline and carriage return, and the replacement character
CONTROL_CLASS = r"[[\p{C}\x{FFFD}]&&[^\t\n\r]]"
SPACE_CLASS = r"[\t\n\r\p{Z}]"
PUNCT = r"\p{P}$+<=>^`|~"
MARK_CLASS = r"\p{Mn}"
CJK_CLASS = r"([\x{3400}-\x{2FA1F}&&[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}]])"
# The five specials that the tokenizer itself knows. While a text is lower-cased
# and split, each is one private-use character: the control step has removed
# all such characters of the text before.
WHOLE = P.SPECIAL_TOKENS[:5]
HOLDERS = [chr(0xE000 + i) for i in range(len(WHOLE))]
HOLDER_CLASS = "\\x{E000}-\\x{%X}" % (0xE000 + len(WHOLE) - 1)
TOKEN_PATTERN = "[" + HOLDER_CLASS + r"]|[^\s" + PUNCT + HOLDER_CLASS + "]+|[" + PUNCT + "]"

# Characters that no step takes away, puts a blank around or holds: blanks, ASCII, Latin letters and signs without the
# no-break blank, the soft hyphen and the dotted capital I (which lower case turns into a letter and a mark), and general
# punctuation marks. Single characters, each one listed: Java tests those by a bit, ranges and categories one after the other.
SIMPLE_BLANKS = [9, 10, 13, 32]
SIMPLE_MARKS = [c for c in range(0x21, 0x7F) if not chr(c).isalnum()] + [0xA1, 0xA7, 0xAB, 0xB6, 0xB7, 0xBB, 0xBF]
SIMPLE_LETTERS = [c for c in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)] if c not in SIMPLE_MARKS]


def _listed(codes) -> str:
    return "".join(f"\\x{{{c:X}}}" for c in codes)


MARKS = _listed(SIMPLE_MARKS) + r"\x{2010}-\x{2027}"
LETTERS = _listed(SIMPLE_LETTERS) + r"\x{100}-\x{12F}\x{131}-\x{17F}"
SIMPLE_TEXT = rf"\A[{_listed(SIMPLE_BLANKS)}{MARKS}{LETTERS}]*+\z"
SIMPLE_PATTERN = f"[{LETTERS}]+|[{MARKS}]"
SPECIAL_PATTERN = r"\[(?:" + "|".join(w[1:-1] for w in WHOLE) + r")\]"


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """Letters that fall apart into one letter and marks, of all scripts, by
    rule. (A Hangul syllable falls apart into several letters and stays.)"""
    src, dst = [], []
    for cp in range(0xA0, sys.maxunicode + 1):
        ch = chr(cp)
        if unicodedata.decomposition(ch) and not unicodedata.decomposition(ch).startswith("<"):
            bare = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
            if len(bare) == 1 and bare != ch:
                src.append(ch)
                dst.append(bare)
    return "".join(src), "".join(dst)


def normalize_text(text: Column, lower: bool = True, strip_accents: bool = True, cjk: bool = False) -> Column:
    """The text in one line of blanks; specials are held by their characters."""
    t = F.regexp_replace(text, CONTROL_CLASS, "")
    t = F.regexp_replace(t, SPACE_CLASS, " ")
    for token, holder in zip(WHOLE, HOLDERS):
        t = F.replace(t, F.lit(token), F.lit(holder))
    if cjk:
        t = F.regexp_replace(t, CJK_CLASS, " $1 ")
    if lower:
        t = F.lower(t)
    if strip_accents:
        src, dst = accent_table()
        t = F.regexp_replace(F.translate(t, src, dst), MARK_CLASS, "")
    return t


def is_simple(text: Column) -> Column:
    """Whether a text has only simple characters and no special."""
    special = F.contains(text, F.lit("[")) & F.rlike(text, F.lit(SPECIAL_PATTERN))
    return F.rlike(text, F.lit(SIMPLE_TEXT)) & ~special


def pretokenize(text: Column, lower: bool = True, strip_accents: bool = True, cjk: bool = False) -> Column:
    """Words, punctuation marks and specials of the normalised text.

    A simple text needs none of the steps but lower case and accents: its tokens are found in one pass, the same ones."""
    found = F.regexp_extract_all(normalize_text(text, lower, strip_accents, cjk), F.lit(TOKEN_PATTERN), F.lit(0))

    def back(t):
        whole = t
        for token, holder in zip(WHOLE, HOLDERS):
            whole = F.when(t == holder, token).otherwise(whole)
        return F.when(t < HOLDERS[0], t).otherwise(whole)

    return F.when(is_simple(text), F.regexp_extract_all(_plain(text, lower, strip_accents), F.lit(SIMPLE_PATTERN), F.lit(0))).otherwise(F.transform(found, back))


def _plain(text: Column, lower: bool, strip_accents: bool) -> Column:
    """A simple text in lower case, without accents."""
    plain = F.lower(text) if lower else text
    if strip_accents:
        src, dst = accent_table()
        plain = F.when(F.octet_length(text) == F.length(text), plain).otherwise(F.translate(plain, src, dst))
    return plain


def packed_tokens(text: Column, lower: bool = True, strip_accents: bool = True, cjk: bool = False) -> Column:
    """The tokens of ``pretokenize`` as one string, one blank between two. In a simple text only
    marks are set apart and runs of blanks made one, so no list of tokens is built."""
    apart = F.regexp_replace(_plain(text, lower, strip_accents), f"[{MARKS}]", " $0 ")
    packed = F.trim(F.regexp_replace(apart, r"[\t\n\r ]{2,}|[\t\n\r]", " "))
    return F.when(is_simple(text), packed).otherwise(F.array_join(pretokenize(text, lower, strip_accents, cjk), " "))


def chars(word: Column) -> Column:
    """Code points of a string."""
    return F.regexp_extract_all(word, F.lit("(?s)."), 0)
