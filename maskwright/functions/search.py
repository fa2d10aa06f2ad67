"""Prefix search: a raw query is a conjunction of terms; a term is a phrase whose last token is a prefix.

Query and text are folded by one rule: lower case, Latin letters with one mark to the letter, those marks dropped where
they stand alone, a few letter variants to their usual form. Other letters stay as they are, composed or not.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Variants of letters and what they fold to.
_VARIANTS = dict(zip("µſςϐϑϕϖϰϱϵ", "μsσβθφπκρε", strict=True))


def _marked_letters() -> tuple[dict[str, str], str]:
    """(lower-case Latin letters that are a plain letter with one mark, the marks themselves)."""
    letters, marks = {}, set()
    for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) == 2 and parts[0].isascii() and parts[0].isalpha():
            marks.add(parts[1])
            if c == c.lower():
                letters[c] = parts[0]
    return letters, "".join(sorted(marks))


_LETTERS, _MARKS = _marked_letters()
_FOLDS = _LETTERS | _VARIANTS
_TABLE = str.maketrans(_FOLDS | dict.fromkeys(_MARKS, ""))


def fold(text: str) -> str:
    return text.lower().translate(_TABLE)


def folded(text: Column) -> Column:
    """The same of a column."""
    return F.translate(F.lower(text), "".join(_FOLDS) + _MARKS, "".join(_FOLDS.values()))


def _tokens(text: str) -> list[str]:
    """Runs of letters, numbers and private-use characters."""
    kinds = ((c, unicodedata.category(c)) for c in text)
    return "".join(c if k[0] in "LN" or k == "Co" else " " for c, k in kinds).split()


def _words(raw: str) -> list[str]:
    return [w for w in re.sub(r'["*^:()]', " ", raw).split(" ") if w.strip()]


def expression(raw: str) -> str:
    """The query as a full-text expression: operators become blanks, each word a quoted prefix, all joined by AND."""
    return " AND ".join(f'"{w}"*' for w in _words(raw))


def parse_query(raw: str) -> list[list[str]]:
    """Tokens of each term; a term without tokens is an empty list, which nothing matches."""
    return [_tokens(fold(w)) for w in _words(raw)]


def matches(text: Column, terms: list[list[str]]) -> Column:
    """Whether every term occurs: its tokens side by side, the last as a prefix. No terms match nothing."""
    if not terms or any(not t for t in terms):
        return F.lit(False)
    # tokens joined by one blank, with one at either end, turn a phrase with a prefix into a substring
    tokens = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0)), " "))
    found = F.lit(True)
    for t in terms:
        found = found & tokens.contains(" " + " ".join(t))
    return F.coalesce(found, F.lit(False))
