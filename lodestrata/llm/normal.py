"""Words of a text as they compare across spellings: case, accents, punctuation, markup, line breaks and invisible characters gone.

Markup has no length limit: every pattern is bounded by its own delimiters and takes what it read without going back, so
that the time stays linear in the text. Null and empty texts have no words.
"""

from __future__ import annotations

import html
import re
import unicodedata

import regex

_INVISIBLE = regex.compile(r"[\p{M}\p{Cf}]+")
# a tag: its name, then attributes that may have a quoted value of any content or a bare one
_TAG = re.compile(r"""</?+([a-z][a-z0-9:-]*+)(?:\s++[^\s<>="'/]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s<>"']++))?+)*+\s*+/?+>""", re.I)
_ADDRESS = re.compile(r"<[a-z][a-z0-9+.-]*+:[^\s<>]*+>", re.I)
_INLINE = frozenset("b i u s a em strong span mark code sub sup small font kbd del ins q".split())
_FOOTNOTE = re.compile(r"\[\^[^\[\]\s]++\]")
_ALIASED = re.compile(r"\[\[[^\[\]|\n]*+\|([^\[\]\n]*+)\]\]")
_LINK = re.compile(r"\[([^\[\]]*+)\]\((?:<[^<>\n]*+>|(?:[^()\s]|\([^()\s]*+\))*+)(?:\s++(?:\"[^\"]*+\"|'[^']*+'))?+\s*+\)")
_LONG_NUMBER = re.compile(r"&#([0-9]{9,}+)")
_MARKS = re.compile(r"[*_`~=]+")
_BROKEN = re.compile(r"(?<=\w)[-‐][^\S\r\n]*+[\r\n][\s>|]*+(?=\w)")
_HYPHEN = re.compile(r"(?<=\w)[-‐](?=\w)")
_WORD = re.compile(r"[^\W_]+")


def _shorter(m: re.Match) -> str:
    """Numbers of that many digits are no character; html.unescape fails on thousands of them."""
    digits = m[1].lstrip("0")
    return f"&#{digits or 0}" if len(digits) < 8 else "&#99999999"


def _without_comments(text: str) -> str:
    out, at = [], 0
    while (start := text.find("<!--", at)) >= 0 and (end := text.find("-->", start + 4)) >= 0:
        out += (text[at:start], " ")
        at = end + 3
    return "".join((*out, text[at:]))


def _tag(m: re.Match) -> str:
    """Inline tags may stand within a word, others part words."""
    return "" if m[1].lower() in _INLINE else " "


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if "&" in text:
        text = html.unescape(_LONG_NUMBER.sub(_shorter, text))
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKD", text))
    if "[" in text:
        text = _LINK.sub(r"\1", _ALIASED.sub(r"\1", _FOOTNOTE.sub("", text)))
    if "<" in text:
        text = _ADDRESS.sub(" ", _TAG.sub(_tag, _without_comments(text) if "<!--" in text else text))
    text = _HYPHEN.sub("", _BROKEN.sub("", _MARKS.sub("", text)))
    return _WORD.findall(text.casefold())
