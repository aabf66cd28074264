"""Encyclopedia markup to plain text, and the words of a text."""

from __future__ import annotations

import html
import re
import unicodedata

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_REFERENCE = re.compile(r"<ref\b[^<>]*?/\s*>|<ref\b[^<>]*>.*?</ref\s*>", re.S | re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,300}>")
_BRACES = re.compile(r"\{\{|\}\}")
_NAMESPACE_LINK = re.compile(r"\[\[[^\[\]|:\n]{1,30}:[^\[\]]*\]\]")
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]")
_OUTSIDE_LINK = re.compile(r"\[(?:https?:)?//[^\s\[\]]+ ?([^\[\]]*)\]|https?://\S+")
_MAGIC = re.compile(r"__[A-Z]{3,}__")
_TABLE = re.compile(r"^\{\|.*?^\|\}", re.S | re.M)
_TABLE_LINE = re.compile(r"^(?:\{\|.*|\|-.*|\|\}|[|!](?:[^|\n\[\]{}]{0,60}=[^|\n]{0,60}\|(?!\|))?)|\|\||!!", re.M)
_HEADING = re.compile(r"^=+[^=\n]*=+[ \t]*$", re.M)
_QUOTES = re.compile(r"'{2,}")
_HIDDEN = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
_WORD = re.compile(r"\w+")
_SPACES = re.compile(r"[^\S\n]")


def without_templates(text: str) -> str:
    """Drop balanced {{…}}; what is never closed stays. Linear in the text."""
    if "{{" not in text:
        return text
    stack, spans = [], []
    for mark in _BRACES.finditer(text):
        if mark.group() == "{{":
            stack.append(mark.start())
        elif stack:
            start = stack.pop()
            while spans and spans[-1][0] > start:
                spans.pop()
            spans.append((start, mark.end()))
    out, done = [], 0
    for start, end in spans:
        out.append(text[done:start])
        done = end
    out.append(text[done:])
    return "".join(out)


def plain(text: str, tables: bool = True) -> str:
    """The text without markup; with ``tables``, the words of cells stay.

    Characters are brought to one form: entities are resolved, invisible ones
    dropped, compatible and composed forms made one.
    """
    if "<" in text:
        if "<!--" in text:
            text = _COMMENT.sub(" ", text)
        text = _TAG.sub(" ", _REFERENCE.sub(" ", text))
    text = without_templates(text)
    if "[" in text:
        if "[[" in text:
            text = _LINK.sub(r"\1", _NAMESPACE_LINK.sub(" ", text))
        if "//" in text:
            text = _OUTSIDE_LINK.sub(r"\1", text)
    if "&" in text:
        text = html.unescape(text)
    if "{|" in text or "\n|" in text:
        text = _TABLE_LINE.sub(" ", text) if tables else _TABLE.sub("\n", text)
    if "==" in text:
        text = _HEADING.sub("\n", text)
    if "''" in text:
        text = _QUOTES.sub("", text)
    if "__" in text:
        text = _MAGIC.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
    return text


def words(text: str) -> list[str]:
    """Words regardless of case, punctuation and spacing."""
    return _WORD.findall(plain(text).casefold())
