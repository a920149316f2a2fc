"""Leaks by the rules of the operator's docstring, word by word, without its code."""

import re
import string
import unicodedata
from functools import cache

from stanzagraph.llm.decontamination import NUMBER_WORDS, UNITS

NUMBERS = {w.decode() for w in NUMBER_WORDS}
MEASURES = {w.decode() for w in UNITS}
SIGNS = "".join(set(string.punctuation) - set("$%+"))


def spelt(word):
    return "".join(c for c in word.upper().casefold() if unicodedata.category(c)[0] in "LMN")


@cache
def as_template(text):
    """(kind or word, value) of every word."""
    out, fresh = [], True
    for word in text.split():
        own = word.strip(SIGNS)
        low = own.lower()
        if low in NUMBERS or re.fullmatch(r"[+-]?[$]?[0-9][0-9.,:/]*(%|st|nd|rd|th)?|[0-9][0-9.,]*[a-z]{1,3}", low):
            kind = 1
        elif low in MEASURES:
            kind = 2
        elif not fresh and own[:1].isupper() and not own[1:].isupper() and re.fullmatch(r"[^\W\d_]+(['-][^\W\d_]+)*", own):
            kind = 3
        else:
            kind = low
        out.append((kind, low))
        fresh = word[-1] in ".!?:" or not own
    return out


@cache
def as_plain(text, exact=False):
    out = []
    for form in filter(None, map(spelt, text.split())):
        number = form in NUMBERS or re.fullmatch(r"\d+(st|nd|rd|th|[a-z]{1,3})?", form)
        out.append((form if exact else 1 if number else 2 if form in MEASURES else form, form))
    return out


def has(doc, item, exact=False):
    width = min(5, len(item))
    enough = [q for q in range(len(item) - width + 1) if exact or sum(isinstance(k, str) for k, _ in item[q : q + width]) >= min(3, width)] if item else []
    kinds = lambda x: tuple(k for k, _ in x)
    where = {}
    for q in enough:
        where.setdefault(kinds(item[q : q + width]), []).append(q)
    pairs = [(p, q) for p in range(len(doc) - width + 1) for q in where.get(kinds(doc[p : p + width]), ())]
    for i in range(len(pairs)):
        values, places, theirs = {}, set(), set()
        for p, q in pairs[i:]:
            if p - pairs[i][0] > 1.25 * len(item):
                break
            places.add(q)
            theirs.add(p)
            if any(isinstance(item[q + k][0], int) and values.setdefault(item[q + k][1], doc[p + k][1]) != doc[p + k][1] for k in range(width)):
                break
            if min(len(places), len(theirs)) >= 0.8 * len(enough):
                return True
    return False


def leaks(doc, item):
    doc, item = doc or "", item or ""
    apart = "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in item)
    if has(as_template(doc), as_template(item)):
        return True
    for form in (item, apart):
        own = as_plain(form)
        if has(as_plain(doc), own):
            return True
        width = min(5, len(own))
        words = [isinstance(k, str) for k, _ in own]
        few = len(own) >= 3 if not any(words) else min(sum(words[q : q + width]) for q in range(len(own) - width + 1)) < min(3, width)
        if own and few and has(as_plain(doc, True), as_plain(form, True), True):
            return True
    return False
