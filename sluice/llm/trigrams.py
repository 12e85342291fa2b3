"""Boolean trigram queries that every match of a regular expression must satisfy."""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser as parser

#: A query: any one of these sets of trigrams has to occur. ANY asks for nothing.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])
MOST_STRINGS = 64
MOST_TERMS = 64


def _tidy(terms) -> Query:
    """Without the terms that another term already covers."""
    terms = set(terms)
    return frozenset(t for t in terms if not any(o < t for o in terms))


def either(a: Query, b: Query) -> Query:
    out = _tidy(a | b)
    return out if len(out) <= MOST_TERMS else ANY


def both(a: Query, b: Query) -> Query:
    out = _tidy(x | y for x in a for y in b)
    return out if len(out) <= MOST_TERMS else min(a, b, key=len)


def _of_strings(strings: set[str]) -> Query:
    """Trigrams of one of the strings, which stands whole in the text."""
    return _tidy(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """(the strings that this may match, if they are few, or None; what a match must hold)."""
    query, run, exact = ANY, {""}, True
    for kind, arg in nodes:
        strings, inner = _node(kind, arg)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        query, exact = both(query, _of_strings(run)), False
        run = {""} if strings is None else strings
        if strings is None:
            query = both(query, inner)
    if exact:
        return run, _of_strings(run)
    return None, both(query, _of_strings(run))


def _node(kind, arg) -> tuple[set[str] | None, Query]:
    if kind is op.LITERAL:
        c = chr(arg).lower()
        return ({c}, ANY) if c.isascii() else (None, ANY)
    if kind is op.IN:
        chars: set[str] = set()
        for k, a in arg:
            if k is op.LITERAL:
                chars.add(chr(a).lower())
            elif k is op.RANGE and a[1] - a[0] < MOST_STRINGS:
                chars.update(chr(c).lower() for c in range(a[0], a[1] + 1))
            else:
                return None, ANY
        return (chars, ANY) if len(chars) <= 8 and all(c.isascii() for c in chars) else (None, ANY)
    if kind is op.SUBPATTERN:
        return _walk(arg[3])
    if kind is op.BRANCH:
        found = [_walk(x) for x in arg[1]]
        if all(s is not None for s, _ in found) and sum(len(s) for s, _ in found) <= MOST_STRINGS:
            return set().union(*(s for s, _ in found)), ANY
        query = found[0][1]
        for _, q in found[1:]:
            query = either(query, q)
        return None, query
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, inner = arg
        strings, query = _walk(inner)
        if strings is not None and (low, high) == (0, 1):
            return strings | {""}, ANY
        if strings is not None and low == high and low <= 8 and len(strings) ** low <= MOST_STRINGS:
            out = {""}
            for _ in range(low):
                out = {a + b for a in out for b in strings}
            return out, ANY
        return None, query if low else ANY
    if kind is op.AT:
        return {""}, ANY
    return None, ANY


def query_of(pattern: str) -> Query:
    """The query of *pattern* over lower-cased text; ANY if no trigram is mandatory."""
    return _walk(parser.parse(pattern, re.ASCII))[1]
