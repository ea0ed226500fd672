"""One pass over a text for all rules: an automaton of the rules' literals names the rules that can match, and only they are tried.

Each pattern is asked once which literals a match must hold (one of a set). The automaton finds the literals of all rules in
one run over the text, so a page that holds none of a rule's is never scanned for it, and a rule more costs next to nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from re import _constants as kinds
from re import _parser as parser

import ahocorasick

#: A pattern that needs one of many short strings is as good as none: such sets are passed over where a longer one exists.
MOST = 64


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """Of two sets of which a match holds one each, the one that fewer texts hold: longer strings, then fewer of them."""
    both = [s for s in (a, b) if s and len(s) <= MOST and min(map(len, s))]
    return max(both, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def _of(items) -> frozenset[str] | None:
    best, run = None, ""
    for op, arg in items:
        if op is kinds.LITERAL:
            run += chr(arg)
            continue
        best, run = _better(best, frozenset({run.lower()}) if run else None), ""
        inner = None
        if op is kinds.SUBPATTERN:
            inner = _of(arg[-1])
        elif op is kinds.BRANCH:
            each = [_of(branch) for branch in arg[1]]
            inner = frozenset().union(*each) if all(each) else None
        elif op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT) and arg[0] > 0:
            inner = _of(arg[2])
        elif op is kinds.ATOMIC_GROUP:
            inner = _of(arg)
        elif op is kinds.IN and all(kind is kinds.LITERAL for kind, _ in arg):
            inner = frozenset(chr(c).lower() for _, c in arg)
        best = _better(best, inner)
    return _better(best, frozenset({run.lower()}) if run else None)


def required(pattern: str) -> frozenset[str] | None:
    """Strings in lower case of which every match of a pattern holds one; None if there are no such strings."""
    return _of(parser.parse(pattern))


def _first(items) -> tuple[set[str], bool] | None:
    """The characters that a match may begin with, and whether it may be empty; None if they cannot be told."""
    chars: set[str] = set()
    for op, arg in items:
        if op in (kinds.AT, kinds.ASSERT, kinds.ASSERT_NOT):
            continue
        if op is kinds.LITERAL:
            inner = {chr(arg)}, False
        elif op is kinds.IN and all(kind is kinds.LITERAL for kind, _ in arg):
            inner = {chr(c) for _, c in arg}, False
        elif op is kinds.SUBPATTERN:
            inner = _first(arg[-1])
        elif op is kinds.BRANCH:
            each = [_first(branch) for branch in arg[1]]
            inner = (set().union(*(c for c, _ in each)), any(empty for _, empty in each)) if all(each) else None
        elif op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
            inner = _first(arg[2])
            inner = inner and (inner[0], inner[1] or arg[0] == 0)
        else:
            inner = None
        if inner is None:
            return None
        chars |= inner[0]
        if not inner[1]:
            return chars, False
    return chars, True


def headed(pattern: str) -> str:
    """The pattern behind a look at the character that it must begin with, in either case: far cheaper where it is tried at every place."""
    found = _first(parser.parse(pattern))
    if found is None or found[1]:
        return f"(?:{pattern})"
    either = sorted({x for c in found[0] for x in ((c.lower(), c.upper()) if c.isascii() else (c,))})
    return f"(?=[{''.join(map(re.escape, either))}])(?:{pattern})"


class Matcher:
    """Compiled patterns by number, and the automaton of what they need. hints are literals that a text must hold besides."""

    def __init__(self, patterns: Iterable[str], hints: Iterable[str] | None = None):
        self.patterns = [re.compile(p) for p in patterns]
        self.hints = [h.lower() for h in hints] if hints is not None else [""] * len(self.patterns)
        self.always: set[int] = set()
        owners: dict[str, set[int]] = {}
        for i, p in enumerate(self.patterns):
            needs = required(p.pattern)
            if needs is None:
                self.always.add(i)
            for literal in needs or ():
                owners.setdefault(literal, set()).add(i)
        self.automaton = ahocorasick.Automaton()
        for literal, rules in owners.items():
            self.automaton.add_word(literal, tuple(rules))
        if owners:
            self.automaton.make_automaton()

    def named(self, text: str) -> list[int]:
        """The patterns to try on a text, in order."""
        low = text.lower()
        found = set(self.always)
        if len(self.automaton):
            for _, rules in self.automaton.iter(low):
                found.update(rules)
        return sorted(i for i in found if self.hints[i] in low)
