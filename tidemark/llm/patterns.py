"""Exact patterns for personal data and secrets, each linear in the length of the text.

Matches are leftmost and do not overlap within a kind; a match that fails its check is
dropped and not tried again in parts. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

Span = tuple[str, int, int]

#: Fixed value: kinds in the order in which spans at one place are listed.
PERSONAL = ("email", "ip", "card", "phone")
SECRET = ("assign", "access", "hex", "other")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.ASCII | re.IGNORECASE,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    # every match holds one "@" that splits it, so the search goes from "@" to "@"
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            yield "email", start, done
        else:
            # what stands before this "@" cannot be part of a later match
            done = at + 1
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[Span]:
    # a chain of numbers with single dots holds matches of four numbers each, from the left
    for match in _NUMBERS.finditer(text):
        if match.group().count(".") < 3:
            continue
        numbers, start = match.group().split("."), match.start()
        for i in range(0, len(numbers) - 3, 4):
            four = numbers[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(n.lstrip("0")) <= 3 and int(n.lstrip("0") or 0) <= 255 for n in four):
                yield "ip", start, end
            start = end + 1


def cards(text: str) -> Iterator[Span]:
    for match in _DIGITS.finditer(text):
        if match.end() - match.start() < 14:
            continue
        digits = match.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield "card", *match.span()


def phones(text: str) -> Iterator[Span]:
    if "+" not in text:
        return
    for match in _PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in match.group()) <= 15:
            yield "phone", *match.span()


def personal(text: str) -> list[Span]:
    """Personal data by the patterns, ordered by start and kind."""
    found = [*emails(text), *ips(text), *cards(text), *phones(text)]
    return sorted(found, key=lambda s: (s[1], PERSONAL.index(s[0])))


def secrets(text: str) -> list[tuple[str, int, int, str]]:
    """Secrets by the patterns with their values, ordered by start and kind."""
    found = []
    if "=" in text or ":" in text:
        for match in _ASSIGN.finditer(text):
            if len(match[2]) >= 12:
                found.append(("assign", *match.span(), match[2]))
    found += (("access", *m.span(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 18)
    # a run of at least 16 matches as a whole: shorter runs are never tried in parts
    found += (("hex", *m.span(), m[0]) for m in _HEX.finditer(text))
    return sorted(found, key=lambda s: (s[1], SECRET.index(s[0])))
