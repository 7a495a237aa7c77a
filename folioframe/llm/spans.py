"""Leftmost, non-overlapping spans by fixed rules, in time linear in the text's length."""

from __future__ import annotations

import re

# The rules' patterns.
_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_ASSIGN_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    found: list[Span] = []
    low, at = 0, text.find("@")
    while at >= 0:
        domain = _AT_DOMAIN.match(text, at)
        start = at
        if domain:
            while start > low and not _NOT_LOCAL.match(text[start - 1]):
                start -= 1
            if start < at:
                found.append((start, domain.end()))
                low = domain.end()
        at = text.find("@", max(at + 1, low))
    return found


def addresses(text: str) -> list[Span]:
    """IPv4: within a run of digits and dots, each four neighbouring numbers make a match."""
    found: list[Span] = []
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        position, group = run.start(), []
        for part in run.group().split("."):
            group = [*group, (position, part)] if part else []
            position += len(part) + 1
            if len(group) == 4:
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for _, p in group):
                    found.append((group[0][0], group[3][0] + len(part)))
                group = []
    return found


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def cards(text: str) -> list[Span]:
    return [m.span() for m in _CARD.finditer(text)
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]


def phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]


def assignments(text: str) -> list[tuple[int, int, int, int]]:
    """Start and end of each assignment, then of its value."""
    lower = text.lower()
    if not any(key in lower for key in _ASSIGN_KEYS):
        return []
    return [(*m.span(), *m.span(1)) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]


def access_keys(text: str) -> list[Span]:
    return [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16] if "AKIA" in text else []


def hex_runs(text: str) -> list[Span]:
    return [m.span() for m in _HEX.finditer(text)]
