"""The linear span rules against the plain patterns."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from folioframe.llm import pii, secrets
from folioframe.llm import spans as rules

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed([int(c) for c in digits])):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits(text):
    return re.sub("[^0-9]", "", text)


def plain_pii(text):
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return found + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


def plain_secrets(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return [(a, b, k) for a, _, k, b in sorted(found)]


piece_pii = st.sampled_from([
    "a", "z.", "_%", "@", "@@", ".", "..", "b.c", "-", " ", "0", "255", "256", "0001", "1.2.3.4", "4111 1111 1111 1111",
    "4111111111111111", "+", "+1 (556) 555-7508", "(", ")", "é", "\n", "x@y.zz", "12-34", "9" * 20, "٣"])
piece_secret = st.sampled_from([
    "password", "PASSWD", "Secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abcd1234", "ſecret", "toKen",
    "AKIA", "ABCD1234EFGH", "0123456789abcdef", "deadbeef", "g", "/", "-", "\n", "é"])


@settings(max_examples=600, deadline=None)
@given(st.lists(piece_pii, max_size=14).map("".join))
def test_personal_data_rules(text):
    assert pii.base_spans(text) == plain_pii(text)


@settings(max_examples=600, deadline=None)
@given(st.lists(piece_secret, max_size=14).map("".join))
def test_secret_rules(text):
    assert [s[:3] for s in secrets.base_spans(text)] == plain_secrets(text)


def test_luhn():
    assert rules.luhn("4111111111111111") and not rules.luhn("4111111111111112")


def test_very_long_runs_take_linear_time():
    for text in ("a" * 300_000, "9" * 300_000, "a.b" * 100_000, "1." * 150_000, "+" * 300_000, "token " + " " * 300_000):
        pii.base_spans(text)
        secrets.base_spans(text)
