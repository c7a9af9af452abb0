"""Personal data by anchor expansion.

One Aho-Corasick pass finds at-signs, schemes, plus signs, digits and identifier
cues. At each anchor a small deterministic parser expands to both sides and
validates what it found. Every parser moves forward only, so time is linear.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushdex.llm.common import arrow_schema, carried, restored, slices, to_batches

#: Kinds in the order in which spans of one start are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
#: Words that announce an account number or a secret.
ACCOUNT_CUES = ("account", "acct", "iban")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_REST = re.compile(r"[^\s\"'<>()\[\]{}|\\^`]+")
_ACCOUNT = re.compile(r"(?:[ _]?(?:number|no\.?|id))?\s{0,3}[:=#]?\s{0,3}([A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{2,4}){3,8}|[0-9](?:[ -]?[0-9]){7,19})(?![A-Za-z0-9])", re.IGNORECASE)
_SECRET = re.compile(r"\s{0,3}[:=]\s{0,3}([\"']?)([A-Za-z0-9_+/=.~-]{8,})\1")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("0", 1))
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    a.add_word("://", ("/", 3))
    for tag, cues in (("a", ACCOUNT_CUES), ("s", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.title()}:
                a.add_word(form, (tag, len(form)))
    a.make_automaton()
    return a


_ANCHORS = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def iban(text: str) -> bool:
    """Length and check digits of an international account number."""
    s = text.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) by start, then kind as listed; ends are exclusive."""
    out: list[tuple[int, int, str]] = []
    email = ip = card = phone = url = run = account = secret = 0  # where each kind may go on
    for last, (tag, size) in _ANCHORS.iter(text):
        at = last - size + 1
        if tag == "0":
            if at >= run:
                run = _DIGITS.match(text, at).end()
                if at >= ip and (m := _IP.match(text, at)):
                    ip = m.end()
                    if all(map(_octet, m.groups())):
                        out.append((at, ip, "ip"))
                if at >= card:
                    m = _CARD.match(text, at)
                    if m:
                        card = m.end()
                        digits = m[0].replace(" ", "").replace("-", "")
                        if 12 <= len(digits) <= 19 and luhn(digits):
                            out.append((at, card, "card"))
        elif tag == "@":
            start = at
            while start > email and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email = m.end()
                out.append((start, email, "email"))
        elif tag == "+":
            if at >= phone and (m := _PHONE.match(text, at)):
                phone = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((at, phone, "phone"))
        elif tag == "/":
            start = at
            while start > url and text[start - 1] in _SCHEME:
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
            if start < at and (m := _REST.match(text, at + 3)):
                end = at + 3 + len(m[0].rstrip(".,;:!?"))
                if end > at + 3:
                    url = end
                    out.append((start, end, "url"))
        elif tag == "a":
            if at >= account and (m := _ACCOUNT.match(text, last + 1)) and (m[1][0].isdigit() or iban(m[1])):
                account = m.end(1)
                out.append((m.start(1), m.end(1), "account"))
        elif at >= secret and (m := _SECRET.match(text, last + 1)):
            secret = m.end()
            out.append((m.start(2), m.end(2), "secret"))
    return sorted(set(out), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Put ``[KIND]`` for every span; overlapping spans become one, named after the first."""
    if not spans:
        return text
    merged: list[list] = []
    for a, b, k in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    out, at = [], 0
    for a, b, k in merged:
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, keep: tuple[str, ...] = (), clean: bool = False) -> DataFrame:
    """One row per row of ``docs`` with counts and spans of personal data.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, then the
    columns ``keep``, then with ``clean`` clean_text (null where text is null). A
    null or empty text has no spans; repeated and null ids keep their rows; an
    empty table gives an empty result.
    """
    extra = "".join(f", `{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string{extra}" + ", clean_text string" * clean
    arrow = arrow_schema(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in slices(batches):
                for doc, text, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    spans = find(text or "")
                    base = [s for s in spans if s[2] in KINDS[:4]]
                    many = [sum(s[2] == k for s in base) for k in KINDS[:4]]
                    row = (doc, *many, hashlib.sha256(written(base).encode()).hexdigest(), written(spans), *rest)
                    yield (*row, None if text is None else redact(text, spans)) if clean else row

        yield from to_batches(rows(), arrow)

    return docs.select("doc_id", "text", *keep).mapInArrow(run, ddl)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in text; n_chars follows. Rows stay."""
    held, rest = carried(docs)
    got = personal_data(held, tuple(rest.values()), clean=True)
    return restored(got, docs, rest, F.col("clean_text"), F.col("spans") != "")
