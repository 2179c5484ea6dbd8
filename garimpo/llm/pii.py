"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs before a digit, dots before a digit,
digits, ``://`` and identifier cues. Around each anchor a deterministic local parser expands to the
longest stretch its kind allows and validates it. Kinds never depend on each other.

Base kinds, leftmost and without overlaps within a kind: ``email``, ``ip``, ``card`` (Luhn),
``phone``. Further kinds: ``iban`` (a cue such as ``IBAN`` in front, ISO 7064 check), ``ssn`` (a cue
in front, nine digits as 3-2-4) and ``login`` (``scheme://user:secret@host``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from garimpo.llm.common import documents, small_batches, texts_of
from garimpo.llm.registry import query

KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "ssn", "login")
DIGITS = "0123456789"
# Cues in front of an account or identity number, compared without case.
IBAN_CUES = ("iban", "account", "acct")
SSN_CUES = ("ssn", "social security")
#: Characters between a cue and its number at most.
CUE_REACH = 24

AT, DIGIT, PLUS, SCHEME, IBAN, SSN = range(6)

LOCAL_BEFORE = re.compile(r"[A-Za-z0-9._%+-]*\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
DIGIT_GROUPS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN_TEXT = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
SSN_TEXT = re.compile(r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])")
SCHEME_BEFORE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
LOGIN_AFTER = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]+:[^\s@/]+@[A-Za-z0-9.-]+(?::[0-9]+)?")
NUMBER_RUN = re.compile(r"[0-9 .-]+")


def _automaton() -> ahocorasick.Automaton:
    anchors = {"@": AT, "://": SCHEME}
    anchors |= {d: DIGIT for d in DIGITS} | {"+" + d: PLUS for d in DIGITS}
    anchors |= {c: IBAN for cue in IBAN_CUES for c in (cue, cue.upper(), cue.title())}
    anchors |= {c: SSN for cue in SSN_CUES for c in (cue, cue.upper(), cue.title())}
    found = ahocorasick.Automaton()
    for anchor, kind in anchors.items():
        found.add_word(anchor, (kind, len(anchor)))
    found.make_automaton()
    return found


AUTOMATON = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _number_spans(text: str, start: int, end: int, spans: dict[str, list]) -> None:
    """Addresses and cards in the maximal stretch ``start:end`` of digits, points, spaces, hyphens."""
    stretch = text[start:end]
    if stretch.count(".") >= 3:
        for m in DOTTED.finditer(stretch):
            if all(int(p) <= 255 if len(p) < 10 else not p.strip("0") or int(p[-9:]) <= 255 and not p[:-9].strip("0") for p in m[0].split(".")):
                spans["ip"].append((start + m.start(), start + m.end()))
    if end - start >= 16:
        for m in DIGIT_GROUPS.finditer(stretch):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans["card"].append((start + m.start(), start + m.end()))


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in code points, end exclusive."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS + MORE_KINDS}
    email_end = number_end = phone_end = iban_end = ssn_end = 0
    for at, (kind, length) in AUTOMATON.iter(text):
        if kind == DIGIT:
            if at < number_end:
                continue
            # a stretch also reaches to the left over points, which start no match: begin at the digit
            number_end = NUMBER_RUN.match(text, at).end()
            if number_end - at >= 7:
                _number_spans(text, at, number_end, spans)
        elif kind == AT:
            left = at
            while left > email_end and text[left - 1] in LOCAL:
                left -= 1
            if left < at and (m := DOMAIN.match(text, at + 1)):
                spans["email"].append((left, email_end := m.end()))
        elif kind == PLUS:
            start = at - 1
            if start >= phone_end and (m := PHONE.match(text, start)):
                phone_end = m.end()
                if 8 <= sum(c in DIGITS for c in m[0]) <= 15:
                    spans["phone"].append(m.span())
        elif kind == SCHEME:
            before = SCHEME_BEFORE.search(text, max(0, at - 18), at - 2)
            if before and (m := LOGIN_AFTER.match(text, at + 1)):
                spans["login"].append((before.start(), m.end()))
        elif kind == IBAN:
            m = IBAN_TEXT.search(text, at + 1, at + 1 + CUE_REACH + 64)
            if m and m.start() <= at + CUE_REACH and m.start() >= iban_end:
                # the longest stretch that passes the check; groups of four may be followed by words
                for end in range(m.end(), m.start() + 14, -1):
                    if text[end - 1] != " " and iban_valid(text[m.start() : end]):
                        spans["iban"].append((m.start(), iban_end := end))
                        break
        else:
            m = SSN_TEXT.search(text, at + 1, at + 1 + CUE_REACH + 12)
            if m and m.start() <= at + CUE_REACH and m.start() >= ssn_end:
                spans["ssn"].append(m.span())
                ssn_end = m.end()
    return spans


def listed(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def redacted(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """``text`` with every span replaced by its kind in brackets; of overlapping spans the first,
    and of those that start together the longest, names the stretch they cover together."""
    out, at = [], 0
    end_of_last = 0
    for start, minus_end, kind in sorted((a, -b, k) for k, found in spans.items() for a, b in found):
        if start >= end_of_last or not out:
            out += [text[end_of_last:start], f"[{kind.upper()}]"]
        end_of_last = max(end_of_last, -minus_end)
    return "".join(out) + text[end_of_last:]


FOUND = (
    "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, "
    "spans string"
)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, their digest, and all spans of every text.

    A null or empty text has no spans; rows are independent, so repeated rows, null ids and
    further columns change nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [find(t) for t in batch.column("text").to_pylist()]
            columns = {"doc_id": batch.column("doc_id")}
            columns |= {f"n_{k}": pa.array([len(f[k]) for f in found], pa.int64()) for k in KINDS}
            columns["base_sha256"] = pa.array([hashlib.sha256(listed(f, KINDS).encode()).hexdigest() for f in found])
            columns["spans"] = pa.array([listed(f, KINDS + MORE_KINDS) for f in found])
            yield pa.RecordBatch.from_pydict(columns)

    return texts_of(docs).mapInArrow(run, FOUND)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; all columns stay, a null text stays null."""
    others = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = [t if t is None else redacted(t, find(t)) for t in batch.column("text").to_pylist()]
            at = others.index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


@query("op6_personal_data")
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir))
