"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, schemes, digits, plus signs before digits and cue words.
Around each anchor a deterministic parser expands to the boundaries of an e-mail, IP address, card number, phone
number, URL with credentials, IBAN, account number or secret, and validates what it has found. Text without anchors
costs the one pass only.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.llm.texts import one_array

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "credential_url", "iban", "account", "secret")
SPAN = "struct<kind:string,start:int,end:int>"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
SCHEME = LETTERS | frozenset("0123456789+.-")
USERINFO = re.compile(r"://[^\s/?#@:]+:[^\s/?#@]+@[A-Za-z0-9.-]+(?::[0-9]+)?[^\s<>\"']*")
IBAN = re.compile(r"[ :#=]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"(?: ?(?:no|number|num|id)\b)?[.:#= ]{1,4}([A-Z0-9][A-Z0-9-]{4,22}[0-9])(?![A-Za-z0-9])")
SECRET = re.compile(r"[\"']? ?[:=] ?[\"']?([A-Za-z0-9+/_.-]{16,})")

CUES = {
    "iban": IBAN, "account": ACCOUNT, "acct": ACCOUNT, "passport": ACCOUNT, "ssn": ACCOUNT,
    "token": SECRET, "secret": SECRET, "password": SECRET, "api_key": SECRET, "apikey": SECRET,
}
KIND_OF = {IBAN: 5, ACCOUNT: 6, SECRET: 7}


def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, what in [("@", "at"), ("://", "scheme"), *[(str(d), "digit") for d in range(10)],
                       *[(f"+{d}", "plus") for d in range(10)], *[(cue, cue) for cue in CUES]]:
        found.add_word(word, (what, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _cue(text: str, start: int, end: int, pattern: re.Pattern) -> tuple[int, int, int] | None:
    """An identifier behind a cue word that stands alone."""
    if start and (text[start - 1].isalnum()):
        return None
    m = pattern.match(text, end)
    if not m:
        return None
    value, kind = m.group(1), KIND_OF[pattern]
    if kind == 5:
        words = value.split(" ")
        while words and not _iban(" ".join(words)):
            words.pop()
        return (m.start(1), kind, m.start(1) + len(" ".join(words))) if words else None
    enough = sum(c.isdigit() for c in value) >= (6 if kind == 6 else 4)
    return (m.start(1), kind, m.end(1)) if enough else None


def parse(text: str, low: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """Spans (start, number of the kind, end) of a text, by start and then kind."""
    spans: set[tuple[int, int, int]] = set()
    ends = [0, 0, 0, 0]  # of the last match of each base kind, valid or not
    for last, (what, size) in automaton.iter(low):
        at = last - size + 1
        if what == "digit":
            if at >= ends[1] and not (at and "0" <= text[at - 1] <= "9") and (m := IP.match(text, at)):
                ends[1] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                    spans.add((at, 1, m.end()))
            if at >= ends[2] and (m := CARD.match(text, at)):
                ends[2] = m.end()
                digits = _digits(m.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.add((at, 2, m.end()))
        elif what == "at":
            start = at
            while start > ends[0] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                spans.add((start, 0, m.end()))
                ends[0] = m.end()
        elif what == "plus":
            if at >= ends[3] and (m := PHONE.match(text, at)):
                ends[3] = m.end()
                if 9 <= len(_digits(m.group())) <= 15:
                    spans.add((at, 3, m.end()))
        elif what == "scheme":
            if m := USERINFO.match(text, at):
                start = at
                while start and text[start - 1] in SCHEME:
                    start -= 1
                while start < at and text[start] not in LETTERS:
                    start += 1
                spans.add((start, 4, m.end()))
        elif found := _cue(text, at, last + 1, CUES[what]):
            spans.add(found)
    return sorted(spans)


def spans(text: Column | str) -> Column:
    """All spans of a text as an array of (kind, start, end): code points, end exclusive, by start and then kind."""

    @F.arrow_udf(f"array<{SPAN}>")
    def found(texts: pa.Array) -> pa.Array:
        texts, automaton = one_array(texts), anchors()
        offsets, rows = [0], []
        for text, low in zip(texts.to_pylist(), pc.ascii_lower(texts).to_pylist()):
            rows += parse(text, low, automaton)
            offsets.append(len(rows))
        kinds = pa.array([KINDS[k] for _, k, _ in rows], pa.string())
        values = pa.StructArray.from_arrays(
            [kinds, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())],
            names=["kind", "start", "end"],
        )
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    return found(text)


def find_pii(docs: DataFrame, text_col: str = "text", into: str = "spans") -> DataFrame:
    """Every row with its spans in the column `into`, which replaces one of that name.

    Base spans are the leftmost, non-overlapping matches of each base kind; a match that fails its check (parts of an
    IP address above 255, length or Luhn sum of a card, digits of a phone number) is dropped without another try.
    Spans of different kinds may overlap. A null or empty text has no spans; equal rows get equal spans; an empty
    table stays empty; other columns stay as they are. Texts of any length are read whole.
    """
    return docs.withColumn(into, spans(F.col(text_col)))


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("bigint")


def as_text(found: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first one counts."""
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        between = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        replaced = F.struct(F.concat(acc["out"], between, F.lit("["), s["kind"], F.lit("]")).alias("out"),
                            s["end"].alias("at"))
        return F.when(s["start"] >= acc["at"], replaced).otherwise(acc)

    return F.aggregate(
        found, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text)))
    )
