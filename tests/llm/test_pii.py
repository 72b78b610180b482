import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmap.llm.pii import BASE, anchors, as_text, count_of, find_pii, luhn, parse, redact
from tests.llm.common import awkward, frame, lower

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return (True, kind != 1 or all(int(p) <= 255 for p in text.split(".")),
            12 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15)[kind]


def brute(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text)
                  if valid(k, m.group()))


CASES = [
    "write to a.b%c@x-y.co.uk, or @me.com a@b a@b.c@d.e", "1.2.3.4.5.6.7.8 300.1.1.1 1.1.1.300 01.002.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 0000000000000000", "+1 (301) 555-0346 +12 +1......2 +49-30.123 456 7",
    "é x@é.com ü@ü x@y.z ", "+1 4111111111111111 a@1.2.3.4", "12345678901234567890 1", "@@@ a@@b.c a@b..c a@-.-",
]


@pytest.mark.parametrize("text", CASES)
def test_base_equals_regular_expressions(text):
    assert [s for s in parse(text, lower(text), anchors()) if s[1] < 4] == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aZ@.-+0123459 ()é%\n", max_size=60))
def test_base_equals_regular_expressions_on_any_text(text):
    assert [s for s in parse(text, lower(text), anchors()) if s[1] < 4] == brute(text)


def test_added_kinds():
    text = "IBAN: DE89 3704 0044 0532 0130 00, account no. 12345678 token = \"4d44c79e8bf7c557\" https://u:pw@h.com/x xtoken: y"
    found = [(text[a:b], k) for a, k, b in parse(text, lower(text), anchors()) if k > 3]
    assert found == [("DE89 3704 0044 0532 0130 00", 5), ("12345678", 6), ("4d44c79e8bf7c557", 7), ("https://u:pw@h.com/x", 4)]


@pytest.mark.parametrize("scheme", ["abcdefghij" * 4, "x" * 5000, "git+ssh", "a.b-c"])
def test_schemes_of_any_length(scheme):
    for before in ("", " ", "(", "7.", "é"):
        text = f"{before}{scheme}://u:pw@h.com"
        assert [s for s in parse(text, lower(text), anchors()) if s[1] == 4] == [(len(before), 4, len(text))]
    assert [s for s in parse("://u:p@h.com", "://u:p@h.com", anchors()) if s[1] == 4] == [(0, 4, 12)]


def test_table(spark):
    rows = [*awkward(), (90, "mail é@x a@b.co and 1.2.3.4"), (91, "x " * 50_000 + "a@b.co")]
    docs = frame(spark, rows, extra=True)
    done = find_pii(docs)
    assert done.columns == [*docs.columns, "spans"] and find_pii(docs.where("false")).count() == 0
    out = done.select("doc_id", as_text(F.col("spans")).alias("s"), redact(F.col("text"), F.col("spans")).alias("r"),
                      *[count_of(F.col("spans"), k).alias(k) for k in BASE]).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert by[90]["s"] == "email:9:15,ip:20:27" and by[90]["r"] == "mail é@x [email] and [ip]"
    assert by[91]["s"] == "email:100000:100006" and by[20]["s"] == "" and by[90]["ip"] == 1
