"""Personal data against one left-to-right scan with each base pattern."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import personal as P
from palimpsest.llm import queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in P.IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in P.CARD.finditer(text):
        bare = re.sub("[ -]", "", m[0])
        if 14 <= len(bare) <= 19 and P.luhn(bare):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in P.PHONE.finditer(text)
            if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out)


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text("ab1279.@-+ ()é%", max_size=60), st.text("0123456789.- +", max_size=60)))
def test_base_spans_equal_a_plain_scan(text):
    assert [s for s in P.spans(text) if s[1] < 4] == brute(text)


@settings(max_examples=1500, deadline=None)
@given(st.text("İıſK AZaz19-\xa0.#:+@", max_size=50), st.sampled_from(["IBAN ", "konto", "account no. ", "12 ", "rue ", "st ", "http"]),
       st.text("İıſK AZaz19-\xa0., /:", max_size=50))
def test_added_kinds_on_letters_that_fold(before, cue, after):
    text = before + cue + after
    for start, kind, end in P.spans(text):
        assert 0 <= start < end <= len(text)
        if P.KINDS[kind] == "account":
            assert re.fullmatch("[A-Za-z0-9\x20\xa0-]+", text[start:end])


def test_accounts_beside_letters_that_fold():
    assert found("IBAN TR33 0006 1005 1978 6457 8413 2İ", "email") == []
    assert found("IBAN\xa0DE89370400440532013000İ", "account") == ["DE89370400440532013000"]


def test_planted_cases():
    text = "x a.b@c.example.org, +1 (807) 555-5623; 4539 1488 0343 6467 at 10.0.0.255 and 1.2.3.256."
    kinds = [P.KINDS[k] for _, k, _ in P.spans(text)]
    assert [k for k in kinds if k in P.BASE] == ["email", "phone", "card", "ip"]
    assert ("url" in [P.KINDS[k] for _, k, _ in P.spans("see https://a.example.org/x?y=1 now")])
    assert [P.KINDS[k] for _, k, _ in P.spans("IBAN: DE89370400440532013000 paid")] == ["account"]
    assert [P.KINDS[k] for _, k, _ in P.spans("12 High Street or Hauptstrasse 7")] == ["address", "address"]
    assert P.spans(None) == P.spans("") == []


def test_query_covers_every_document_and_odd_rows(spark, tmp_path):
    rows = [(1, None, "x"), (2, "", "x"), (3, "me@a.b " * 3000, "x"), (3, "me@a.b " * 3000, "x"), (None, "1.2.3.4", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, found string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op5_personal_data"](spark, str(tmp_path)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 5 and by[3].n_email == 3000 and by[None].n_ip == 1
    assert by[1].spans == "" and by[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.QUERIES["op5_personal_data"](spark, f"{tmp_path}/none").collect() == []


def test_query_equals_a_plain_scan_on_the_given_documents(spark):
    got = queries.QUERIES["op5_personal_data"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for row in got:
        want = brute(texts[row.doc_id])
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert row.base_sha256 == hashlib.sha256(P.joined(want).encode()).hexdigest()


def found(text, kind):
    return [text[a:b] for a, k, b in P.spans(text) if P.KINDS[k] == kind]


def test_grouped_accounts_and_further_street_cues():
    iban = "DE89 3704 0044 0532 0130 00"
    for text in (f"IBAN {iban}", f"iBaN: {iban} by 12 May", f"IBAN {iban} BIC COBADEFF", f"Iban {iban.replace(' ', '-')}."):
        assert [re.sub("-", " ", v) for v in found(text, "account")] == [iban], text
    assert found("account no. 1234 5678 90 is closed", "account") == ["1234 5678 90"]
    assert found("Account Number: 12345678", "account") == ["12345678"]
    assert found("IBAN DE88 3704 0044 0532 0130 00", "account") == [] and found("account of 12 people", "account") == []
    for address in ("12 Main St.", "7 Elm Ave", "99 Old Mill Rd", "4 Penny Lane", "221 Sunset Drive", "Potsdamer Platz 1",
                    "Marktplatz 3", "Hauptstr. 7", "avenida 12", "Avenida de Mayo 845", "via Roma 12", "8 hIgH sTrEeT",
                    "10 rue", "İ 3 Park AVENUE"):
        assert len(found(f"at {address} now", "address")) == 1, address
    for text in ("the best 3 and first 4 people", "driven 5 miles; drive 5 miles", "we came via 2 ways", "place 3", "the 1st 12",
                 "3 people drive home", "the avenue that opened in 12"):
        assert found(text, "address") == [], text
    assert found("account 12345678 10 May", "account") == ["12345678"]
    assert found("account 12-34-56-7", "account") == ["12-34-56-7"]
