import ipaddress
import time
from datetime import date, timedelta

import pytest

from knownat.llm import pii

KEY = b"test key"
VALUES = {
    "email": ["jo.doe+9@mail.example.com", "a1@b.org"],
    "card": ["4539578763621486", "4539 5787 6362 1486"],
    "phone": ["+1 (807) 555-6237", "415-555-2671"],
    "ip": ["10.0.0.1", "203.10.240.9"],
    "date": ["2024-02-29", "31/12/1999"],
    "ssn": ["219-09-9999"],
}


def test_permutation_is_a_bijection():
    radixes = [10, 10, 26]
    seen = set()
    for value in range(2600):
        digits = pii._digits(value, radixes)
        moved = pii.permute(digits, radixes, KEY, b"t")
        assert all(0 <= d < r for d, r in zip(moved, radixes, strict=True))
        assert pii.permute(moved, radixes, KEY, b"t", undo=True) == digits
        seen.add(tuple(moved))
    assert len(seen) == 2600


@pytest.mark.parametrize(("kind", "value"), [(k, v) for k, vs in VALUES.items() for v in vs])
def test_pseudonyms_keep_the_format_and_can_be_undone(kind, value):
    given = pii.pseudonym(kind, value, KEY)
    assert given != value
    assert [c.isdigit() for c in given] == [c.isdigit() for c in value]
    assert next(k for k in pii.KINDS if k.name == kind).valid(given)
    assert pii.pseudonym(kind, given, KEY, True) == value
    assert pii.pseudonym(kind, value, b"other") != given
    text, counts = pii.pseudonymise(f"see {value}, and {value}.", KEY)
    assert text == f"see {given}, and {given}."
    assert counts == {kind: 2}


@pytest.mark.parametrize(
    ("kind", "value"),
    [("phone", v) for v in ("+1 (017) 555-7713", "+1 (132) 555-1352", "415-055-2671", "(100) 100-0000")]
    + [("date", v) for v in ("12/31/2020", "02.29.2024", "31.12.2020", "05-06-1999")],
)
def test_phones_of_any_digits_and_dates_in_either_order_are_replaced(kind, value):
    given = pii.pseudonym(kind, value, KEY)
    assert pii.pseudonymise(f"see {value}.", KEY) == (f"see {given}.", {kind: 1})
    assert given != value
    assert pii.pseudonym(kind, given, KEY, True) == value


@pytest.mark.parametrize("text", ["31/31/2020", "02/30/2020", "13.13.2013", "12/31/1899"])
def test_what_is_a_day_in_neither_order_stays(text):
    assert pii.pseudonymise(text, KEY) == (text, {})


@pytest.mark.parametrize(
    "text",
    ["", "no data", "4539578763621487", "300.1.2.3", "1.2.3.4.5", "2023-02-29", "000-12-3456",
     "room 12 of 345, 67 8", "@home", "x@y", "version 1.2.3"],
)
def test_what_fails_its_check_stays(text):
    assert pii.pseudonymise(text, KEY) == (text, {})


@pytest.mark.parametrize(
    ("kind", "values"),
    [
        ("card", ["4539578763621486", "4539 5787 6362 1486", "4539-5787-6362-1486"]),
        ("phone", ["+1 (807) 555-6237", "807-555-6237", "(807) 555-6237", "+18075556237"]),
        ("phone", ["+44 20 7946 0958", "+442079460958", "+44 (20) 7946-0958"]),
        ("date", ["2024-02-29", "29/02/2024", "29.2.2024"]),
        ("iban", ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"]),
        ("ipv6", ["2001:db8::8a2e:370:7334", "2001:0DB8:0000:0000:0000:8A2E:0370:7334"]),
        ("email", ["jo.doe@mail.example.com", "Jo.Doe@mail.example.com"]),
    ],
)
def test_a_value_keeps_one_pseudonym_however_it_is_written(kind, values):
    def plain(text):
        if kind == "date":
            return pii._reading(text)[1]
        if kind == "ipv6":
            return ipaddress.IPv6Address(text)
        digits = "".join(c for c in text.lower() if c.isalnum())
        return digits[-10:] if kind == "phone" else digits

    made = [pii.pseudonym(kind, v, KEY) for v in values]
    assert len({plain(m) for m in made}) == 1 and plain(made[0]) != plain(values[0])
    for value, given in zip(values, made):
        assert pii.pseudonymise(f"see {value}.", KEY) == (f"see {given}.", {kind: 1})
        assert plain(pii.pseudonym(kind, given, KEY, True)) == plain(value)
        valid = {k.valid for k in pii.KINDS if k.name == kind}
        assert all(check(given) for check in valid)


def test_valid_values_are_permuted_among_themselves():
    """Every day, and every address of one shape, is the pseudonym of exactly one other."""
    days = {(date(1900, 1, 1) + timedelta(days=i)).isoformat() for i in range(0, 73049)}
    assert {pii.pseudonym("date", d, KEY) for d in days} == days
    late = {f"{m:02d}/{d}/2020" for m in range(1, 13) for d in range(13, 29)}
    assert len({pii.pseudonym("date", d, KEY) for d in late}) == len(late)
    hosts = {f"192.168.{a}.{b}" for a in range(100, 256, 5) for b in range(100, 256, 5)}
    made = {pii.pseudonym("ip", h, KEY) for h in hosts}
    assert len(made) == len(hosts) and all(pii._address(m) for m in made)


def test_distinct_values_take_no_walking():
    began = time.process_time()
    for i in range(20_000):
        pii.pseudonym("ip", f"192.168.{100 + i % 156}.{100 + i // 156}", KEY)
    assert time.process_time() - began < 10


@pytest.mark.parametrize(
    "text", ["DE89 3704 0044 0532 0130 02", "12:30:45", "a::b", "1:2:3", "+12 34", "1/13/13"]
)
def test_what_only_looks_alike_stays(text):
    assert pii.pseudonymise(text, KEY) == (text, {})


def test_documents(spark, odd, nothing):
    rows = [(1, "mail a.b@c.org now", 5), (2, None, 5), (3, "", 5), (3, "", 5), (None, "10.1.2.3", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_found long")
    got = sorted((tuple(r) for r in pii.pseudonymise_documents(docs, KEY).collect()), key=repr)
    wanted = []
    for doc, text, _ in rows:
        made, counts = (None, {}) if text is None else pii.pseudonymise(text, KEY)
        wanted.append((doc, made, sum(counts.values()), counts))
    assert got == sorted(wanted, key=repr)
    found = pii.pseudonymise_documents(docs, KEY, only_found=True).collect()
    assert sorted(r.doc_id or 0 for r in found) == [0, 1]
    assert pii.pseudonymise_documents(odd, KEY).count() == odd.count()
    assert pii.pseudonymise_documents(nothing, KEY).count() == 0
