"""Operator 7: every kind is found, replaced one to one within its type, and linked within a document."""

import ipaddress
import random
import re
import string

import pytest

from braidgraph.llm import pii

RNG = random.Random(11)


def _digits(n, first="123456789"):
    return RNG.choice(first) + "".join(RNG.choice(string.digits) for _ in range(n - 1))


def _card():
    d = _digits(15, "3456")
    return d + str(pii._luhn(d))


def _iban():
    body = _digits(18)
    return f"DE{98 - int(''.join(str(int(c, 36)) for c in body + 'DE00')) % 97:02d}{body}"


MADE = {
    "email": lambda: "".join(RNG.choice("abcdefü.1") for _ in range(6)).strip(".") + f"x@{RNG.choice(['mail', 'münchen', '例子', 'почта'])}.{RNG.choice(['com', 'org'])}",
    "card": _card,
    "phone": lambda: f"+49 {_digits(3)} {_digits(3)} {_digits(4)}",
    "ip": lambda: RNG.choice(["192.168.", "10.3.", "127.0.", "8.8.", "203.0."]) + f"{RNG.randrange(256)}.{RNG.randrange(256)}",
    "ipv6": lambda: RNG.choice(["2001:db8", "fe80:0", "fd12:7"]) + "".join(f":{RNG.randrange(65536):x}" for _ in range(6)),
    "ssn": lambda: f"{RNG.randrange(100, 660)}-{RNG.randrange(10, 99)}-{RNG.randrange(1000, 9999)}",
    "iban": _iban,
    "name": lambda: f"{RNG.choice(['Anna', 'Hans', 'Laura'])} {RNG.choice('BDKMST')}{RNG.choice(['e', 'ai', 'ü', 'o'])}{RNG.choice(['rt', 'll', 'ck', 'b'])}{RNG.choice(['e', 'i', 'a'])}{RNG.choice(['r', 'n', 'st', 'dt'])}",
}


@pytest.mark.parametrize("kind", sorted(MADE))
def test_kind_is_replaced_one_to_one(kind):
    old = sorted({MADE[kind]() for _ in range(300)})
    seen = {}
    for x in old:
        text = f"see {x} now"
        new, found = pii.replaced(text)
        assert [(f[0], f[1], f[2]) for f in found] == [(4, 4 + len(x), kind)], x
        y = found[0][3]
        assert new == f"see {y} now" and y == pii.surrogate(kind, x) and x not in new
        if kind not in ("ip", "name"):
            assert len(y) == len(x) and [c.isalnum() for c in x] == [c.isalnum() for c in y]
        assert seen.setdefault(pii.normal(kind, y), pii.normal(kind, x)) == pii.normal(kind, x) and pii.normal(kind, y) != pii.normal(kind, x)
        assert [f[2] for f in pii.find(f"see {y} now")] == [kind], (x, y)
        if kind == "card":
            assert pii._luhn(y[:-1]) == int(y[-1])
        if kind == "iban":
            assert pii._mod97(y) == 1
        if kind == "ip":
            sort = lambda n: next((a for a, size in pii._SPECIAL if a <= n < a + size), None)
            assert sort(int(ipaddress.IPv4Address(x))) == sort(int(ipaddress.IPv4Address(y)))
        if kind == "ipv6":
            assert x[:4] == y[:4] if x[0] == "f" else not y.startswith(pii._SPECIAL_V6)
        if kind == "name":
            assert pii._GIVEN[x.split()[0].lower()][0] == pii._GIVEN[y.split()[0].lower()][0]
    assert len(seen) == len({pii.normal(kind, x) for x in old})


def test_cycles_reach_every_value_once():
    for n in (2, 3, 10, 1024, 1025, 5000):
        step, at, seen = pii.Cycle(b"k", "x", n), 0, set()
        for _ in range(n):
            at = step(at)
            seen.add(at)
        assert seen == set(range(n)) and at == 0
    assert {pii._address(b"k", 0xC0000200 + i) for i in range(256)} == {0xC0000200 + i for i in range(256)}
    assert [pii.Cycle(k, "x", 50)(i) for k in (b"a", b"b") for i in range(3)][:3] != [pii.Cycle(b"b", "x", 50)(i) for i in range(3)]


def test_surnames_of_one_length_stay_apart():
    letters = "aeklnst"
    words = [w for a in letters for b in letters for c in letters for d in letters if (w := a + b + c + d) not in pii._GIVEN]
    new = {w: pii._surname(pii.KEY, w.capitalize()) for w in words}
    assert len(set(new.values())) == len(words) and all(w.capitalize() != x for w, x in new.items())


def test_scripts_and_odd_cases():
    for x in ("İnfo@example.com", "用户@例子.com", "משה@דואר.com", "ǅon@ǆ.com", "ı@ß.org"):
        new, found = pii.replaced(x)
        assert [f[2] for f in found] == ["email"] and x not in new and len(new) == len(x), x
    phone = "+٤٩ ٣٠ ١٢٣ ٤٥٦٧"
    new, found = pii.replaced(f"({phone})")
    assert [f[2] for f in found] == ["phone"] and re.fullmatch("[(][+]٤٩ [٠-٩]{2} [٠-٩]{3} [٠-٩]{4}[)]", new) and phone not in new


def test_coreference_in_a_document():
    text = "Anna Schmidt came. Schmidt left, ANNA SCHMIDT and Anna too; O'Neil met John O'Neil."
    new, found = pii.replaced(text)
    by = {text[f[0] : f[1]]: f[3] for f in found}
    assert set(by) == {"Anna Schmidt", "Schmidt", "ANNA", "SCHMIDT", "Anna", "O'Neil", "John O'Neil"}
    assert by["Anna Schmidt"] == f"{by['Anna']} {by['Schmidt']}" and by["SCHMIDT"] == by["Schmidt"].upper() and by["ANNA"] == by["Anna"].upper()
    assert by["John O'Neil"].endswith(" " + by["O'Neil"]) and "Schmidt" not in new and "Neil" not in new
    assert pii.replaced("Schmidt left, and Anna too.")[1] == []


def test_taken_surrogates_go_on(monkeypatch):
    real = pii.surrogate

    def crowded(kind, s, key=pii.KEY):
        return "same@x.com" if s.startswith("user") else real(kind, s, key)

    monkeypatch.setattr(pii, "surrogate", crowded)
    new, found = pii.replaced("user1@x.com user2@x.com user3@x.com user2@x.com")
    given = [f[3] for f in found]
    assert len(set(given[:3])) == 3 and given[1] == given[3]


def test_documents_against_plain_replacement(spark):
    """All documents of a table: texts are their parts with each span's surrogate in place."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kinds = set()
    for r in pii.surrogates(docs).collect():
        text, out, at, names = texts[r["doc_id"]], [], 0, {}
        for e in r["entities"]:
            out += [text[at : e["start"]], e["surrogate"]]
            at = e["end"]
            kinds.add(e["kind"])
            key = (e["kind"], pii.normal(e["kind"], text[e["start"] : e["end"]]))
            assert names.setdefault(key, pii.normal(e["kind"], e["surrogate"])) == pii.normal(e["kind"], e["surrogate"]) != key[1]
        assert len(set(names.values())) == len(names)
        assert r["text"] == (None if text is None else "".join([*out, text[at:]]))
    assert {"email", "phone"} <= kinds
