"""Operator 7: personal data replaced by surrogates.

*Detection* on whole texts: e-mail addresses, payment cards, phone numbers, IPv4 and IPv6 addresses, US social security
numbers, IBANs, and person names (after a title, or a known given name before a capitalised surname; in Chinese one of the
100 or so commonest surnames before a known given name).  A run of digits with single blanks or hyphens is split into cards
of whole groups: as many digits as possible in cards whose check digit fits, then in cards at all.  After the run's first
group, groups of a card have three digits or more, but for its last.

*Surrogates* are keyed and type-consistent.  An entity is normalised (case, separators, country prefix, the script of digits)
and its characters are permuted within their classes: digits stay digits of their script, consonants and vowels of a script
stay such, letters of any other script stay letters of their Unicode block, everything else keeps its place, so format and
script are those of the original.  Check digits (Luhn, IBAN) and classes (the special networks of addresses, valid numbers)
carry over; known given names go to given names of the same gender and script, Chinese surnames to such.  In Latin surnames
usual clusters of consonants and vowels go to usual clusters of the same length and place, so they can be spoken.

*Coreference.*  Within a document, a single surname or given name of a person named in full there is the same entity part and
gets the same surrogate.

*Distinctness.*  For each format the replacement is a bijection without fixed points, one step along a keyed cycle over all
values of the format.  So an entity has the same surrogate in all documents, two entities never share one, and none keeps its
own; no table of entities is needed, nothing is shuffled, and it holds for any corpus.  Each document is checked for it all
the same: a later entity whose surrogate is taken by another goes further along its cycle.  ``collisions()`` checks a whole
corpus by a distributed aggregation.

Cases: null texts stay null with no entity; empty texts stay empty.  Overlapping findings: the earliest, then the longest,
stays.  Repeated rows repeat.  Letters whose case changes their number count as small ones.  Other columns are ignored.
"""

from __future__ import annotations

import hmac
import ipaddress
import math
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table

KEY = b"surrogates-of-this-corpus"
_ALPHABETS = ["0123456789", "aeiouy", "bcdfghjklmnpqrstvwxz", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "áàâãäåæèéêëìíîïòóôõöøùúûü", "çñðþß", "ëïœ"]
_CLASS: dict[str, int] = {}
for _i, _a in enumerate(_ALPHABETS):
    for _c in _a:
        _CLASS.setdefault(_c, _i)
_ALPHABETS = ["".join(c for c in a if _CLASS[c] == i) for i, a in enumerate(_ALPHABETS)]

#: Given names by (gender, script).
GIVEN = {
    ("f", "latin"): "Mary Anna Laura Julia Sarah Emma Alice Clara Sophie Marie Claire Camille Isabelle Elena Carmen Lucia Paula Maria Ingrid Greta Hannah Lena Ursula Monika Karen Linda Susan Rachel Nancy Helen".split(),
    ("m", "latin"): "John James Robert Michael William David Thomas Peter Paul Daniel Pierre Jean Luc Antoine Marcel Carlos Miguel Javier Pablo Diego Hans Klaus Jürgen Stefan Markus Karl Steven Kevin Brian George".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия Дарья Вера".split(),
    ("m", "cyrillic"): "Иван Сергей Алексей Дмитрий Андрей Михаил Николай Павел Олег Борис Виктор Юрий".split(),
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Ειρήνη".split(),
    ("m", "greek"): "Γιώργος Νίκος Κώστας Δημήτρης Παύλος Ανδρέας".split(),
    ("f", "han"): "秀英 桂英 秀兰 玉兰 丽华 淑珍".split(),
    ("m", "han"): "建国 志强 建华 国强 文明 永强".split(),
}
_GIVEN = {n.lower(): (k, i) for k, names in GIVEN.items() for i, n in enumerate(names)}
_HAN_SURNAMES = ["王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤", ["欧阳", "司马", "上官", "诸葛"]]
_HAN_GIVEN = [n for (_, script), names in GIVEN.items() if script == "han" for n in names]
#: 文明 is a word too, and many surnames end one before it: such a name begins its phrase.
_HAN = rf"(?:{'|'.join(_HAN_SURNAMES[1])}|[{_HAN_SURNAMES[0]}])(?:{'|'.join(n for n in _HAN_GIVEN if n != '文明')})|(?<![\u4e00-\u9fff])(?:{'|'.join(_HAN_SURNAMES[1])}|[{_HAN_SURNAMES[0]}])文明"
_TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sr Sra Господин Госпожа".split()
_SURNAME = r"(?:[A-Z]['’])?[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ][a-zß-öø-ÿά-ώа-яё]+(?:[-'’][A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+)?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": re.compile(r"[\w.%+-]+@(?:[^\W_][\w-]*\.)+[^\W\d_]{2,}"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ip": re.compile(rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"),
    "ipv6": re.compile(r"(?<![:\w])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![:\w])"),
    "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "card": re.compile(r"\d+(?:[ -]\d+)*"),
    "phone": re.compile(r"(?<![\w.+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<!\w)\+\d{8,15}(?!\d)"),
    "name": re.compile(rf"(?<!\w)(?:(?:{'|'.join(_TITLES)})\.? (?:{_SURNAME} )?{_SURNAME}|(?:{'|'.join(n for ns in GIVEN.values() for n in ns)}) {_SURNAME})(?!\w)|{_HAN}"),
}
_CAPITAL = re.compile(r"(?<!\w)[^\W\d_a-z](?:[^\W\d_]|[-'’](?=[^\W\d_]))+(?!\w)")
#: Usual clusters of Latin surnames by place: at the beginning, inside, at the end; and of vowels.
_CLUSTERS = {
    "first": "b c d f g h j k l m n p r s t v w z bl br ch cl cr dr fl fr gl gr kl kn kr ph pl pr sc sh sk sl sm sn sp st sw th tr tw wh wr zw chr phl phr sch scr shr spl spr str thr schl schm schn schr schw".split(),
    "inside": "b d f g k l m n p r s t v bb ck dd ff gg ld ll lm lt mb mm mp nd ng nk nn nt pp rd rg rk rm rn rs rt rz sk sp ss st tt tz ldm lst nds ndr ngl ngs nkl nst rst rtn rtz sch tzl".split(),
    "last": "d f g k l m n p r s t v x z ch ck ds dt ff ft gs ld lf ll lm ls lt mm mp nd ng nk nn ns nt nz pp rd rg rk rm rn rs rt rz sh sk ss st th ts tt tz ght lds lsh lst mpf nds ngs nks nst rch rds rst rth rts rtz sch tch".split(),
    "vowels": "a e i o u ae ai au ea ee ei eu ia ie io oa oo ou ue".split(),
}
_NAMED = re.compile("|".join([*_TITLES, *(n for ns in GIVEN.values() for n in ns)]))


def _cards(text: str) -> list[tuple[int, int]]:
    """(start, end) of the payment cards of a text."""
    out = []
    for m in PATTERNS["card"].finditer(text):
        if m.end() - m.start() < 13:
            continue
        groups = [(g.start(), g.end()) for g in re.compile(r"\d+").finditer(text, *m.span())]
        best: list[tuple] = [(0, 0, 0, 0)] * (len(groups) + 1)  # (digits of fitting cards, of all cards, -cards, group after the card)
        for i in range(len(groups) - 1, -1, -1):
            best[i] = (*best[i + 1][:3], 0)
            d = ""
            for j in range(i, len(groups)):
                a, b = groups[j]
                if len(d) + b - a > 19:
                    break
                d += text[a:b]
                if len(d) >= 13:
                    after = best[j + 1]
                    best[i] = max(best[i], (after[0] + len(d) * (_luhn(d[:-1]) == int(d[-1])), after[1] + len(d), after[2] - 1, j + 1))
                if i and b - a < 3:
                    break
        i = 0
        while i < len(groups):
            if best[i][3]:
                out.append((groups[i][0], groups[best[i][3] - 1][1]))
            i = best[i][3] or i + 1
    return out


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, without overlaps."""
    text, out = text or "", []
    digits = re.search(r"\d", text) is not None
    cards = _cards(text) if digits else []
    out += [(*c, "card") for c in cards]
    for kind, pattern in PATTERNS.items():
        if kind == "card":
            continue
        if kind == "email":
            if "@" not in text:
                continue
        elif kind == "ipv6":
            if text.count(":") < 2:
                continue
        elif kind == "name":
            if not _NAMED.search(text):
                continue
        elif not digits:
            continue
        for m in pattern.finditer(text):
            if kind == "phone" and (cut := next((a for a, b in cards if m.start() < a < m.end() < b), None)) and not (m := pattern.match(text, m.start(), cut)):
                continue  # ran into a card
            n = sum(map(str.isdigit, m[0]))
            if kind == "phone" and not (7 <= n <= 15 and (n >= 10 or m[0][0] in "+(")):
                continue
            if kind == "iban" and _mod97(m[0]) != 1:
                continue
            out.append((*m.span(), kind))
    kept = _apart(out)
    parts = {small(w) for a, b, k in kept if k == "name" for w in re.findall(r"[^\s.]+", text[a:b]) if w not in _TITLES and len(w) > 1}
    if parts:
        kept = _apart(kept + [(*m.span(), "name") for m in _CAPITAL.finditer(text) if small(m[0]) in parts])
    return kept


def _apart(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Findings without those that overlap an earlier or, from the same place, a longer one."""
    kept, at = [], 0
    for f in sorted(found, key=lambda f: (f[0], -f[1])):
        if f[0] >= at:
            kept.append(f)
            at = f[1]
    return kept


def _mod97(iban: str) -> int:
    s = re.sub(r"\W", "", iban).upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _luhn(payload: str) -> int:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


@lru_cache(maxsize=1000)
def _shuffled(key: bytes, name: str, n: int) -> tuple[int, ...]:
    """What follows each of 0..n-1 on one keyed cycle over all."""
    order = sorted(range(n), key=lambda i: hmac.digest(key, f"{name}|{i}".encode(), "sha256"))
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    return tuple(after[i] for i in range(n))


class Cycle:
    """A keyed bijection of 0..n-1 without fixed points (n > 1): a shuffled cycle, or for large n a Feistel network, one step on,
    and back, as often as it leaves the range."""

    def __init__(self, key: bytes, name: str, n: int):
        self.key, self.name, self.n = key, name.encode(), n
        self.after = _shuffled(key, name, n) if n <= 1024 else None
        self.a = math.isqrt(n - 1) + 1
        self.b = -(-n // self.a)

    def _f(self, r: int, x: int, n: int) -> int:
        size = max(32, (n.bit_length() + 7) // 8 + 8)
        out = b"".join(hmac.digest(self.key, b"%d|%d|%d|" % (r, i, x) + self.name, "sha256") for i in range(-(-size // 32)))
        return int.from_bytes(out, "big") % n

    def __call__(self, x: int) -> int:
        if self.after:
            return self.after[x]
        a, b = self.a, self.b
        left, right = divmod(x, b)
        for r in range(0, 8, 2):
            left = (left + self._f(r, right, a)) % a
            right = (right + self._f(r + 1, left, b)) % b
        at = left * b + right
        while True:
            at = (at + 1) % (a * b)
            left, right = divmod(at, b)
            for r in range(6, -1, -2):
                right = (right - self._f(r + 1, left, b)) % b
                left = (left - self._f(r, right, a)) % a
            if left * b + right < self.n:
                return left * b + right


def small(s: str) -> str:
    """Lower case without a change of length."""
    low = s.lower()
    return low if len(low) == len(s) else "".join(x if len(x := c.lower()) == 1 else c for c in s)


@lru_cache(maxsize=5000)
def _alphabet(c: str) -> str:
    """The characters that may stand for a small one: of its class, else the digits of its script, else the letters of its kind in
    its Unicode block of 256; none for signs."""
    if c in _CLASS:
        return _ALPHABETS[_CLASS[c]]
    if c.isdecimal():
        zero = ord(c) - int(c)
        return "".join(map(chr, range(zero, zero + 10)))
    if not c.isalnum():
        return ""
    kind, first, script = unicodedata.category(c), ord(c) & ~255, unicodedata.name(c, "").split(" ")[0]
    same = (chr(i) for i in range(first, first + 256))
    return "".join(x for x in same if unicodedata.category(x) == kind and unicodedata.name(x, "").split(" ")[0] == script and x not in _CLASS and x.upper().lower() == x and small(x) == x)


def _walked(key: bytes, kind: str, s: str, places: list[tuple[int, tuple | str]], same) -> str:
    """s with the parts at ``places`` (start, values of one length) moved along the cycle of all their values until ``same`` gives
    what it gives for s."""
    places = [(i, values) for i, values in places if len(values) > 1 and s[i : i + len(values[0])] in values]
    if not places:
        return s
    total = math.prod(len(values) for _, values in places)
    frame, at = [], 0
    for i, values in places:
        frame += [s[at:i], f"<{values[0]}{len(values)}>"]
        at = i + len(values[0])
    step, want, value = Cycle(key, f"{kind}|{''.join(frame)}{s[at:]}", total), same(s), 0
    for i, values in places:
        value = value * len(values) + values.index(s[i : i + len(values[0])])
    while True:
        value = step(value)
        rest, out = value, list(s)
        for i, values in reversed(places):
            rest, d = divmod(rest, len(values))
            out[i : i + len(values[0])] = values[d]
        if same(now := "".join(out)) == want:
            return now


def permuted(key: bytes, kind: str, s: str, same=lambda s: True) -> str:
    """Small characters permuted within their classes."""
    return _walked(key, kind, s, [(i, _alphabet(c)) for i, c in enumerate(s)], same)


def _recased(original: str, new: str) -> str:
    return "".join(n.upper() if o.isupper() and len(n.upper()) == 1 else n for o, n in zip(original, new, strict=True))


def _refill(original: str, new: str) -> str:
    """The digits and letters of ``new`` in the places of those of ``original``, digits in the script of the original's."""
    it, out = iter(new), []
    for c in original:
        n = next(it) if c.isalnum() else c
        out.append(chr(ord(c) - int(c) + int(n)) if c.isdecimal() and n.isdecimal() else n)
    return "".join(out)


def _digits(s: str) -> str:
    return "".join(str(int(c)) for c in s if c.isdecimal())


def normal(kind: str, s: str) -> str:
    """What two mentions of one entity have in common."""
    if kind in ("email", "ipv6", "name"):
        return small(s)
    if kind in ("card", "ssn"):
        return _digits(s)
    if kind == "phone":
        d = _digits(s)
        return d[-10:] if len(d) > 10 else d
    if kind == "iban":
        return re.sub(r"\W", "", s).upper()
    return str(ipaddress.IPv4Address(_ascii(s))) if kind == "ip" else s


def _ascii(s: str) -> str:
    return "".join(str(int(c)) if c.isdecimal() else c for c in s)


# Special networks of IPv4 and prefixes of IPv6.
_NETWORKS = "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.88.99.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4"
_SPECIAL_V6 = ("fe8", "fe9", "fea", "feb", "fc", "fd", "ff")
_SPECIAL = [(int(n[0]), n.num_addresses) for n in map(ipaddress.IPv4Network, _NETWORKS.split())]
_ORDINARY: list[tuple[int, int]] = []  # (first address, how many ordinary ones lie before it)
for _start, _size in [(-1, 1), *_SPECIAL]:
    _before = _start + _size
    _next = min((a for a, _ in _SPECIAL if a >= _before), default=1 << 32)
    if _next > _before:
        _ORDINARY.append((_before, _next - _before))
_FIRST = [a for a, _ in _ORDINARY]
_SHIFT = [sum(n for _, n in _ORDINARY[:i]) for i in range(len(_ORDINARY))]


def _address(key: bytes, n: int) -> int:
    """Another address of the same special network, or another ordinary one."""
    for start, size in _SPECIAL:
        if start <= n < start + size:
            return start + Cycle(key, f"ip|{start}", size)(n - start)
    i = bisect_right(_FIRST, n) - 1
    at = Cycle(key, "ip", sum(m for _, m in _ORDINARY))(n - _FIRST[i] + _SHIFT[i])
    i = bisect_right(_SHIFT, at) - 1
    return _FIRST[i] + at - _SHIFT[i]


def _given(key: bytes, word: str) -> str:
    group, i = _GIVEN[word.lower()]
    new = GIVEN[group][Cycle(key, f"given|{group}", len(GIVEN[group]))(i)]
    return new.upper() if word.isupper() and len(word) > 1 else new


_VOWELS = frozenset("aeiou")
_LATIN_RUN = re.compile(r"[aeiou]+|[bcdfghjklmnpqrstvwxyz]+")


def _runs(word: str) -> list[tuple[int, str, tuple]]:
    """(start, run of consonants or vowels, the usual clusters of its place and length; none if it isn't one) of a small word."""
    out = []
    for m in _LATIN_RUN.finditer(word):
        place = "vowels" if m[0][0] in _VOWELS else "first" if m.start() == 0 else "last" if m.end() == len(word) else "inside"
        usual = tuple(c for c in _CLUSTERS[place] if len(c) == len(m[0]))
        out.append((m.start(), m[0], usual if m[0] in usual and len(usual) > 1 else ()))
    return out


def _surname(key: bytes, word: str) -> str:
    low = small(word)
    runs = _runs(low)
    places = [(i, usual) for i, _, usual in runs if usual]
    taken = {i + k for i, run, usual in runs if usual for k in range(len(run))}
    places += [(i, _alphabet(c)) for i, c in enumerate(low) if i not in taken]
    shape = lambda s: (s in _GIVEN, [(i, len(run), bool(usual)) for i, run, usual in _runs(s)])
    return _recased(word, _walked(key, f"surname|{[(i, len(r)) for i, r, u in runs if u]}", low, sorted(places), shape))


@lru_cache(maxsize=50_000)
def surrogate(kind: str, s: str, key: bytes = KEY) -> str:
    """The replacement of an entity as it is written."""
    if kind == "email":
        head, _, tail = small(s).rpartition(".")
        return _recased(s, f"{permuted(key, 'email.' + tail, head)}.{tail}")
    if kind == "card":
        d = normal(kind, s)
        off = (int(d[-1]) - _luhn(d[:-1])) % 10
        body = d[0] + permuted(key, f"card{d[0]}{off}", d[1:-1])
        return _refill(s, body + str((_luhn(body) + off) % 10))
    if kind == "phone":
        d, own = _digits(s), normal(kind, s)
        lead = lambda x: 2 if x[0] > "1" else int(x[0])
        return _refill(s, d[: len(d) - len(own)] + permuted(key, "phone", own, lead))
    if kind == "ssn":
        ok = lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"
        return _refill(s, permuted(key, kind, normal(kind, s), ok))
    if kind == "ip":
        return str(ipaddress.IPv4Address(_address(key, int(ipaddress.IPv4Address(_ascii(s))))))
    if kind == "ipv6":
        groups = small(s).split(":")
        special = lambda g: next((p for p in _SPECIAL_V6 if len(g) == 4 and g.startswith(p)), "")
        kept = groups[0] if special(groups[0]) else ""
        digits = "".join(groups)[len(kept) :]
        frame, first = ":".join(str(len(g)) for g in groups), len(groups[0])
        step = Cycle(key, f"ipv6|{kept}|{frame}", 16 ** len(digits))
        value = int(digits, 16)
        while True:
            value = step(value)
            new = kept + f"{value:0{len(digits)}x}"
            if kept or not special(new[:first]):
                break
        it = iter(new)
        return _recased(s, "".join(next(it) if c != ":" else c for c in s))
    if kind == "iban":
        d = normal(kind, s)
        body = _recased(d[4:], permuted(key, "iban" + d[:2], d[4:].lower()))
        check = 98 - int("".join(str(int(c, 36)) for c in body + d[:2] + "00")) % 97
        return _refill(s, f"{d[:2]}{check:02d}{body}")
    if s[-2:] in _HAN_GIVEN:
        surnames = _HAN_SURNAMES[len(s) > 3]
        return surnames[Cycle(key, f"surname|han{len(s)}", len(surnames))(surnames.index(s[:-2]))] + _given(key, s[-2:])
    words = s.split(" ")
    out = [w if w.rstrip(".") in _TITLES else _given(key, w) if w.lower() in _GIVEN else _surname(key, w) for w in words]
    return " ".join(out)


def replaced(text: str, key: bytes = KEY) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with surrogates, and (start, end, kind, surrogate) by place in the original."""
    out, at, spans, taken, chosen = [], 0, [], {}, {}
    for a, b, kind in find(text):
        old = text[a:b]
        own = (kind, normal(kind, old))
        new = surrogate(kind, old, key)
        for _ in range(chosen.get(own, 0)):
            new = surrogate(kind, new, key)
        while taken.setdefault((kind, normal(kind, new)), own) != own:  # taken by another entity
            chosen[own] = chosen.get(own, 0) + 1
            new = surrogate(kind, new, key)
        out += [text[at:a], new]
        spans.append((a, b, kind, new))
        at = b
    return "".join([*out, text[at:]]), spans


def surrogates(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, text with surrogates, entities array<struct<start, end, kind, surrogate>>: a row for each of ``docs``."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("surrogate", pa.string())]))

    def run(batches):
        for b in (part for batch in batches for part in pieces(batch)):
            done = [(None, []) if t is None else replaced(t, key) for t in b.column("text").to_pylist()]
            spans = [[dict(zip(("start", "end", "kind", "surrogate"), x, strict=True)) for x in s] for _, s in done]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([t for t, _ in done], pa.string()), pa.array(spans, kind)], names=["doc_id", "text", "entities"])

    schema = "doc_id long, text string, entities array<struct<start: long, `end`: long, kind: string, surrogate: string>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def collisions(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """Surrogates that stand for more than one entity of the corpus, with how many: always empty."""

    def run(batches):
        for b in (part for batch in batches for part in pieces(batch)):
            rows = {(k, normal(k, t[x:y]), normal(k, surrogate(k, t[x:y], key))) for t in b.column("text").to_pylist() if t for x, y, k in find(t)}
            c = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in c], names=["kind", "entity", "surrogate"])

    pairs = docs.select("text").mapInArrow(run, "kind string, entity string, surrogate string").distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("entities")).where("entities > 1")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_entities, spans (kind:start:end in the original), text with surrogates."""
    spelled = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["end"].cast("string"))), ",")
    return surrogates(table(spark, sf_dir, "documents")).select("doc_id", F.size("entities").cast("long").alias("n_entities"), spelled.alias("spans"), "text")
