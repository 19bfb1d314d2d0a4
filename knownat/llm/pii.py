"""Format-preserving pseudonyms for personal data: a keyed Feistel permutation of each format.

A value is found by pattern, validated (check digits, address ranges, calendar; phones by shape)
and read as its rank among the valid values of its format, a number of mixed radixes.  A keyed
Feistel network permutes the ranks, and the new value is written in the shape of the old one, so
every outcome is valid.  Punctuation, padding and case are no part of the rank: a value written
in two ways gets one pseudonym in two shapes.  (A month-first date holds only days after the 12th,
or it would read day first; it is permuted on until it is one.)  Equal values stay linked in every
document, different values differ, and the key holder can undo them.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownat.llm.common import prepare

ROUNDS = 8
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz")


def _round(key: bytes, tweak: bytes, number: int, side: Sequence[int], bound: int) -> int:
    said = b"|".join([tweak, str(number).encode(), ",".join(map(str, side)).encode()])
    return int.from_bytes(hashlib.blake2b(said, key=key, digest_size=16).digest(), "big") % bound


def _number(digits: Sequence[int], radixes: Sequence[int]) -> int:
    value = 0
    for digit, radix in zip(digits, radixes, strict=True):
        value = value * radix + digit
    return value


def _digits(value: int, radixes: Sequence[int]) -> list[int]:
    found = []
    for radix in reversed(radixes):
        value, digit = divmod(value, radix)
        found.append(digit)
    return found[::-1]


def permute(
    digits: Sequence[int], radixes: Sequence[int], key: bytes, tweak: bytes, undo: bool = False
) -> list[int]:
    """Keyed bijection of mixed-radix numbers: halves are shifted in turn by a hash of the other."""
    middle = len(digits) // 2
    parts = [list(digits[:middle]), list(digits[middle:])]
    bases = [list(radixes[:middle]), list(radixes[middle:])]
    sizes = [_number([r - 1 for r in b], b) + 1 for b in bases]
    for number in reversed(range(ROUNDS)) if undo else range(ROUNDS):
        mine, other = number % 2, 1 - number % 2
        shift = _round(key, tweak, number, parts[other], sizes[mine])
        moved = _number(parts[mine], bases[mine]) + (-shift if undo else shift)
        parts[mine] = _digits(moved % sizes[mine], bases[mine])
    return parts[0] + parts[1]


def luhn(text: str) -> bool:
    digits = [int(c) for c in reversed(text) if c.isdigit()]
    return sum(digits[::2] + [sum(divmod(2 * d, 10)) for d in digits[1::2]]) % 10 == 0


def _address(text: str) -> bool:
    return all(int(part) < 256 and (part == "0" or part[0] != "0") for part in text.split("."))


def _ipv6(text: str) -> bool:
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return sum(map(bool, text.split(":"))) > 2


def _iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and _mod97(plain[4:] + plain[:4]) == 1


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _calendar(text: str) -> bool:
    return _reading(text) is not None


_FIRST, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days
_ORDERS = ("ymd", "dmy", "mdy")


def _reading(text: str) -> tuple[str, date] | None:
    """Order of the parts and the day: with the year first, or else day first, or month first."""
    parts = re.split(r"[-/.]", text)
    for order in _ORDERS[:1] if len(parts[0]) == 4 else _ORDERS[1:]:
        named = dict(zip(order, map(int, parts), strict=True))
        try:
            day = date(named["y"], named["m"], named["d"])
        except ValueError:
            continue
        return (order, day) if 0 <= (day - _FIRST).days < _DAYS else None
    return None


def _always(text: str) -> bool:
    return True


#: (digits, radixes, tweak) of a value.
Rank = tuple[list[int], list[int], str]


@dataclass(frozen=True)
class Kind:
    """How a kind of value looks, what makes it valid, and its rank, read and written."""

    name: str
    pattern: str
    valid: Callable[[str], bool]
    read: Callable[[str], Rank]
    write: Callable[[str, list[int]], str | None]


def _places(text: str) -> list[int]:
    return [i for i, c in enumerate(text) if c.isdigit()]


def _put(text: str, places: Sequence[int], characters: Sequence[str]) -> str:
    letters = list(text)
    for i, c in zip(places, characters, strict=True):
        letters[i] = c
    return "".join(letters)


def _letters_read(text: str) -> Rank:
    """Letters and digits by class, whatever the letters' case; other characters are shape."""
    digits, radixes, shape = [], [], []
    for c in text.lower():
        alphabet = _ALPHABETS[c.isalpha()]
        if c in alphabet:
            digits.append(alphabet.index(c))
            radixes.append(len(alphabet))
        shape.append("01"[c.isalpha()] if c in alphabet else c)
    return digits, radixes, "".join(shape)


def _letters_write(text: str, digits: list[int]) -> str:
    places = [i for i, c in enumerate(text.lower()) if c in _ALPHABETS[c.isalpha()]]
    made = []
    for i, d in zip(places, digits, strict=True):
        c = _ALPHABETS[text[i].isalpha()][d]
        made.append(c.upper() if text[i].isupper() else c)
    return _put(text, places, made)


def _email_read(text: str) -> Rank:
    return _letters_read(text[: text.index("@")])


def _email_write(text: str, digits: list[int]) -> str:
    at = text.index("@")
    return _letters_write(text[:at], digits) + text[at:]


def _card_read(text: str) -> Rank:
    digits = [int(text[i]) for i in _places(text)[:-1]]
    return digits, [10] * len(digits), str(len(digits))


def _card_write(text: str, digits: list[int]) -> str:
    body = "".join(map(str, digits))
    check = next(c for c in "0123456789" if luhn(body + c))
    return _put(text, _places(text), body + check)


def _phone_places(text: str) -> list[int]:
    """Digits that may change: a number of the +1 plan keeps its country, others two digits."""
    places = _places(text)
    national = len(places) == 10 or (len(places) == 11 and text[places[0]] == "1")
    return places[-10:] if national else places[2:]


def _phone_read(text: str) -> Rank:
    places = _phone_places(text)
    digits = [int(text[i]) for i in places]
    kept = "" if len(places) == 10 and text.lstrip("+")[0] in "1(" else "".join(
        text[i] for i in _places(text)[: -len(places)]
    )
    return digits, [10] * len(digits), kept


def _phone_write(text: str, digits: list[int]) -> str:
    return _put(text, _phone_places(text), list(map(str, digits)))


def _abroad(text: str) -> bool:
    return 8 <= len(_places(text)) <= 15 and text.count("(") == text.count(")")


_OCTETS = {1: (0, 10), 2: (10, 90), 3: (100, 156)}


def _ip_read(text: str) -> Rank:
    lengths = [len(p) for p in text.split(".")]
    digits = [int(p) - _OCTETS[n][0] for p, n in zip(text.split("."), lengths, strict=True)]
    return digits, [_OCTETS[n][1] for n in lengths], str(lengths)


def _ip_write(text: str, digits: list[int]) -> str:
    return ".".join(
        str(d + _OCTETS[len(p)][0]) for p, d in zip(text.split("."), digits, strict=True)
    )


def _groups(text: str) -> list[tuple[int, int]]:
    """(place among the eight, value) of the groups that are not zero."""
    words = ipaddress.IPv6Address(text).exploded.split(":")
    return [(i, int(w, 16)) for i, w in enumerate(words) if int(w, 16)]


def _ipv6_read(text: str) -> Rank:
    groups = [(i, v, len(f"{v:x}")) for i, v in _groups(text)]
    digits = [v - 16 ** (n - 1) for _, v, n in groups]
    return digits, [15 * 16 ** (n - 1) for *_, n in groups], str([(i, n) for i, _, n in groups])


def _ipv6_write(text: str, digits: list[int]) -> str:
    made = {i: d + 16 ** (len(f"{v:x}") - 1) for (i, v), d in zip(_groups(text), digits, strict=True)}
    words = text.split(":")
    gap = next((i for i, w in enumerate(words) if not w and 0 < i < len(words) - 1), len(words))
    places = [i if i < gap else 8 - len(words) + i for i in range(len(words))]
    upper = any(c in "ABCDEF" for c in text)
    done = [
        w if not w or p not in made else f"{made[p]:{'X' if upper else 'x'}}".zfill(len(w))
        for w, p in zip(words, places, strict=True)
    ]
    return ":".join(done)


def _iban_read(text: str) -> Rank:
    plain = text.replace(" ", "")
    digits, radixes, shape = _letters_read(plain[4:])
    return digits, radixes, plain[:2] + shape


def _iban_write(text: str, digits: list[int]) -> str:
    plain = text.replace(" ", "")
    body = _letters_write(plain[4:], digits)
    check = 98 - _mod97(body + plain[:2] + "00")
    places = [i for i, c in enumerate(text) if c != " "]
    return _put(text, places, list(f"{plain[:2]}{check:02d}{body}"))


_DATE_RADIXES = [271, 270]


def _date_read(text: str) -> Rank:
    rank = (_reading(text)[1] - _FIRST).days
    return _digits(rank, _DATE_RADIXES), _DATE_RADIXES, ""


def _date_write(text: str, digits: list[int]) -> str | None:
    """None beyond the calendar, and where a month-first day would read day first."""
    rank, order = _number(digits, _DATE_RADIXES), _reading(text)[0]
    if rank >= _DAYS:
        return None
    day = _FIRST + timedelta(days=rank)
    if order == "mdy" and day.day <= 12:
        return None
    values = {"y": day.year, "m": day.month, "d": day.day}
    parts, seps = re.split(r"[-/.]", text), re.findall(r"[-/.]", text)
    padded = all(len(p) > 1 for p in parts)
    made = [f"{values[c]:02d}" if padded else str(values[c]) for c in order]
    return made[0] + seps[0] + made[1] + seps[1] + made[2]


_AREAS = [a for a in range(1, 900) if a != 666]


def _ssn_read(text: str) -> Rank:
    a, g, n = map(int, text.split("-"))
    return [_AREAS.index(a), g - 1, n - 1], [len(_AREAS), 99, 9999], ""


def _ssn_write(text: str, digits: list[int]) -> str:
    return f"{_AREAS[digits[0]]:03d}-{digits[1] + 1:02d}-{digits[2] + 1:04d}"


#: Searched in this order; what one kind has taken no later one takes.
KINDS = (
    Kind("email", r"(?<![\w.+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])", _always, _email_read, _email_write),
    Kind("iban", r"(?<![\w.+-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w-])", _iban, _iban_read, _iban_write),
    Kind("card", r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)", luhn, _card_read, _card_write),
    Kind("phone", r"(?<![\w.])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])", _always, _phone_read, _phone_write),
    Kind("phone", r"(?<![\w.+])\+[1-9]\d{0,2}(?:[ .-]?\(?\d{1,5}\)?){1,6}(?![\w-]|\.\d)", _abroad, _phone_read, _phone_write),
    Kind("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w-]|\.\d)", _address, _ip_read, _ip_write),
    Kind("ipv6", r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])", _ipv6, _ipv6_read, _ipv6_write),
    Kind("date", r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}([./-])\d{1,2}\1\d{4})(?![\w-]|[./]\d)", _calendar, _date_read, _date_write),
    Kind("ssn", r"(?<![\w.-])(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-]|\.\d)", _always, _ssn_read, _ssn_write),
)
_FINDERS = [(kind, re.compile(kind.pattern, re.ASCII)) for kind in KINDS]
#: What every value holds: an at sign, two digits close together, or a colon after a hex digit.
_ANY = re.compile(r"@|\d\D{0,2}\d|[0-9A-Fa-f]:")


@lru_cache(maxsize=1 << 16)
def pseudonym(name: str, value: str, key: bytes, undo: bool = False) -> str:
    """The valid value of the same format that stands for ``value``; ``undo`` inverts it."""
    kind = next(k for k in KINDS if k.name == name and re.fullmatch(k.pattern, value, re.ASCII))
    digits, radixes, tweak = kind.read(value)
    found = None
    while found is None:  # at once, but for some dates
        digits = permute(digits, radixes, key, f"{kind.name}:{tweak}".encode(), undo)
        found = kind.write(value, digits)
    return found


def pseudonymise(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The text with every validated value replaced, and how many of each kind there were."""
    counts: dict[str, int] = {}
    if not _ANY.search(text):
        return text, counts
    spans: list[tuple[int, int, str]] = []
    for kind, finder in _FINDERS:
        if kind.name == "email" and "@" not in text:
            continue
        for match in finder.finditer(text):
            if not kind.valid(match[0]):
                continue
            if any(a < match.end() and match.start() < b for a, b, _ in spans):
                continue
            spans.append((match.start(), match.end(), kind.name))
            counts[kind.name] = counts.get(kind.name, 0) + 1
    parts, upto = [], 0
    for start, end, name in sorted(spans):
        parts += [text[upto:start], pseudonym(name, text[start:end], key)]
        upto = end
    return "".join([*parts, text[upto:]]), counts


def pseudonymise_documents(
    docs: DataFrame, key: bytes, *, id_column: str = "doc_id", text_column: str = "text",
    only_found: bool = False,
) -> DataFrame:
    """(doc_id, text, n_found, kinds): texts with pseudonyms and findings per kind.

    Every row gives a row (``only_found``: rows with a finding); a null text stays null, an empty
    one empty, both without findings.  Repeated rows and values give the same pseudonyms.  A
    value whose check fails is not personal data and stays.  Other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long"), F.col(text_column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [
                (None, {}) if text is None else pseudonymise(text, key)
                for text in batch.column(1).to_pylist()
            ]
            result = pa.record_batch(
                [
                    batch.column(0),
                    pa.array([text for text, _ in done], pa.string()),
                    pa.array([sum(counts.values()) for _, counts in done], pa.int64()),
                    pa.array(
                        [sorted(counts.items()) for _, counts in done],
                        pa.map_(pa.string(), pa.int64()),
                    ),
                ],
                ["doc_id", "text", "n_found", "kinds"],
            )
            if only_found:
                result = result.filter(pa.array([bool(counts) for _, counts in done]))
            yield result

    return rows.mapInArrow(run, "doc_id long, text string, n_found long, kinds map<string,bigint>")
