"""Numeric integrity of a translation: the numbers an English and a Chinese text name, as multisets, and how they compare.

Tokens are ``number:<decimal>``, ``quarter:<1-4>`` and ``identifier:<name>``. The tables of :mod:`numerals` say in which order expressions are read. Each
line passes over the text once, from left to right; what it reads is taken out, so that later lines don't read it again. So the work grows with the text's
length. Decimals are exact (no floats)."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Callable, Iterator
from decimal import Decimal
from functools import cache, lru_cache
from re import _constants as op
from re import _parser as parser
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from scriptorium.functions import numerals as t

UNITS = t.WORDS[1:11]
WORD_VALUE = {w: i for i, w in enumerate(t.WORDS)} | {w: 10 * (i + 2) for i, w in enumerate(t.TENS)}
either = "|".join
#: A sign counts where no digit, per cent, dash or name stands before it: else it is a range or part of a name.
SIGN = rf"(?:(?<![A-Za-z{t.ELEMENTS}])(?<![\d%–—-]\s*)[-+])?"
DIGITS = rf"{SIGN}\d+(?:,\d{{3}})*(?:\.\d+)?"
SCALE, HAN_SCALE = either(t.SCALES), either(sorted(t.HAN_SCALES, key=len, reverse=True))
SMALL = either(sorted([*WORD_VALUE], key=len, reverse=True))
#: Cardinals of two words and more, or above ten, with scales: "twenty six", "one hundred and five", "five million".
CARDINAL = rf"(?:(?:{either(UNITS)}|a) hundred(?: (?:and )?(?:{SMALL})(?:[- ](?:{either(UNITS[:9])}))?)?|(?:{either(t.TENS)})[- ](?:{either(UNITS[:9])})|(?:{either([*t.TENS, *t.WORDS[11:]])}))(?: (?:{SCALE}))?|(?:{either(UNITS)}) (?:{SCALE})".replace(" ", r"\s+")
HAN_ONES = "[一二两三四五六七八九]"
HAN_NUMERAL = rf"(?<![零〇一二两三四五六七八九十百千万亿几数多第])(?:{HAN_ONES}?十{HAN_ONES}|{HAN_ONES}[十百千](?:[零〇一二两三四五六七八九十百千])*)(?:万亿|[万亿])?|(?<![零〇一二两三四五六七八九十百千万亿几数多第])(?!一万个?一){HAN_ONES}(?:百万|千万|万亿|[万亿])"
VALUES = {
    "w": either(UNITS),
    "o": either(t.ORDINALS),
    "q": either([*UNITS[:4], "[1-4]"]),
    "f": either([*t.ORDINALS[:4], "1st", "2nd", "3rd", "4th"]),
    "y": either(t.DECADES),
    "r": either(sorted(t.ROMANS, key=len, reverse=True)),
    "p": either([*t.PARTS, "fourth"]),
    "d": DIGITS,
    "c": CARDINAL,
    "s": SCALE,
    "l": either(sorted(t.LETTER_SCALES, key=len, reverse=True)),
    "h": r"[一二两三四五六七八九十]+|\d+",
    "k": "[一二两三四五六七八九十]",
    "z": "万亿|千亿|百亿|十亿|亿|千万|百万|十万|万|千|百|十",
    "u": HAN_NUMERAL,
}


def plain(value: Decimal) -> str:
    text = format(value.normalize(), "f")
    return "0" if text in ("-0", "") else text


def number(value: Decimal | int | str, power: int = 0) -> str:
    value = Decimal(value.replace(",", "").lstrip("+")) if isinstance(value, str) else Decimal(value)
    return f"number:{plain(value.scaleb(power) if value else value)}"


def cardinal(words: str) -> Decimal:
    total = part = Decimal(0)
    for word in regex.split(r"[\s-]+", words.lower()):
        if word == "hundred":
            part *= 100
        elif word in t.SCALES:
            total, part = total + part.scaleb(t.SCALES[word]), Decimal(0)
        elif word != "and":
            part += 1 if word == "a" else WORD_VALUE[word]
    return total + part


def han(text: str) -> Decimal:
    """A Chinese numeral, or digits."""
    if text.isdigit() and text.isascii():
        return Decimal(text)
    power = next((p for s, p in (("万亿", 12), ("亿", 8), ("万", 4)) if text.endswith(s)), 0)
    text = text.removesuffix("万亿").removesuffix("亿").removesuffix("万") if power else text
    total, digit = 0, None
    for c in text:
        if c in t.HAN_UNITS:
            total += (1 if digit is None else digit) * 10 ** t.HAN_UNITS[c]
            digit = 0
        else:
            digit = t.HAN_DIGITS[c]
    return Decimal(total + (digit or 0)).scaleb(power)


def value_of(kind: str, text: str) -> Decimal:
    low = text.lower()
    if kind in "wc":
        return cardinal(text)
    if kind == "o":
        return Decimal(t.ORDINALS.index(low) + 1)
    if kind in "qf":
        return Decimal(low[0] if low[0].isdigit() else t.ORDINALS.index(low) + 1 if low in t.ORDINALS else WORD_VALUE[low])
    if kind == "y":
        return Decimal(10 * (t.DECADES.index(low) + 2))
    if kind == "r":
        return Decimal(t.ROMANS[text.upper()])
    if kind == "p":
        return Decimal(4 if low in ("quarter", "fourth") else {"half": 2}.get(low) or t.ORDINALS.index(low) + 1)
    if kind == "z":
        return Decimal(10) ** t.HAN_SCALES.get(text, t.HAN_UNITS.get(text, 0))
    return han(text) if kind in "hku" or not PLAIN.match(text) else Decimal(text.replace(",", "").lstrip("+"))


def compiled(template: str, english: bool, flags: int = regex.I) -> tuple[regex.Pattern, list[str]]:
    """The pattern of a template, and the kinds of its groups ('' for plain ones)."""
    template = template.replace("&amp;", "\0")
    read, _, ahead = template.partition("&")
    kinds = [m[1] or "" for m in regex.finditer(r"<(\w)>|\((?!\?)", read) if not read[: m.start()].endswith("\\")]
    out = read + (f"(?={ahead}{r'(?!\w)' if english else ''})" if ahead else r"(?!\w)" if english else "")
    out = regex.sub(r"<(\w)>", lambda m: f"({VALUES[m[1]]})", out.replace("~", r"\s*").replace(" ", r"\s+").replace("[-\\s+]", r"[-\s]"))
    out = f"(?<![\\w.])(?:{out})" if english and not read.startswith(("[", "\\d", "(?:\\d", "(\\d", "<d>")) else out
    return regex.compile(out.replace("\0", "&"), flags), kinds


def lines(table: str) -> list[list[str]]:
    return [[x.strip() for x in line.split(" | ", 1)] for line in table.strip().splitlines()]


def reader(what: str, kinds: list[str]) -> Callable[[regex.Match], list[str]]:
    """What a match of a line gives."""
    name, _, given = what.partition("=")

    def read(m: regex.Match) -> list[str]:
        found = [(kind, text) for kind, text in zip(kinds, m.groups()) if text is not None]
        power = sum(t.SCALES[x.lower()] if k == "s" else t.LETTER_SCALES[x.lower()] for k, x in found if k in ("s", "l"))
        values = [value_of(k or "d", x) for k, x in found if k not in ("s", "l")]
        if name == "id":
            return [f"identifier:{given}"]
        if given:
            return [number(v, power) for v in given.split(",")]
        if name == "q":
            return [f"quarter:{plain(v)}" for v in values]
        if name == "n.":
            return [number(f"{plain(values[0])}.{plain(values[1])}", power)]
        if name == "n*tens":
            return [number(10, power)]
        if name == "over":
            values.reverse()
        if name == "twice":
            values *= 2
        step = name.partition("*")[2]
        return [number(v + (name == "n+1"), power + int(step or 0)) for v in values]

    return read


def month(m: regex.Match, text: str) -> int | None:
    """The number of a month's name where a date is meant: May and March are verbs and names too, and short names need a day or year beside them."""
    name, before, after = m[1].lower(), text[max(0, m.start() - 28) : m.start()], text[m.end() : m.end() + 28]
    leads = regex.search(rf"\b(?:{DATE_LEADS})\s+$", before, regex.I)
    if name == "may":
        modal = m[1] == "may" and (regex.search(r"\b(?:this|it|that|we|you|they|i|he|she|who|which)\s+$", before, regex.I) and not regex.match(r"\s*[,./\d-]", after) or regex.match(r"\s+\d", after) and not leads)
        # A capitalised word behind it makes it a first name, unless a month is asked for before it.
        first_name = regex.match(r"\s+\p{Lu}\p{Ll}", after) and not (leads and leads[0].split()[0].lower() != "on")
        if modal or first_name or regex.match(r"\s+(?:be|have|not)\b", after, regex.I):
            return None
    if m[1] == "march" and regex.search(r"\bto\s+$", before, regex.I):
        return None
    beside = regex.search(r"\d{1,2}(?:st|nd|rd|th)?(?:\s+of)?\s*$", before, regex.I) or regex.match(r"\s*(?:of\s+)?\d{1,4}(?:st|nd|rd|th)?\b", after, regex.I)
    full = name in t.MONTHS
    if beside or full and (leads or regex.match(r"\s*(?:last|next|this)\b", after, regex.I)):
        return t.SHORT_MONTHS.index(name[:3]) + 1
    return None


# Words before a date.
DATE_LEADS = "in|on|since|by|until|through|during|from|to|last|next|this|early|late|mid|of|after|before"
MONTH = regex.compile(rf"\b({either([*t.MONTHS, 'sept', *t.SHORT_MONTHS])})\b\.?", regex.I)
THOUSANDS_3 = regex.compile(r"(?<![\d,])\b(\d{1,3})(?:\s*(?:or|and|或|和|、)\s*|,\s+)(\d{1,3})(?:\s*(?:or|and|或|和|、)\s*|,\s+)(\d{1,3}),000\b", regex.I)
THOUSANDS_2 = regex.compile(r"(?<![\d,])\b(\d{1,3})\s*(?:(?:or|to|and|或|至|到|和)\s*|,\s+)(\d{1,3}),000\b(?!\s*(?:%|percent\b|美元|欧元|英镑|日元|元))", regex.I)
LABEL = regex.compile(r"\b([A-Za-z]+)(\d+)(?![A-Za-z0-9])")
SPLIT_COMMA = regex.compile(r"\b(\d{1,3}),\s+(\d{3})\b")
LABELLED, DIGIT = regex.compile(r"[A-Za-z]\d"), regex.compile(r"\d")
FINAL = regex.compile(rf"(?:{SIGN}\d+(?:,\d{{3}})*(?:\.\d+)?|{SIGN}\.\d+)\s*({SCALE}|(?!千[{t.PREFIXED}])(?:{HAN_SCALE}))?", regex.I)


#: Characters that case folding makes equal to an ASCII letter; texts with one are met by every line.
FOLDED = frozenset("\u017f\u212a\u0130\u0131")
#: Characters of a class that are listed one by one, and words of a pattern that are; what stands before pieces of words.
LISTED, MOST_WORDS, LOOSE = 64, 10_000, "~"
#: A text's words from its UTF-8: letters in lower case, all else a space; and what is no mark of it.
WORDS_ONLY = bytes(c | 32 if chr(c).isalpha() and c < 128 else 32 for c in range(256))
NO_MARKS = bytes(c for c in range(128) if chr(c).isalpha() or chr(c).isspace())


def grams(text: str) -> set[str] | None:
    """What a text has of what lines need: its marks (all but letters and spaces), ``\\d`` for any digit, and words that lines spell; None: unknown."""
    data = text.encode("utf-8", "surrogatepass")
    rest = data.translate(None, NO_MARKS).decode("utf-8", "surrogatepass")
    found = set(rest)
    if not rest.isascii():
        if found & FOLDED:
            return None
        found.update(rest.lower())
    if any(map(str.isdecimal, found)):
        found.add("\\d")
    words, loose = spelled()
    data = data.translate(WORDS_ONLY)
    found.update([words[x] for x in words.keys() & data.split()])
    found.update([piece for x, piece in loose if x in data])
    return found


def members(x: list) -> list[str] | None:
    """The characters of a class, ``\\d`` for digits and a space for any space; None: it isn't listed."""
    out = []
    for kind, y in x:
        if kind is op.LITERAL:
            out.append(chr(y))
        elif kind is op.RANGE and y[1] - y[0] < LISTED:
            out.extend(map(chr, range(y[0], y[1] + 1)))
        elif kind is op.CATEGORY and y in (op.CATEGORY_DIGIT, op.CATEGORY_SPACE):
            out.append("\\d" if y is op.CATEGORY_DIGIT else " ")
        else:
            return None
    return out


def needs(parts: object) -> list[frozenset[str]]:
    """Sets of pieces (letters that stand together, marks, ``\\d``); a text that a parsed pattern matches has one of each set."""
    out, run = [], ""

    def flush() -> None:
        nonlocal run
        out.extend(frozenset([piece]) for piece in regex.findall(r"[a-z]+|[^a-z\s]", run.lower()))
        run = ""

    for what, x in parts:
        if what is op.LITERAL:
            run += chr(x)
            continue
        flush()
        if what is op.SUBPATTERN:
            out += needs(x[3])
        elif what is op.ATOMIC_GROUP:
            out += needs(x)
        elif what is op.ASSERT:
            out += needs(x[1])
        elif what in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and x[0] > 0:
            out += needs(x[2])
        elif what is op.BRANCH:
            each = [needs(branch) for branch in x[1]]
            if all(each):  # the most telling set of each branch
                out.append(frozenset().union(*[min(sets, key=lambda g: (len(g), -min(map(len, g)))) for sets in each]))
        elif what is op.IN:
            chars = members(x)
            if chars and " " not in chars:
                out.append(frozenset(map(str.lower, chars)))
    flush()
    return out


class Spelled(NamedTuple):
    """The runs of letters in what a part of a pattern matches, ``*`` for letters that aren't known: all of it, before the first other character,
    after the last one, and between two."""

    alone: frozenset[str]
    first: frozenset[str] = frozenset()
    last: frozenset[str] = frozenset()
    between: frozenset[str] = frozenset()

    def __add__(self, other: Spelled) -> Spelled:
        out = Spelled(joined(self.alone, other.alone), self.first | joined(self.alone, other.first), other.last | joined(self.last, other.alone), self.between | other.between | joined(self.last, other.first))
        if max(map(len, out)) > MOST_WORDS:
            raise parser.PatternError("spells too many words")
        return out

    def __or__(self, other: Spelled) -> Spelled:
        return Spelled(*map(frozenset.union, self, other))

    def runs(self) -> frozenset[str]:
        return frozenset.union(*self) - {""}


def joined(a: frozenset[str], b: frozenset[str]) -> frozenset[str]:
    return frozenset((x + y).replace("**", "*") for x in a for y in b)


NOWHERE, NOTHING, OTHER = Spelled(frozenset()), Spelled(frozenset([""])), Spelled(frozenset(), frozenset([""]), frozenset([""]))
ANY = Spelled(*[frozenset(["", "*"])] * 3)


def one_of(chars: list[str]) -> Spelled:
    letters = [c.lower() for c in chars if c.isascii() and c.isalpha()]
    return Spelled(frozenset(letters)) | (OTHER if len(letters) < len(chars) else NOWHERE)


def repeated(once: Spelled, least: int, most: int) -> Spelled:
    if once.runs() <= {"*"}:
        out = once | once + once
    elif most <= 4:
        out = many = once
        for _ in range(most - 1):
            many += once
            out |= many
    else:
        out = ANY | Spelled(frozenset(), between=frozenset(f"*{run}*" for run in once.runs()))
    return out if least else out | NOTHING


def spells(parts: list) -> Spelled:
    """The runs of letters in what a parsed pattern matches."""
    out = NOTHING
    for i, (what, x) in enumerate(parts):
        if what is op.LITERAL:
            out += one_of([chr(x)])
        elif what is op.IN and (chars := members(x)) is not None:
            out += one_of(chars)
        elif what is op.SUBPATTERN:
            out += spells(x[3])
        elif what is op.ATOMIC_GROUP:
            out += spells(x)
        elif what is op.BRANCH:
            found = NOWHERE
            for branch in x[1]:
                found |= spells(branch)
            out += found
        elif what in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            out += repeated(spells(x[2]), x[0], x[1])
        elif what is op.AT:
            out += OTHER
        elif what is op.ASSERT_NOT:
            # Where no character of a word may stand a run ends.
            if len(x[1]) == 1 and x[1][0][0] is op.IN and x[1][0][1][0] == (op.CATEGORY, op.CATEGORY_WORD):
                out += OTHER
        elif what is op.ASSERT and x[0] < 0:
            out |= ANY + spells(x[1])
        elif what is op.ASSERT:  # what follows is read from the same place
            ahead = spells(x[1]) + ANY
            return out + (ahead | spells(parts[i + 1 :]) if len(parts) > i + 1 else ahead)
        else:
            out += ANY
    return out


class Need(NamedTuple):
    """What a text must have for a match of a pattern: one of each set of words, marks and pieces that may be part of other words (with ``~`` before them);
    and whether a match may begin or end inside a word."""

    sets: list[frozenset[str]]
    cuts: bool = True


def letters_of(piece: str) -> bool:
    return "a" <= piece[0] <= "z"


def needed(pattern: regex.Pattern) -> Need:
    """What a text must have for a match of the pattern; nothing where the pattern is of a kind that isn't parsed."""
    try:
        parsed = parser.parse(pattern.pattern)
        match = spells(parsed)
        runs = (ANY + match + ANY).runs()
    except parser.PatternError:
        return Need([])
    words = frozenset(run for run in runs if "*" not in run)
    parts = {part for run in runs if "*" in run for part in run.split("*")}
    within = lambda piece: {LOOSE + piece} if any(piece in x for x in parts) else {word for word in words if piece in word}
    found = {frozenset(x for piece in sets for x in (within(piece) if letters_of(piece) else [piece])) for sets in needs(parsed)}
    # Pieces of longer words are looked for where a line needs nothing else only.
    sure = {sets for sets in found if not any(x.startswith(LOOSE) for x in sets)} or found
    return Need(sorted(sure, key=lambda g: (len(g), -min(map(len, g)), sorted(g))), bool((match.alone | match.first | match.last) - {""}))


@cache
def spelled() -> tuple[dict[bytes, str], list[tuple[bytes, str]]]:
    """The words that lines need, and the pieces that they need whatever stands beside them, as they are found in a text."""
    every = [need for need, *_ in [*rules()[0], *rules()[1]]] + [needed_months()]
    wanted = {x for need in every for sets in need.sets for x in sets}
    return {x.encode(): x for x in wanted if letters_of(x)}, [(x[1:].encode(), x) for x in sorted(wanted) if x.startswith(LOOSE)]


@cache
def telling() -> str:
    """In RE2's syntax, what a text that names a number has: a digit, or one of the things of one set of some line's needs, those of number words first."""
    every = [need.sets for need, *_ in [*rules()[0], *rules()[1]]] + [needed_months().sets]
    if not all(every):
        return ""
    names = {*UNITS, *t.HAN_DIGITS, *t.HAN_UNITS}
    common = lambda x: x not in names and x.isascii() and not x.isdecimal() and x != "\\d" and len(x) < 5
    wanted = frozenset().union(*[min(sets, key=lambda g: (sum(map(common, g)), g.isdisjoint(names), len(g), sorted(g))) for sets in every])
    words, loose = [sorted(x for x in wanted if is_it(x)) for is_it in (letters_of, lambda x: x.startswith(LOOSE))]
    marks = [x for x in wanted - {*words, *loose, "\\d"}] + [c for c in map(chr, range(sys.maxunicode + 1)) if c.isdecimal()] + [*FOLDED]
    return either([rf"(?i:(?:^|[^a-z])(?:{either(words)})(?:$|[^a-z]))", *[f"(?i:{x[1:]})" for x in loose], "[" + "".join(rf"\x{{{ord(c):x}}}" for c in marks) + "]"])


def may_match(need: Need, has: set[str] | None) -> bool:
    if has is not None:
        for x in need.sets:
            if has.isdisjoint(x):
                return False
    return True


@cache
def rules() -> tuple[list, list]:
    """The compiled lines, with what they need: wordings as (need, pattern, text), readings as (need, pattern, reader)."""
    wordings = [(compiled(x, english)[0], " " if what == "-" else what[1:].strip() + " " * what.startswith(("> 同", "> \\1个"))) for table, english in ((t.WORDINGS, True), (t.HAN_WORDINGS, False)) for what, x in lines(table)]
    readings = []
    for table, english in ((t.READINGS, True), (t.HAN_READINGS, False)):
        for what, template in lines(table):
            pattern, kinds = compiled(template, english)
            readings.append((needed(pattern), pattern, reader(what, kinds)))
    return [(needed(pattern), pattern, text) for pattern, text in wordings], readings


@cache
def by_gram() -> tuple[dict[str, list[int]], frozenset[int]]:
    """The places of the lines (wordings, then readings) by the grams of the first thing that they need; and of those that need nothing."""
    places: dict[str, list[int]] = {}
    wordings, readings = rules()
    every = [need.sets for need, *_ in [*wordings, *readings]]
    for i, sets in enumerate(every):
        for gram in sets[0] if sets else ():
            places.setdefault(gram, []).append(i)
    return places, frozenset(i for i, sets in enumerate(every) if not sets)


def met(has: set[str] | None) -> set[int]:
    """The places of the lines that may match a text."""
    wordings, readings = rules()
    places, free = by_gram()
    if has is None:
        return set(range(len(wordings) + len(readings)))
    near = free.union(*[places[gram] for gram in has & places.keys()])
    return {i for i in near if may_match((wordings[i] if i < len(wordings) else readings[i - len(wordings)])[0], has)}


@cache
def needed_months() -> Need:
    return needed(MONTH)


@cache
def open_readings() -> list[regex.Pattern]:
    return [compiled(x, True)[0] for x in t.OPEN.strip().splitlines()] + [regex.compile(r"[’']\d{2}\b")]


@cache
def evidence(table: str) -> list[tuple[int, regex.Pattern]]:
    """Patterns with the times that each match counts."""
    out = []
    for line in table.strip().splitlines():
        times = 2 if line.startswith("2x ") else 1
        out.append((times, regex.compile(rf"\b(?:{line.removeprefix('2x ').replace(' ', r'\s+')})\b", regex.I)))
    return out


LEFT_OVER = regex.compile(rf"\b(?:{either(sorted({*t.LEFT_OVER, *t.MONTHS}, key=len, reverse=True))})\b", regex.I)


TELLING, HEAD, PLAIN = (regex.compile(x) for x in (r"[\d零〇一二两三四五六七八九十百千万亿半双倍翻数A-Za-z]", r"[-+\d.,]+", r"[-+\d.]"))


def analysed(text: str | None) -> tuple[list[str], str]:
    """(sorted tokens, rest of the text that nothing has read)."""
    rest, found = text or "", []
    if not TELLING.search(rest):
        return [], rest

    def over(pattern: regex.Pattern, read: Callable[[regex.Match], list[str] | None], keep: Callable[[regex.Match], str] = lambda m: " ") -> None:
        nonlocal rest

        def put(m: regex.Match) -> str:
            values = read(m)
            if values is None:
                return m[0]
            found.extend(values)
            return keep(m)

        rest = pattern.sub(put, rest)

    wordings, readings = rules()
    has = grams(rest)
    places = met(has)
    digits = has is None or "\\d" in has
    if digits and "," in rest and SPLIT_COMMA.search(rest):
        whole = rest
        rest = SPLIT_COMMA.sub(lambda m: joined if (joined := f"{m[1]},{m[2]}") in whole else m[0], rest)
    for i, (_, pattern, text_of) in enumerate(wordings if places else ()):
        if i in places:
            before, rest = rest, pattern.sub(text_of, rest)
            if rest != before:
                has = grams(rest)
                places = met(has)
                digits = has is None or "\\d" in has
    # From here on expressions are only taken out, so that what the text consists of stays enough, unless a word is cut.
    months = rest
    if may_match(needed_months(), has):
        over(MONTH, lambda m: [f"number:{n}"] if (n := month(m, months)) else None)
    if digits and ",000" in rest:
        over(THOUSANDS_3, lambda m: [number(m[1]), number(m[2]), number(m[3], 3)])
        over(THOUSANDS_2, lambda m: [number(m[1], 3), number(m[2], 3)])
    for i, (need, pattern, read) in enumerate(readings if places else (), len(wordings)):
        if i in places:
            before = rest
            over(pattern, read)
            if need.cuts and rest != before:
                places = met(grams(rest))
    if not digits:
        return sorted(found), rest
    if LABELLED.search(rest):
        over(LABEL, lambda m: [f"identifier:co{int(m[2])}" if m[1].lower() == "co" else number(m[2])], lambda m: f"{m[1]} ")
    scale = lambda s: t.SCALES.get(s.lower(), t.HAN_SCALES.get(s, 0)) if s else 0
    # A number's first digit is among its first three characters, so it is looked for from the next digit on.
    pieces, end = [], 0
    while (digit := DIGIT.search(rest, end)) and (m := FINAL.search(rest, max(end, digit.start() - 2))):
        found.append(number(HEAD.match(m[0])[0].rstrip(","), scale(m[1])))
        pieces += rest[end : m.start()], " "
        end = m.end()
    return sorted(found), "".join(pieces) + rest[end:]


#: Characters of a text up to which its tokens are remembered, and texts that a task remembers.
SHORT, REMEMBERED = 200, 20_000


@lru_cache(REMEMBERED)
def remembered(text: str) -> tuple[list[str], str]:
    return analysed(text)


def tokens(text: str | None) -> list[str]:
    """The sorted multiset of a text's numeric tokens."""
    return analysed(text)[0]


def ambiguity(text: str, rest: str) -> str:
    """``all`` if an expression's reading is open, ``extras`` if words of number are left unread, else ``none``."""
    if any(p.search(text) for p in open_readings()):
        return "all"
    return "extras" if LEFT_OVER.search(rest) else "none"


# Wordings of a request for detail, and of clicks that are meant.
ELABORATED = ["详细", "具体", "展开", "深入", "仔细"]
ELABORATE = regex.compile(f"(?:{either(ELABORATED)})地?(?:说|讲|谈|聊|解释|探讨|讨论|分析)")
CLICKS = regex.compile(r"双击|双点击|[两二2]\s*次\s*点击|点击\s*[两二2]\s*次")
CLICK_ON_IT = regex.compile(r"\bdouble[-\s]+click\s+on\s+(?:it|this|that)\b(?=\s*(?:[.!?]|$))", regex.I)
OR_MORE = regex.compile(rf"\bprobably\s+({DIGITS})\s+or\s+more\b", regex.I)


def kept(source: str, a: Counter, b: Counter) -> tuple[bool, bool, Counter]:
    """(whether b holds all of a, whether a scale left out in "probably N or more" was needed for it, what b adds)."""
    lost, added = a - b, b - a
    guess = OR_MORE.search(source)
    if guess and sum(lost.values()) == 1 and number(guess[1]) in lost:
        for power in (3, 6, 9, 12):
            if added[scaled := number(guess[1], power)]:
                return True, True, added - Counter([scaled])
    return not lost, False, added


def compare(source: str | None, target: str | None) -> tuple[str, list[str], list[str]]:
    """(level, source tokens, target tokens); level: ok, warning or error.

    Equal multisets are ok; other quarters are an error. A warning is due if the target holds all of the source and needs a left-out scale for it or adds only as
    many 0, 1 and 2 as the source's wording implies; if the source has an open reading; and if it holds all of the source, which has words of number left
    unread. Everything else is an error."""
    source, target = source or "", target or ""
    if any(word in target for word in ELABORATED) and ELABORATE.search(target) and not CLICKS.search(target):
        source = CLICK_ON_IT.sub("elaborate", source)
    (a, rest), (b, _) = [(remembered if len(x) <= SHORT else analysed)(x) for x in (source, target)]
    if a == b:
        return "ok", a, b
    quarters = lambda x: [v for v in x if v.startswith("quarter:")]
    if quarters(a) != quarters(b):
        return "error", a, b
    holds, by_scale, added = kept(source, Counter(a), Counter(b))
    implied = {"number:0": t.ZERO, "number:1": t.ONE, "number:2": t.TWO}
    if holds and set(added) <= set(implied) and (by_scale or added):
        if all(n <= sum(times * len(p.findall(source)) for times, p in evidence(implied[v])) for v, n in added.items()):
            return "warning", a, b
    found = ambiguity(source, rest)
    return ("warning" if found == "all" or found == "extras" and holds else "error"), a, b


VALUES_TYPE = ArrayType(StringType())
COMPARISON = StructType([StructField("level", StringType()), StructField("source_values", VALUES_TYPE), StructField("target_values", VALUES_TYPE)])


@lru_cache(REMEMBERED)
def remembered_level(source: str, target: str) -> str:
    return compare(source, target)[0]


def level_of(source: str, target: str) -> str:
    """The level alone; that of short pairs is remembered."""
    return remembered_level(source, target) if len(source) <= SHORT and len(target) <= SHORT else compare(source, target)[0]


def told(source: pa.Array, target: pa.Array) -> Iterator[tuple[int, str, str]]:
    """(place, source, target) of the pairs that may name a number; all others are ok and name none."""
    near = [pc.fill_null(pc.match_substring_regex(x, telling()), False) for x in (source, target)]
    places = pc.indices_nonzero(pc.or_(*near))
    yield from zip(*[x.to_pylist() for x in (places, source.take(places), target.take(places))])


def integrity(source: Column, target: Column) -> Column:
    """The whole comparison. (The function is made where it is used: one of the module would keep the session's handles.)"""

    def compared(s: pa.Array, z: pa.Array) -> pa.Array:
        levels, a, b = ["ok"] * len(s), [[]] * len(s), [[]] * len(s)
        for i, x, y in told(s, z):
            levels[i], a[i], b[i] = compare(x, y)
        values = pa.list_(pa.string())
        return pa.StructArray.from_arrays([pa.array(levels, pa.string()), pa.array(a, values), pa.array(b, values)], COMPARISON.names)

    return F.arrow_udf(compared, COMPARISON)(source, target)


def level(source: Column, target: Column) -> Column:
    """The comparison's level alone."""

    def compared(s: pa.Array, z: pa.Array) -> pa.Array:
        levels = ["ok"] * len(s)
        for i, x, y in told(s, z):
            levels[i] = level_of(x or "", y or "")
        return pa.array(levels, pa.string())

    return F.arrow_udf(compared, "string")(source, target)


def scan(text: Column) -> Column:
    """Plain decimal numbers in order, in the JVM."""
    return F.regexp_extract_all(text, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
