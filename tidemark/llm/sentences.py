"""Sentence boundaries across languages and scripts.

Rules by character property: the classes of the Unicode sentence-break property say which characters end a sentence
(STerm, in every script that has its own), which may (ATerm, the full stops) and which close (Close). What ends a
sentence in one script only is added below: the shad of Tibetan, the Greek question mark typed as a semicolon, the
danda typed as a bar and the Armenian full stop typed as a colon. Closing quotes and brackets belong to what they close.

A full stop is held back after abbreviations, initials and ordinals, inside numbers and names, and before a
lower-case word. Abbreviations are those of the language of the line or paragraph, which its commonest words give
(language tags may be missing or wrong and texts mix languages; where the words leave it open, the lists of all
languages hold). Titles and the like never end a sentence, words such as "fig." do not before a number,
and others end one before a capital.

Quotations with text of their sentence before or after them are one piece; quotations that stand by themselves are
split. Thai has no terminators: there a space between Thai words ends a sentence unless the next word goes on with it.

Lines: headings, list items, table rows and chat lines are units; a line break is part of running prose only where
the line is full, that is, where the next line's first word would not have fitted. Prose in columns of a usual width may be
ragged; other widths count as columns where the block's own lines keep to one width.

Nothing is cut off or bounded: time grows with the length of the text, whatever it holds.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

_PLANES = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x20000)]))


def _class(pattern: str) -> str:
    """All characters of a property."""
    return "".join(regex.findall(pattern, _PLANES))


# The small section of Burmese has the property but parts phrases; the shads of Tibetan lack it.
_STERM = _class(r"\p{Sentence_Break=STerm}").replace("၊", "") + "།༎༏༑"
_ATERM = _class(r"\p{Sentence_Break=ATerm}")
_INVISIBLES = "­​‌‍﻿⁠"
_ALWAYS = set(_STERM) - set("!?") | {"፡"}
_DOTS = set(".…")
_CLOSERS = set(_class(r"[\p{Pe}\p{Pf}]")) | set("\"'“‘" + _INVISIBLES)
_PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", '"': '"', "(": ")", "（": "）", "[": "]", "【": "】"}
_BRACKETS = set("(（[【")


def _set(chars: str) -> str:
    return "".join("\\" + c if c in "\\]^-[" else c for c in chars)


_QUOTE = re.compile(f"[{_set(''.join(_PAIRS) + ''.join(_PAIRS.values()))}]")
# Which characters can end a sentence, by what scripts a text has: Greek, Devanagari, Armenian, and any beyond the basic
# plane, whose characters make a pattern slow.
_MARKS = _STERM + _ATERM + "…"
_BASIC = "".join(c for c in _MARKS if c <= "￿")
_ENDS = {
    (g, d, h, z): re.compile(f"[{_set((_MARKS if z else _BASIC) + '፡' + (';' + chr(0x37E) if g else '') + ('|' if d else '') + (':' if h else ''))}]+")
    for g in (False, True) for d in (False, True) for h in (False, True) for z in (False, True)
}
_ANY_END = _ENDS[False, False, False, True]
_GREEK, _DEVANAGARI, _ARMENIAN = re.compile("[Ͱ-ͽͿ-Ͽἀ-῿]"), re.compile("[ऀ-ॣ०-ॿ]"), re.compile("[Ա-ֈ]")
_ASTRAL, _THAI = re.compile("[𐀀-𞿿]"), re.compile("[฀-๿]")
_THAI_GAP = re.compile(f"(?<=[฀-๿])\\s+[{_INVISIBLES}]*(?=[฀-๿])")
_LOW_QUOTE = re.compile("[„‚]")
_LINE = re.compile("\r\n|[\n\r\x0b\x0c\x85  ]")
_SOLID, _SPACE = re.compile(r"\S"), re.compile(r"\s")
_STRONG_MARK = re.compile(r"[|#•*▪◦‣·●○]|[-–—] |\[[^\]\n]{1,20}\]|<[^<>\s]{1,30}>|\d{1,2}:\d\d(:\d\d)?\s+[-–—]\s|[\w.\-]{1,20}_\d+: ")
_WEAK_MARK = re.compile(r"(\d{1,3}|[A-Za-z])[.)]\s|\d+(\.\d+)+\s")
_LETTER_ITEM = re.compile(r"[A-Za-z]\)\s")
_PREFIX = re.compile(
    r"\s*(?:#+\s*)?(?:\s*(?:[-–—•*▪◦‣·●○>]|\(?(?:\d{1,3}|[A-Za-z])[.)](?=\s)|\d+(?:\.\d+)+\.?(?=\s)))?"
    r"\s*(?:\[[^\]\n]{1,20}\]|\d{1,2}:\d\d(?::\d\d)?(?=\s))?\s*(?:[-–—]\s+)?"
    r"(?:<[^<>\s]{1,30}>|[\w.\-:]{1,30}(?::(?=\s)|\s:=|\s[–—](?=\s)))?\s*"
)
_IN_WORD = re.compile("[\\w.'’­​-‍﻿̀-ͯ҃-֑҇-ׇؐ-ًؚ-ٰٟۖ-ۭऀ-࿿-]")
_INVISIBLE = re.compile(f"[{_INVISIBLES}]")
_FULL_STOP = re.compile(r"(?<!\S)([^\s.]+(?:\.[^\s.]+)*)\.[\"'”’»)]*\s+([^\W\d_])[^\W\d_]*(?=[\s,;:'’]|\.\s)")
_NAME = re.compile(r"[^\W\d_]+_\d+")
_DASH = re.compile(r"[—–]\s*[^\W\d_]")
_DASHES = re.compile("[—–  ]+")
_SHORT_START = re.compile(r"(\S+)(?:\s+\S+){0,2}")
_LATIN_WORD = re.compile(r"[a-zà-öø-ÿœ]+")
_NUMBERED = re.compile(r"[(\[]?(?:\d|[IVXLC]+\b|[A-Z]\b(?!')|[#§№])")
_USUAL_WIDTH, _RAGGED = (45, 130), 55
_CLOSING_OF = {c: [o for o, ends in _PAIRS.items() if c in ends] for c in set("".join(_PAIRS.values()))}


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


# Commonest words, by which a line shows its language.
_COMMON = {
    "en": _words("the of and to in is that it was for on are with as at be this have from or by not but they which you we were an will would there their if when no so a do all can has our"),
    "de": _words("der die das und ist nicht ein eine den dem von zu mit auf für im sich des auch es wird als bei war noch nach einer um am oder wie über wir aus"),
    "fr": _words("le la les de des est et en un une du dans que qui pour pas sur au par avec ce il ne se plus sont mais ou nous cette elle aux été leur ont sans à a on avant après quel quelle"),
    "es": _words("el la los las de y que en un una por con para no se del al es su lo como más pero sus ha este está sin sobre ya o cuando muy"),
}
# Abbreviations that never end a sentence before a word; those that do not before a number; those that do before a capital.
_NEVER = {
    "en": _words("approx vs cf i.e e.g viz est avg incl excl resp dept tel ext dr mr mrs ms prof st gen sen rep gov capt lt col maj sgt rev hon messrs mt ft"),
    "de": _words("z.b d.h u.a z.t i.d.r z d i u s.o bzw ca evtl ggf inkl exkl vgl geb gest zzgl abzgl insb sog bspw mind allg einschl hr fr dr prof hrsg st"),
    "fr": _words("ex env cf m mm mme mlle mgr dr prof st p.ex c.-à-d"),
    "es": _words("aprox máx mín p.ej sr sra srta dn dña ee ud uds dr dra prof"),
    "": _words("см т.е им проф акад ул др.-инж макс мин напр βλ κ κα π.χ μέγ ελάχ δηλ डॉ रु श्री د أ م ص"),
}
_NUMBER = {
    "en": _words("sec secs fig figs tbl tab vol vols pp p ed eds nos no art ch chap eq eqs ref refs rel para"),
    "de": _words("abb tab nr bd s kap art abs vgl"),
    "fr": _words("fig chap réf vol p pp art nos"),
    "es": _words("pág págs núm fig cap vol art"),
    "": _words("рис табл стр гл ст т σελ πίν σχ αρ κεφ"),
}
_MAYBE = {
    "en": _words("etc u.s e.u u.k u.n a.m p.m inc ltd co corp bros jr al no l max min r.r jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun"),
    "de": _words("usw u.s.w etc mio mrd std max min okt dez mär jan feb apr jun jul aug sep sept nov etw al"),
    "fr": _words("etc max min janv févr juil sept oct nov déc al"),
    "es": _words("etc uu ee.uu cía s.a max min al"),
    "": _words("руб г гг т.д т.п д п млн млрд тыс коп др мес κ.λπ λπ κ.ά κ.τ.λ λ χ"),
}
_LISTS = {
    language: tuple(frozenset().union(*(table[k] for k in ([language] if language else _COMMON)), table[""]) for table in (_NEVER, _NUMBER, _MAYBE))
    for language in ("", *_COMMON)
}
_ABBREVIATED = frozenset().union(*_LISTS[""])
_ORDINAL_BEFORE = _words("am der die das dem den des vom zum zur beim im ein eine einem einen einer jeder jedes ab bis seit dieser")
_LEAD_IN = _words("in at by from on since until for during after before with per under near over into of the según en desde hasta de le la les el los selon dans vers à")
_THAI_GOES_ON = tuple(
    "แต่ ซึ่ง และ หรือ เพราะ แล้ว จึง เพื่อ ที่ โดย กับ ของ ให้ ได้ ว่า คือ เช่น รวมทั้ง ส่วน ก็ จน จาก ใน ตอน ก่อน หลัง อยู่ ไว้ มาก น้อย ต่อ ทั้งหมด ด้วย".split()
)
# Pronouns, articles and the like: they begin a sentence after an abbreviation in texts without capitals, unless they
# are prepositions or conjunctions, with which a sentence goes on.
_OPENING = _words("the a an it it's it’s its this that these those he she they we you i his her their our your my there here what who whoever whose which where why how if as is well still also then now meanwhile however")
_GOING_ON = _words("in on for by with at from and or but once during without before after while late to of until since per under than as")


def _dense(ch: str) -> bool:
    """Scripts written without spaces between sentences: Han, kana and their marks."""
    return "　" <= ch <= "鿿" or "豈" <= ch <= "﫿" or "＀" <= ch <= "￯" or "\U00020000" <= ch <= "\U0003ffff"


def _skip(text: str, i: int, b: int) -> int:
    """First character from ``i`` on that is no white space, ``b`` if there is none."""
    while i < b and text[i].isspace():
        i += 1
    return i


def _word_at(text: str, at: int, end: int) -> str:
    m = _SPACE.search(text, at, end)
    return text[at : m.start() if m else end]


def _word_before(text: str, start: int, p: int) -> str:
    """Letters, digits, inner stops and marks right before ``p``."""
    i = p
    while i > start and _IN_WORD.match(text[i - 1]):
        i -= 1
    return text[i:p]


def _starts_like_sentence(word: str) -> bool:
    """Whether a word after a full stop can begin a sentence (a plain lower-case word cannot)."""
    word = _INVISIBLE.sub("", word)
    core = word.lstrip("\"'“„«‹「『(（[¿¡‘’—–-")
    if not core or not core[0].islower():
        return True
    plain = core.rstrip(".,;:!?…)\"'”»’]")
    return not all(c.isalpha() or c in "'’-" for c in plain) or not (plain.islower() or plain[1:].islower())


def _special_lower(word: str) -> bool:
    return _starts_like_sentence(word) and not _NAME.match(word)


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    part = text[a:b]
    return a + len(part) - len(part.lstrip()), b - (len(part) - len(part.rstrip()))


def _units(text: str) -> Iterator[tuple[int, int]]:
    """Headings, items, rows, chat lines and paragraphs of running prose, as spans."""
    lines, at = [], 0
    for m in _LINE.finditer(text):
        lines.append(_trim(text, at, m.start()))
        at = m.end()
    lines.append(_trim(text, at, len(text)))
    k = 0
    while k < len(lines):
        if lines[k][0] >= lines[k][1]:
            k += 1
            continue
        last = k
        while last + 1 < len(lines) and lines[last + 1][0] < lines[last + 1][1]:
            last += 1
        block = lines[k : last + 1]
        start = block[0][0]
        if len(block) > 1:
            width, ragged = _column(text, block)
            for (a, b), (c, d) in zip(block, block[1:]):
                if not (width and _goes_on(text, a, b, c, d, width, ragged)):
                    yield start, b
                    start = c
        yield start, block[-1][1]
        k = last + 1


def _room(text: str, b: int, c: int, d: int) -> int:
    """What the first word of the next line, text[c:d], would have added to a line that ends at ``b``."""
    return 2 if _dense(text[c]) and _dense(text[b - 1]) else len(_word_at(text, c, d)) + 1


def _column(text: str, block: list[tuple[int, int]]) -> tuple[int, bool]:
    """Width of the column a block of lines is set in and whether its lines may be ragged; 0 if it is in no column."""
    # a word that is longer than the column stands alone in its line and says nothing of the width
    sizes = [b - a for a, b in block if _dense(text[a]) or _dense(text[b - 1]) or _SPACE.search(text, a, b)] or [max(b - a for a, b in block)]
    width = max(sizes)
    if _USUAL_WIDTH[0] <= width <= _USUAL_WIDTH[1]:
        return width, True
    # any other width: nearly all lines must be full, and hold several words
    inner = list(zip(block, block[1:]))
    full = sum(b - a + _room(text, b, c, d) > width for (a, b), (c, d) in inner)
    words = sum(len(text[a:b].split()) if not _dense(text[a]) else (b - a) / 4 for a, b in block) / len(block)
    if len(inner) >= 2 and full >= 0.8 * len(inner) and words >= 3:
        return width, False
    # two narrow lines: only where the first one is plainly unfinished
    (a, b), (c, _) = block[0], block[1]
    unfinished = len(block) == 2 and width < _USUAL_WIDTH[0] and full and words >= 4 and text[c].islower() and not _ANY_END.match(text[b - 1])
    return (width, False) if unfinished else (0, False)


def _goes_on(text: str, a: int, b: int, c: int, d: int, width: int, ragged: bool) -> bool:
    if text[a] in "|#" or _STRONG_MARK.match(text, c, d):
        return False
    full = b - a + _room(text, b, c, d) > width
    if ragged and not full:  # some writers break before the width is passed, some after it
        full = b - a >= max(_RAGGED, 0.7 * width) or b - a >= _RAGGED - 5 and text[c].islower()
    if not full or _LETTER_ITEM.match(text, c, d):
        return False
    return not (_WEAK_MARK.match(text, c, d) and (not ragged or _WEAK_MARK.match(text, a, b)))


def _quotations(text: str, a: int, b: int) -> tuple[list[int], dict[int, int]]:
    """Outermost quotes and brackets of a unit: opening positions in order, and the closing position of each."""
    found = [(m.start(), m.group()) for m in _QUOTE.finditer(text, a, b)]
    if len(found) < 2:
        return [], {}
    partner: dict[int, int] = {}
    waiting: dict[str, list[int]] = {o: [] for o in _PAIRS}
    for i, ch in found:
        if ch == '"':
            for k in waiting[ch]:
                partner[k] = i
            waiting[ch] = [i]
            continue
        for o in _CLOSING_OF.get(ch, ()):
            if waiting[o]:
                partner[waiting[o].pop()] = i
        if ch in _PAIRS:
            waiting[ch].append(i)
    opens, until = [], a
    for i, ch in found:
        if i >= until and i in partner and not (ch == '"' and i > a and text[i - 1].isdigit()):
            opens.append(i)
            until = partner[i] + 1
    return opens, {i: partner[i] for i in opens}


class _Text:
    """One text: what its scripts are, and the sentences of its units."""

    def __init__(self, text: str):
        self.text = text
        scripts = [p.search(text) is not None for p in (_GREEK, _DEVANAGARI, _ARMENIAN, _ASTRAL)]
        self.ends, self.thai = _ENDS[tuple(scripts)], _THAI.search(text) is not None

    def split(self, a: int, b: int, out: list[tuple[int, int]]) -> None:
        text = self.text
        if text[a] == "|":
            out.append((a, b))
            return
        marks = [m.span() for m in self.ends.finditer(text, a, b)]
        thai = self.thai and _THAI.search(text, a, b) is not None
        if not thai and (not marks or marks[0][1] == b):
            out.append((a, b))
            return
        marks.append((b, b))
        self.a, self.b, self.lists, self.lower = a, b, None, None
        self.seen = {p: (a, -1) for p in (_GREEK, _DEVANAGARI, _ARMENIAN)}
        opens, pairs = _quotations(text, a, b)
        self.low = [m.start() for m in _LOW_QUOTE.finditer(text, a, b)]
        # spaces that end a Thai sentence, the first one last
        gaps = [g.start() for g in _THAI_GAP.finditer(text, a, b) if text.startswith("ตอนนี้", g.end()) or not text.startswith(_THAI_GOES_ON, g.end())][::-1] if thai else []
        start = a
        i = begin = _PREFIX.match(text, a, b).end()  # where the words of the current sentence begin
        opens.append(b)
        k = n = 0
        while i < b:
            while opens[k] < i:
                k += 1
            while marks[n][1] <= i and marks[n][0] < b:
                n += 1
            o, (p, q) = opens[k], marks[n]
            if p < i:
                p = i
            if thai:
                while gaps and gaps[-1] < i:
                    gaps.pop()
                if gaps and gaps[-1] < min(o, p):
                    space = gaps.pop()
                    out.append(_trim(text, start, space))
                    start = begin = i = _skip(text, space, b)
                    continue
            if o < p:
                c = pairs[o]
                k += 1
                if self._stands_alone(begin, o, c):
                    i = o + 1
                    continue
                i = c + 1
                if self._ends_with_mark(o, c) and _SOLID.search(text, begin, o):
                    # led up to and cited as one piece: a new sentence only where a capital follows
                    j = _skip(text, i, b)
                    if j < b and j > i and text[j] not in ",;:" and (text[j].isupper() or text[j] in "¿¡\"“„«(" or (text[j].isdigit() and text[o] not in _BRACKETS)) and (text[o] not in _BRACKETS or text[j].isupper()):
                        out.append(_trim(text, start, i))
                        start = begin = i = j
                continue
            if p >= b:
                break
            end = self._break_at(start, begin, p, q)
            if end < 0:
                i = q
                continue
            out.append((start, end))  # both ends are solid
            start = begin = i = _skip(text, end, b)
        start, stop = _trim(text, start, b)
        if start < stop:
            out.append((start, stop))

    def _has(self, script: re.Pattern, begin: int, p: int) -> bool:
        """Whether the sentence from ``begin`` has a letter of the script before ``p``; every letter is looked at once."""
        upto, last = self.seen[script]
        for m in script.finditer(self.text, max(upto, begin), p):
            last = m.start()
        self.seen[script] = max(upto, p), last
        return last >= begin

    def _ends_with_mark(self, o: int, c: int) -> bool:
        text, j = self.text, c - 1
        while j > o and (text[j].isspace() or text[j] in _CLOSERS):
            j -= 1
        return j > o and bool(_ANY_END.match(text[j]))

    def _stands_alone(self, begin: int, o: int, c: int) -> bool:
        """Whether a quotation or bracket is made of sentences of its own."""
        text, b = self.text, self.b
        if _SOLID.search(text, begin, o) or not self._ends_with_mark(o, c):
            return False
        j = _skip(text, c + 1, b)
        if j >= b:
            return True
        nxt, gap = text[j], j > c + 1
        if nxt in "—–-,;:…" or (nxt in ".!?" and not gap):
            return False
        if not gap:
            return nxt in _PAIRS or text[o] in _BRACKETS
        word = _word_at(text, j, b)
        if _NAME.match(word):
            return text[o] in _BRACKETS
        if nxt.islower():
            return _special_lower(word) or text[o] in _BRACKETS and _starts_like_sentence(word)
        if nxt.isupper() or nxt.isdigit() or nxt in _PAIRS or nxt in "¿¡" or text[o] in _BRACKETS:
            return True
        marks = self.ends.finditer(text, o, c)
        return next(marks, None) is not None and next(marks, None) is not None

    def _closed(self, start: int, q: int) -> int:
        """End of the closing marks after a terminator (a French one may stand behind a space)."""
        text, b, j = self.text, self.b, q
        while j < b:
            ch = text[j]
            if ch in _CLOSERS:
                if ch in "“‘" and not (self.low and bisect.bisect_left(self.low, start) < bisect.bisect_left(self.low, q)):
                    break
                if ch in "\"“‘'" and j + 1 < b and text[j + 1].isalnum() and j > q and text[j - 1].isspace():
                    break
                j += 1
            elif ch.isspace() and j + 1 < b and text[j + 1] == "»":
                j += 2
            else:
                break
        return j

    def _without_capitals(self) -> bool:
        """Whether the sentences of the unit begin with lower-case letters."""
        if self.lower is None:
            low = high = 0
            never, number, maybe = self._abbreviations()
            for m in _FULL_STOP.finditer(self.text, self.a, self.b):
                token = m[1].lower().lstrip("(\"'“„«")
                if token in never or token in number or token in maybe or len(token) < 2 or re.fullmatch(r"\d{1,2}(\.\d{1,2})?", token):
                    continue
                low, high = low + m[2].islower(), high + m[2].isupper()
            self.lower = low > 0 and low >= high
        return self.lower

    def _abbreviations(self) -> tuple[frozenset[str], ...]:
        if self.lists is None:
            self.tongue = _language(self.text[self.a : self.b])
            self.lists = _LISTS[self.tongue]
        return self.lists

    def _short_start(self, begin: int, p: int) -> bool:
        """Whether only a preposition and a word or two stand before ``p`` in the sentence."""
        m = _SHORT_START.match(self.text, begin, p)
        return bool(m) and m.end() == p and m[1].lower() in _LEAD_IN

    def _break_at(self, start: int, begin: int, p: int, q: int) -> int:
        """Where the sentence ends if the marks text[p:q] end it, else -1."""
        text, b = self.text, self.b
        marks = text[p:q]
        if marks == "." and q + 1 < b and text[q] == " " and text[q + 1].isupper():
            # by far the most frequent case: a plain word before, a capital behind
            token = text[text.rfind(" ", start, p) + 1 : p]
            if len(token) > 1 and token.isascii() and token.isalpha() and token.islower() and token not in _ABBREVIATED:
                return q
        if marks == "፡":  # one is a space between words, two are a full stop
            return -1
        kinds = set(marks)
        if kinds <= {";", "\u037e"}:
            if not self._has(_GREEK, begin, p):
                return -1
        elif kinds == {"|"}:
            if not self._has(_DEVANAGARI, begin, p):
                return -1
        elif kinds == {":"}:
            j = _skip(text, q, b)
            if not (q < j < b and "Ա" <= text[j] <= "Ֆ" and self._has(_ARMENIAN, begin, p)):
                return -1
        end = self._closed(start, q)
        j = _skip(text, end, b)
        if j >= b:
            return end
        nxt, gap = text[j], j > end
        if nxt in "—–" and gap and _DASH.match(text, j, b):
            rest = _DASHES.match(text, j, b).end()
            if rest < b and text[rest].islower():
                return -1
        if kinds & _ALWAYS:
            return end
        if marks == "．":
            return -1 if p > 0 and text[p - 1].isdigit() and text[q : q + 1].isdigit() else end
        if not gap:
            if kinds <= _DOTS and (len(marks) > 1 or "…" in marks):
                return -1
            if nxt in _PAIRS and end == q and _dense(nxt):
                return end
            if _dense(nxt) and nxt.isalpha() and (kinds & {"!", "?"} or _dense(text[p - 1])):
                return end
            if marks == "." and end == q and p > 1 and text[p - 1].islower() and text[p - 2].islower() and nxt.isupper() and text[j + 1 : j + 2].islower():
                return end
            if marks == "." and "가" <= text[p - 1] <= "힣" and "가" <= nxt <= "힣":
                return end
            if kinds & {"!", "?"} and nxt.isupper() and text[j + 1 : j + 2].islower() and text[p - 1].isalpha():
                return end
            return -1
        if kinds <= _DOTS and (len(marks) > 1 or "…" in marks):
            return end if nxt.isupper() or nxt in "¿¡" else -1
        word = _word_at(text, j, b)
        if marks != "." and not kinds <= set(_ATERM):
            return -1 if end > q and nxt.islower() and not _special_lower(word) else end
        return end if self._stop_ends(start, begin, p, j, word, end > q) else -1

    def _stop_ends(self, start: int, begin: int, p: int, j: int, word: str, closed: bool) -> bool:
        """Whether a single full stop at ``p`` ends the sentence when ``word`` follows it at ``j``."""
        text, nxt = self.text, self.text[j]
        before = _INVISIBLE.sub("", raw := _word_before(text, start, p))
        token, shown = unicodedata.normalize("NFC", before).strip(".'’").lower(), before.strip("'’")
        capital = _starts_like_sentence(word)
        if not capital and not (len(token) > 1 and self._without_capitals()):
            return False
        if closed:
            return True
        if len(token) == 1 and token.isalpha() and shown[:1].isupper():
            return False
        if not token:
            return True
        never, number, maybe = self._abbreviations()
        if token in never and not (len(token) == 1 and len(shown) > 1):
            return False
        if token in number and not (len(token) == 1 and len(shown) > 1) and (not capital or _NUMBERED.match(text, j)):
            return False
        if token in maybe:
            if not capital:
                first = word.lower().rstrip(",;:")
                return first in _OPENING and first not in _GOING_ON and not self._short_start(begin, p)
            if not (nxt.isupper() or nxt in "¿¡\"“„«(「『" or not (nxt.islower() or nxt.isdigit())):
                return False
            return not self._short_start(begin, p)
        if token.isdigit() and len(token) <= 2 and nxt.isalpha() and self.tongue in ("de", ""):
            i = p - len(raw)
            while i > start and text[i - 1].isspace():
                i -= 1
            if _word_before(text, start, i).lower() in _ORDINAL_BEFORE:
                return False
        return True


def _language(part: str) -> str:
    """Language of the Latin words of a span; '' unless one is clearly ahead."""
    words = _LATIN_WORD.findall(part.lower())
    seen = set(words)
    counts = sorted((len(common & seen), k) for k, common in _COMMON.items())
    return counts[-1][1] if counts[-1][0] >= max(3, 2 * counts[-2][0]) else ""


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Spans of the sentences of a text, in code points; none for a null, empty or blank text."""
    if not text:
        return []
    whole, out = _Text(text), []
    for a, b in _units(text):
        whole.split(a, b, out)
    return [s for s in out if s[0] < s[1]]


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, starts, ends = [], [], []
        for doc, text in zip(batch[0].to_pylist(), batch[1]):
            for a, b in sentences(text.as_py()):
                ids.append(doc)
                starts.append(a)
                ends.append(b)
            if len(ids) > 200_000:
                yield _spans(batch, ids, starts, ends)
                ids, starts, ends = [], [], []
        yield _spans(batch, ids, starts, ends)


def _spans(batch: pa.RecordBatch, ids: list, starts: list, ends: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["id", "start_pos", "end_pos"])


def split_sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, start_pos, end_pos`` of every sentence: one pass over the texts, no shuffle.

    Null, empty and blank texts give no row; repeated rows give their sentences again; a null key is kept.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(_explode, f"id {kind}, start_pos bigint, end_pos bigint")
    return rows.select(F.col("id").alias(key), "start_pos", "end_pos")
