"""Sentence units of texts in several languages and scripts.

Marks that always end a sentence, as in Chinese, Japanese and Hindi, are taken as they are; Thai, which has none, is
cut at spaces that stand between clauses. Whether a full stop ends a sentence is decided within the document first, by
occurrences of its words that are not ambiguous: one that stands with a stop before a lower-case letter or a comma is
an abbreviation, one that stands with a stop at the very beginning of a text or paragraph is an abbreviation before
what it belongs to, as a title; one that stands without a stop is a plain word; and one that also stands in lower case
is no proper name. Where the document is silent, counts over the whole corpus decide: one pass over all texts counts
every word and notes those that each text leaves open, and a join gives each text the answers to its own. Only where
both are silent do the lists below decide.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Container, Iterable, Iterator
from functools import lru_cache
from unicodedata import is_normalized, normalize

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, ship

# Marks, pairs of marks, abbreviations and other words of the nine languages.
#: Marks that end a sentence in any script; the full stop is decided by its surroundings.
ENDERS = "!?。！？｡।॥؟۔"
#: Opening mark to the marks that close it; the straight quote is its own.
PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "〈": "〉", "(": ")", "（": "）", "[": "]", "【": "】", '"': '"'}
BRACKETS = "(（[【《〈"
CLOSERS = "”»›」』》〉)）]】\"'’“"
#: Abbreviations that stand before what they belong to: no sentence ends after them, unless evidence says otherwise.
LEADING = frozenset(
    "dr mr mrs ms prof capt sgt lt col gen st rev hon fig figs no nos vol temp tab ch sec eq cf vs viz al ed eds approx e.g i.e p pp"
    " hr fr frl nr abb kap bd vgl bzw ca z d u s S evtl ggf inkl bes sog zzgl str tel"
    " sr sra srta dña núm pág págs cap art aprox ej p.ej ud uds"
    " m mm mme mlle mlles env ex p.ex chap éd"
    " डॉ श्री सं पृ कि.ग्रा कि प्रो उदा"
    " د ص م أ ج ط ت ق"
    " ดร น พ.ศ ค.ศ ม นพ รศ ผศ".split()
)
#: Abbreviations that may also end a sentence: they do before a capital letter, an opening mark or a number.
CLOSING = frozenset("etc ltd inc co corp jr sr. a.m p.m ff usw u.s.w sqq kg g km m cm mm l h min s إلخ الخ كغ كم कि.ग्रा อื่นๆ ฯลฯ กก กม".split())
#: Words that a number with a stop counts; as the lists above, only where there is no evidence.
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember".split())
#: Words of saying that close a clause after a quotation, in scripts without capital letters.
SAYING = regex.compile(r"(?:कहा|पूछा|बोला|बोली|बोले|बताया|चिल्लाया|चिल्लाई|言った|言う|尋ねた|叫んだ|聞いた|答えた|話した|述べた|つぶやいた|说|說|道|问|問|喊|叫|答|写)[^\p{L}\p{N}]*$")
#: Words that go on with the clause after a quotation.
GOING_ON = regex.compile(r"(?:と|って|という|とは|を|が|に|で|は|も|の|后|後|就|便|之后|然后|ثم|فقال|وقال|ว่า|और|तब|कहकर)")
#: Thai words that belong to what stands before them, and words that follow a number.
THAI_ATTACHED = frozenset("ประมาณ ค่า ราว เกือบ กว่า ดู หน้า เวลา รวม เช่น คือ และ หรือ แต่ กับ จาก ถึง โดย เพราะ ซึ่ง เมตร กก. กม. ม. ซม. ๆ ฯลฯ น.".split())
THAI_UNITS = ("เมตร", "กก.", "กม.", "ซม.", "ม.", "กิโล", "ใบ", "ตัว", "คน", "อัน", "ชิ้น", "ลูก", "เล่ม", "บาท", "นาที", "ชั่วโมง", "วัน", "เดือน", "ปี", "ครั้ง", "คัน", "แผ่น", "ขวด", "กล่อง", "ถัง", "ลิตร", "องศา", "เปอร์เซ็นต์", "น.", "หน่วย")

_re = lru_cache(maxsize=None)(regex.compile)
_ENDS = re.escape(ENDERS)
_BREAK = r"(?:\r\n|[\n\r\v\x85  ])"
PARAGRAPH = regex.compile(rf"{_BREAK}[^\S\n\r\v\x85  ]*(?:{_BREAK}[^\S\n\r\v\x85  ]*)+")
EMOJI = r"(?:[\p{Emoji_Presentation}\p{Extended_Pictographic}][\p{Emoji_Modifier}️‍\p{Extended_Pictographic}]*)"
AFTER = regex.compile(rf"(?:[^\S\n\r]*{EMOJI})*")
MARK = re.compile(rf"[.…．]+|[{_ENDS}][{_ENDS}.…]*")
BOUND = re.compile(r"[\s“”„«»‹›「」『』（）()\[\]【】\"。！？、，：；!?…，,;:—–]").match
QUOTES = re.compile(r"[“”„«»‹›「」『』《》〈〉()（）\[\]【】\"]")
THAI_LETTER = re.compile("[\u0e01-\u0e5b]").search
THAI_GAP = regex.compile(r"(?<=\S)\s+(?=\S)")
LIST_NUMBER = regex.compile(r"(?:[(（]\d{1,3}[)）]|\d{1,3}[.)．])")
LIST_START = regex.compile(r"(?:[(（]\p{Nd}{1,3}[)）]|\p{Nd}{1,3}[.)．])\s+\S")
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNCASED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Devanagari}\p{Arabic}\p{Thai}]")
#: Marks and white space around words, as the faster engine knows them, and a letter with its marks by what it is not.
_AROUND = r"\s\d!-/:-@\[-`{-~…“”„«»‹›「」『』《》〈〉（）【】。！？、，：；｡．—–।॥؟۔،؛’‘·¿¡"
_T = f"[^{_AROUND}]"
AROUND = re.compile(f"[{_AROUND}]").match
BARE = re.compile(rf"{_T}++")
STOPPED = re.compile(rf"{_T}++(?:\.{_T}{{1,3}}(?!{_T}))*+")
STOP = re.compile(r"\.(?=(\s*)(.?))", re.S)
CAPITAL = re.compile(rf"[A-ZÀ-ÞĀ-ƏΑ-ΩА-Я]{_T}*+(?!\.)")
#: A word and the first letter of another.
GOES_ON = re.compile(rf"{_T}++[^\S\n]([^\W\d_])")


def folded(word: str) -> str:
    """Lower case, with accents composed, so that both spellings of an accent are one word."""
    return normalize("NFC", word.lower())


def _token(text: str, e: int) -> int:
    """Where the word before a stop begins; stops within it stand before at most three letters, as in e.g."""
    i = part = e
    while i > 0:
        if not AROUND(text[i - 1]):
            i -= 1
        elif text[i - 1] == "." and i < part and part - i <= 3 and i > 1 and not AROUND(text[i - 2]):
            i -= 1
            part = i
        else:
            break
    return i


def _scan(text: str) -> tuple[Counter, Counter, Counter]:
    """Words with a stop by kind, words without one as they are written, and capitalised words by their place."""
    if not is_normalized("NFC", text):
        text = normalize("NFC", text)
    stops: Counter = Counter()
    dotted: Counter = Counter()  # parts of words with a stop
    for m in STOP.finditer(text) if "." in text else ():
        gap, nxt = m.groups()
        e = m.start()
        if not gap and nxt and nxt not in ",)" and not nxt.isdigit():
            continue  # within a word
        i = _token(text, e)
        if i == e or (i and text[i - 1] == "."):
            continue
        token = text[i:e]
        dotted.update(token.split("."))
        if not nxt or gap.count("\n") > 1:
            kind = "z"
        elif nxt.islower() or nxt in ",;":
            kind = "a"
        elif nxt.isdigit():
            kind = "d"
        else:
            kind = "b"
            k = i - 1
            while k >= 0 and text[k] in " “\"«„(":
                k -= 1
            if k < 0 or (text[k] == "\n" and text[:k].rstrip(" \t\r")[-1:] in ("\n", "")):
                goes = GOES_ON.match(text, m.end() + len(gap))
                kind = "s" if goes and not goes[1].isupper() else "b"
        stops[token.lower(), kind] += 1
    bare = Counter(BARE.findall(text))
    bare.subtract(dotted)
    places: Counter = Counter()
    for m in CAPITAL.finditer(text):
        i = m.start()
        if i > 1 and text[i - 1].isspace():
            if text[i - 2].isalpha() or text[i - 2] == ",":
                places[m[0].lower(), "c"] += 1
            elif text[i - 2] == "." and text[i - 3 : i - 2].isdigit():
                places[m[0].lower(), "n"] += 1
    return stops, bare, places


def _by_case(bare: Counter) -> Counter:
    words: Counter = Counter()
    for w, n in bare.items():
        if n > 0:
            words[(w, "w") if w.islower() else (w.lower(), "u")] += n
    return words


def evidence(text: str) -> tuple[Counter, Counter]:
    """Words with a stop by kind, and words without one by kind.

    With a stop: 'z' at the end of a paragraph, 'a' before a lower-case letter or comma, 'd' before a number, 's' at the
    beginning of a paragraph whose sentence goes on after the next word, 'b' elsewhere. Without: 'w' in lower case, 'u'
    in another; of words with a capital, 'c' those within a sentence and 'n' those after a number with a stop.
    """
    stops, bare, places = _scan(text)
    return stops, _by_case(bare) + places


def own_answers(stops: Counter, words: Counter, asked: Iterable[str] | None = None) -> set[str]:
    """What a document says of words by itself, as letter and word: 'T' and 'A' abbreviations, 'U' stands without a stop, 'W' also in lower case."""
    out = {("A" if k == "a" else "T") + w for w, k in stops if k in "as"}
    out |= {("W" if k == "w" else "U") + w for w, k in words if k in "wu"}
    return out if asked is None else {x for x in out if x[1:] in asked}


class Splitter:
    """Splits texts, with what the corpus knows of abbreviations and of common words."""

    def __init__(self, abbreviations: frozenset[str] = frozenset(), common: frozenset[str] = frozenset(), plain: frozenset[str] = frozenset(), titles: frozenset[str] = frozenset(), ordinals: frozenset[str] = frozenset()) -> None:
        self.abbreviations, self.common, self.plain, self.titles, self.ordinals = abbreviations, common, plain, titles, ordinals

    def spans(self, text: str | None, own: Container[str] | None = None) -> list[tuple[int, int]]:
        """(start, end) of each unit in code points; own: what the document says itself, if it is at hand."""
        if not text or text.isspace():
            return []
        out: list[tuple[int, int]] = []
        self.own = own_answers(*evidence(text)) if own is None else own
        at = 0
        for m in [*PARAGRAPH.finditer(text), None]:
            end = m.start() if m else len(text)
            out.extend(self._paragraph(text, at, end, m is None))
            at = m.end() if m else end
        return out

    def _pairs(self, text: str, a: int, b: int, last: bool) -> list[tuple[int, int, str]]:
        """Outermost pairs of marks in a stretch: (opening, closing, opening mark); in the last stretch one may stay open."""
        stack: list[tuple[int, str]] = []
        waits: Counter = Counter()  # marks that would close something
        found: list[tuple[int, int, str]] = []
        for m in QUOTES.finditer(text, a, b):
            i, c = m.start(), m[0]
            hit = next((k for k in range(len(stack) - 1, -1, -1) if c in PAIRS[stack[k][1]]), None) if waits[c] else None
            if hit is not None:
                # a bracket inside a quotation that was never closed does not keep it open
                found.append((stack[hit][0], i, stack[hit][1]))
                for _, o in stack[hit:]:
                    waits.subtract(PAIRS[o])
                del stack[hit:]
            elif c in PAIRS and not (c == '"' and (i + 1 >= b or text[i + 1].isspace())):
                stack.append((i, c))
                waits.update(PAIRS[c])
        if last:
            for i, c in stack[:1]:
                found.append((i, b, c))
        found.sort()
        out: list[tuple[int, int, str]] = []
        for p in found:
            if not out or p[0] > out[-1][1]:
                out.append(p)
        return out

    def _paragraph(self, text: str, a: int, b: int, last: bool) -> Iterator[tuple[int, int]]:
        pairs = self._pairs(text, a, b, last)
        closed, opened = {p[1]: p for p in pairs}, {p[0]: p for p in pairs}
        cuts: list[int] = []
        start = a
        while start < b and text[start].isspace():
            start += 1
        k = 0
        thai = THAI_LETTER(text, a, b) is not None
        self.thai = -1
        events: list[tuple[int, int, str]] = []
        for m in MARK.finditer(text, a, b):
            events.append((m.start(), m.end(), "mark"))
        if thai:
            for m in THAI_GAP.finditer(text, a, b):
                events.append((m.start(), m.end(), "gap"))
        events.extend((q, q + 1, "close") for p, q, _ in pairs if q < b)
        events.sort()
        for s, e, kind in events:
            if s < start:
                continue
            while k < len(pairs) and pairs[k][1] < s:
                k += 1
            inside = k < len(pairs) and pairs[k][0] < s < pairs[k][1]
            if inside:
                continue
            if kind == "close":
                cut = self._after_pair(text, start, closed[s], b)
            elif kind == "gap":
                cut = s if self._thai_gap(text, start, s, e, b, opened) else -1
            else:
                cut = self._after_mark(text, start, s, e, b)
            if cut >= 0:
                cuts.append(cut)
                start = cut
                while start < b and text[start].isspace():
                    start += 1
        begin = a
        for c in [*cuts, b]:
            x, y = begin, c
            while x < y and text[x].isspace():
                x += 1
            while y > x and text[y - 1].isspace():
                y -= 1
            if y > x:
                yield x, y
            begin = c

    @staticmethod
    def _tail(text: str, e: int, b: int) -> int:
        """End of what belongs to a sentence after its mark: closing marks that no mark opened, and emoji."""
        if e < b and text[e] == " " and (e + 1 == b or text[e + 1] < "\xa9"):
            return e  # what nearly always follows
        while e < b and text[e] in CLOSERS and not (text[e] in "\"“'’" and e + 1 < b and not text[e + 1].isspace()):
            e += 1
        return AFTER.match(text, e, b).end()

    def _name(self, word: str) -> bool:
        """Whether a capitalised word is a proper name: neither the document nor the corpus has it in lower case."""
        w = folded(word)
        return len(w) == 1 or ("W" + w not in self.own and w not in self.common)

    def _kind(self, low: str) -> str:
        """What evidence says of a word with a stop: 't' a title or the like, 'a' another abbreviation, 'p' a plain word, '' nothing; the document first, then the corpus."""
        title, held = "T" + low in self.own, "A" + low in self.own
        bare = "W" + low in self.own or "U" + low in self.own
        if (title or held) != bare:
            return "p" if bare else "a" if held else "t"
        return "t" if low in self.titles else "a" if low in self.abbreviations else "p" if low in self.plain else ""

    def _holds(self, token: str, low: str, nxt: str, word: str, unit: bool = False) -> bool:
        """Whether the sentence goes on after a word with a stop: by evidence, and where that leaves it open, by the lists."""
        kind = self._kind(low)
        begins = bool(kind and word) and not self._name(word)
        if kind in ("a", "t") and begins:
            return False
        if kind == "p" and not nxt.isdigit() and (begins or token.islower()):
            return False  # a capitalised one may be a title, and one before a number may count something
        if kind == "t" and not unit:
            return bool(nxt.isdigit() or word)
        if unit or (low in CLOSING and low not in LEADING):
            return False
        if low in LEADING or token in LEADING:
            return True
        return kind == "a" and bool(nxt.isdigit() or word)

    def _after_mark(self, text: str, start: int, s: int, e: int, b: int) -> int:
        """Where the sentence ends with the mark at s..e, or -1."""
        mark = text[s:e]
        tail = self._tail(text, e, b)
        rest = tail
        while rest < b and text[rest].isspace():
            rest += 1
        if rest >= b:
            return tail  # the end of the stretch
        nxt, spaced = text[rest], rest > tail
        if s <= start:
            return -1
        if mark[0] in ".…．":
            if len(mark) > 1 or mark == "…":  # an ellipsis goes on unless a new sentence clearly begins
                return tail if spaced and (nxt.isupper() or nxt in "¿¡") and not (WORD.match(text, rest) and self._name(WORD.match(text, rest)[0])) else -1
            return tail if self._full_stop(text, start, s, tail, rest, b) else -1
        if mark[0] in "!?" and nxt.islower():
            return -1
        if mark[0] in "!?" and not spaced and not (nxt.isupper() or nxt in "¿¡“„«\"(—" or nxt.isdigit() or UNCASED.match(nxt)):
            return -1
        if nxt in "—–-" and self._lower_after(text, rest + 1, b):
            return -1
        if nxt in ",;:،，、；：" or (mark[0] in "？！。" and GOING_ON.match(text, rest) and nxt in "とっ"):
            return -1
        return tail

    @staticmethod
    def _lower_after(text: str, i: int, b: int) -> bool:
        while i < b and text[i].isspace():
            i += 1
        return i < b and text[i].islower()

    def _full_stop(self, text: str, start: int, s: int, tail: int, rest: int, b: int) -> bool:
        nxt, spaced = text[rest], rest > tail
        prev = text[s - 1]
        token = text[self._token(text, start, s) : s].lstrip("'’")
        if (latin := _re(r"(?<=[\p{Han}\p{Hiragana}\p{Katakana}])[\p{Latin}.]+$").search(token)) is not None:
            token = latin[0]  # scripts without spaces
        low = folded(token)
        if nxt.islower() or nxt in ",;:،，、）)":
            return False
        if nxt in "—–" and self._lower_after(text, rest + 1, b):
            return False
        if LIST_NUMBER.fullmatch(text, start, s + 1):
            return False  # the number of a list item
        following = WORD.match(text, rest)
        word = following[0] if following else ""
        if not spaced:
            if prev.isdigit() and nxt.isdigit():
                return False
            if nxt in "“„«(¿¡" and _re(r"[\p{Lu}\p{Nd}¿¡“«]").match(text[rest + 1 : rest + 2]):
                return len(token) != 1 and not self._holds(token, low, nxt, word) or prev in ")»”"
            if not nxt.isupper() or len(word) < 2 or not word[1:].islower():
                return bool(UNCASED.match(nxt)) and not _re(r"\p{Devanagari}").match(nxt) and not token[-1:].isascii() and len(token) > 1 and not self._holds(token, low, nxt, word)
            return len(token) != 1 and not self._holds(token, low, nxt, word) or prev in ")»”"
        if token and UNCASED.match(token[-1]):
            if _re(r"\p{Devanagari}").match(token[-1]):
                return not ("।" in text) and len(token) > 3 and not self._holds(token, low, nxt, word)
            if _re(r"\p{Thai}").match(token[-1]):
                return False  # Thai is cut at its spaces
            return (len(token) > 1 or not token.isalpha()) and not self._holds(token, low, nxt, word)
        if token.isdigit() and spaced:
            return folded(word) not in self.ordinals and word.lower() not in MONTHS
        if not token or not token[-1].isalpha():
            return True
        unit = _re(r"[\d٠-٩०-९]\s*$").search(text, max(start, s - len(token) - 3), s - len(token)) is not None and not nxt.isdigit() and self._kind(low) != "t"
        if _re(r"(?:^|\s)(?:u\.\s?a\.\s?m|u\.\s?[äÄ])$").search(text[max(start, s - 9) : s]):
            return True
        if len(token) == 1 and not unit:
            if token.isupper():  # an initial, unless the word after it is no name
                return bool(word) and not self._name(word) and not self._initial_before(text, s, b)
            return False
        if low == "al" and _re(r"(?:^|\s)et\s+al$").search(text[max(start, s - 9) : s]):
            return False  # alone it is a plain word of Spanish
        return not self._holds(token, low, nxt, word, unit)

    def _token(self, text: str, start: int, s: int) -> int:
        """Where the word before a stop begins."""
        i = s
        while i > start and not BOUND(text[i - 1]):
            i -= 1
        return i

    def _initial_before(self, text: str, s: int, b: int) -> bool:
        """Whether another initial stands before this one."""
        i = s - 2
        while i >= 0 and text[i].isspace():
            i -= 1
        return i > 0 and text[i] == "." and text[i - 1].isupper()

    def _after_pair(self, text: str, start: int, pair: tuple[int, int, str], b: int) -> int:
        """Where the sentence ends after a closed pair, or -1."""
        p, q, c = pair
        inner = text[p + 1 : q].rstrip()
        if not inner:
            return -1
        i = len(inner)
        while i and _re(rf"{EMOJI}|[\p{{Emoji_Modifier}}\uFE0F\u200D\s]").fullmatch(inner[i - 1]):
            i -= 1
        closed = inner[-1] in ENDERS + ".…．" or (0 < i < len(inner) and inner[i - 1] in ENDERS + ".")
        listed = LIST_START.match(text, start)
        opens = p <= start or (listed is not None and listed.end() == p + 1)
        thai = bool(_re(r"\p{Thai}").search(inner))
        tail = AFTER.match(text, q + 1, b).end()
        rest = tail
        while rest < b and text[rest].isspace():
            rest += 1
        if rest >= b:
            return -1  # the end of the stretch ends it anyway
        nxt = text[rest]
        if c in BRACKETS:
            if not opens or inner.isdigit():
                return -1
            if thai and not closed:
                return -1  # left to the gap after it
            return tail if closed and not nxt.islower() and nxt not in ",;:.!?。،，、" else -1
        if not closed:
            return -1
        if nxt.islower() or nxt in ",;:.!?…。！？।؟،，、；：.)）]»”" or (nxt in "—–-" and self._lower_after(text, rest + 1, b)):
            return -1
        if not UNCASED.match(nxt) or nxt.isupper():
            return tail
        if GOING_ON.match(text, rest) and not _re(r"\p{Devanagari}{3,}").match(text[rest : rest + 4]) and not self._plain_word(text, rest):
            return -1
        if opens:
            stop = _re(rf"[{_ENDS}.\n“„«「\"]").search(text, pos=rest, endpos=b)
            clause = text[rest : stop.start() if stop else b]
            return -1 if SAYING.search(clause) else tail
        i = p
        while i > start and text[i - 1].isspace():
            i -= 1
        if i == start or text[i - 1] in ":：,，、" or _re(r"\p{Arabic}|\p{Thai}|\p{Devanagari}").match(nxt):
            return tail
        return -1

    @staticmethod
    def _plain_word(text: str, i: int) -> bool:
        """Whether what looks like a word that goes on is the beginning of a longer Arabic or Thai word."""
        if _re(r"\p{Arabic}").match(text[i]):
            return WORD.match(text, i)[0] not in ("ثم", "فقال", "وقال")
        return _re(r"\p{Thai}").match(text[i]) is not None

    def _thai_gap(self, text: str, start: int, s: int, e: int, b: int, opened: dict[int, tuple[int, int, str]]) -> bool:
        """Whether a space ends a Thai clause."""
        if s <= start:
            return False
        nxt = text[e]
        word = _re(r"\S+").match(text, pos=e, endpos=b)[0]
        if LIST_NUMBER.fullmatch(text, start, s):
            return False
        if self.thai < start:  # the first Thai letter of the unit, looked up once
            found = THAI_LETTER(text, start)
            self.thai = found.start() if found else len(text)
        if self.thai >= s and not _re(r"\p{Thai}").match(nxt):
            return False
        if LIST_START.match(text, e, b):
            return True
        if nxt.isdigit() or _re(rf"{EMOJI}|[-–—,.;:!?%/+=&<>*|]").match(word):
            return False
        if _re(r"\p{Latin}").match(nxt):
            return False
        i = s
        while i > start and not text[i - 1].isspace():
            i -= 1
        last = text[i:s]
        if nxt in "“\"«‘":
            return not last.endswith(("ว่า", ":")) and _re(r"\p{Thai}|[\d”»)]$").search(last) is not None
        if nxt in "([":
            return bool(_re(r"[(\[]\p{Thai}").match(word)) and e in opened and opened[e][1] - e > 15
        if not _re(r"\p{Thai}").match(nxt):
            return False
        if word in THAI_ATTACHED or word.rstrip(".") in THAI_ATTACHED:
            return False
        if last[-1].isdigit():
            number = _re(r"[\p{Nd},.]+").fullmatch(last)
            return not (number and word.startswith(THAI_UNITS))
        if _re(r"\p{Latin}$").search(last):
            return False
        if last.endswith("."):
            return last.rstrip(".") not in ("ดร", "น", "นพ", "รศ", "ผศ", "ม", "พ.ศ", "ค.ศ")
        return last not in THAI_ATTACHED or last in ("เมตร", "ฯลฯ")


def asked_words(text: str) -> set[str]:
    """Words whose evidence splitting may ask for: those before a full stop, and those after one, after an ellipsis or after a number.

    A few may be among them that it does not come to ask about, as that depends on the answers.
    """
    out: set[str] = set()
    for m in MARK.finditer(text):
        s, e = m.span()
        if text[s] not in ".…．":
            continue
        rest = Splitter._tail(text, e, len(text))
        while rest < len(text) and text[rest].isspace():
            rest += 1
        if rest == len(text) or text[rest].islower():
            continue
        if m[0] in ".．":
            i = s
            while i > 0 and not BOUND(text[i - 1]):
                i -= 1
            token = text[i:s]
            if not token or not (token[-1].isalnum() or UNCASED.match(token[-1])):
                continue
            if token.isascii() and token.isalpha():
                out.add(token.lower())
            # a sentence may begin within it, after a mark without a space
            else:
                for k in range(len(token)):
                    if (k == 0 or not token[k - 1].isalpha()) and STOPPED.fullmatch(token, k):
                        out.add(folded(token[k:]))
            if not token.isascii() and (latin := _re(r"(?<=[\p{Han}\p{Hiragana}\p{Katakana}])[\p{Latin}.]+$").search(token)) is not None:
                out.add(folded(latin[0]))
        word = WORD.match(text, rest)
        if word and (word[0].isascii() or not UNCASED.match(word[0])):
            out.add(folded(word[0]))
    return out


FACTS = "key bigint, token string, kind string, n bigint"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch the counts of words by kind; and of each text, by key, the words that it leaves open ('o') and its own answers ('k')."""
    for b in batches:
        total: Counter = Counter()
        plain: Counter = Counter()
        rows = []
        for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            stops, bare, places = _scan(t)
            total.update(stops)
            total.update(places)
            plain.update(bare)
            if asked := asked_words(t):
                words = {(w, "w") for w in asked if bare[w] > 0 and w.islower()}
                if rest := asked - {w for w, _ in words}:
                    words |= {(w, "u") for w in rest.intersection(w.lower() for w, n in bare.items() if n > 0)}
                own = own_answers(stops, words, asked)
                rows.append((key, " ".join(own), "k", 0))
                held, bare = {x[1:] for x in own if x[0] in "AT"}, {x[1:] for x in own if x[0] in "UW"}
                lower = {x[1:] for x in own if x[0] == "W"}
                if left := {w for w in asked if (w in held) == (w in bare) or w not in lower}:
                    rows.append((key, " ".join(left), "o", 0))
        rows += [(None, w, k, n) for (w, k), n in (total + _by_case(plain)).items()]
        kinds = pa.int64(), pa.string(), pa.string(), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["key", "token", "kind", "n"])


#: Verdict on a word from its counts. An abbreviation hardly stands without a stop and has one before a lower-case letter
#: or number more often than elsewhere (of numbers the first does not count, as it may be the very stop in question); a
#: title begins paragraphs with a stop; a plain word hardly has a stop; a common word stands more often in lower case
#: than capitalised within a sentence; a word that mostly follows a number with a stop is counted by it, as a month.
VERDICTS = {
    "a": "a + greatest(d - 1, 0) > b + s AND (w + u) * 10 < a + d",
    "t": "(s > 0 OR (z + 1) * 20 < b) AND (w + u) * 10 < a + b + d + s",
    "p": "(a + b + d + s) * 10 < w AND listed",
    "c": "w > c",
    "o": "n * 2 > u + a + b + d + s + z",
}


def corpus_verdicts(facts: DataFrame) -> DataFrame:
    """(token, verdict) from the counts of all words, which compare counts of one word with each other and so are the same for a corpus of any size."""
    n = {k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in "abdszwucn"}
    counts = facts.where("kind NOT IN ('o', 'k')").groupBy("token").agg(*n.values()).withColumn("listed", F.col("token").isin(*sorted(LEADING)))
    verdicts = F.array(*(F.when(F.expr(rule), v) for v, rule in VERDICTS.items()))
    return counts.select("token", F.explode(F.array_compact(verdicts)).alias("verdict"))


def sentence_units(documents: DataFrame) -> DataFrame:
    """(doc_id, start_char, end_char): the sentence units of each row's text, in code points, end exclusive.

    Together the units hold every character that is not white space. No rows for null, empty and blank texts; repeated
    rows have the same units each; a text of any length is split as a whole; other columns are ignored.
    """
    ship(documents.sparkSession)
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text")).where("text <> ''").withColumn("key", F.xxhash64("doc_id", "text"))
    facts = checkpoint(texts.select("key", "text").mapInArrow(_facts, FACTS))
    parts = max(1, texts.rdd.getNumPartitions())  # the splitting is spread as the texts came
    word = F.explode(F.split("token", " ")).alias("token")
    asked = facts.where("kind = 'o'").select("key", word).join(corpus_verdicts(facts), "token").select("key", F.concat("verdict", "token").alias("answer"))
    own = facts.where("kind = 'k' AND token <> ''").select("key", word).withColumnRenamed("token", "answer")
    # equal keys share their answers, which are those of the words whatever text asks
    answers = asked.unionByName(own).repartition(parts, "key").groupBy("key").agg(F.collect_set("answer").alias("answers"))
    known = texts.repartition(parts, "key").join(answers, "key", "left").select("doc_id", "text", "answers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends = [], [], []
            for i, (t, given) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                given = given or ()
                splitter = Splitter(*(frozenset(x[1:] for x in given if x[0] == k) for k in "acpto"))
                for s, e in splitter.spans(t, frozenset(given)):
                    ids.append(i)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "start_char", "end_char"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return known.mapInArrow(run, f"doc_id {kind}, start_char int, end_char int")
