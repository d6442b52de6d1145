"""Personal data in plain and disguised form, with spans in the source text.

Plain matches (``base``) come first and always stay. A chain of small transducers then rewrites the text while carrying,
for every character, the span of source characters it stands for: homoglyphs and full-width forms become ASCII and
ignorable characters vanish; coded, bracketed or spelled ``at`` and ``dot`` become ``@`` and ``.``; spelled digits become digits
and join up. A bare ``at`` before an ordinary host is left alone unless its host or local part is disguised too. The same detectors run on the result, and what they find is mapped back. Only finds that touch a rewritten
character, and that do not lie inside a plain match of the same kind, are added.

Null and empty texts have no spans. Offsets are code points, end exclusive. Each repeated row gets its own result.
"""

from __future__ import annotations

import re
import unicodedata
from hashlib import sha256

from pyspark.sql import DataFrame

from .common import map_texts

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Letters that look like ASCII letters, by the letter they imitate.
LOOKALIKES = {
    "a": "аαɑ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "h": "һ", "i": "іıι", "j": "ј", "k": "κ", "l": "ӏⅼ", "m": "ⅿ", "n": "ո",
    "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "τ", "u": "υս", "v": "νѵ", "w": "ԝѡ", "x": "хχ", "y": "уγ",
    "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ",
    "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
}
# Ranges of characters that are ignored when shown (soft hyphen, joiners, bidi marks, variation selectors, tags).
IGNORABLE = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8),
    (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
INVISIBLE = frozenset(chr(c) for first, last in IGNORABLE for c in range(first, last + 1))
# Spelled digits by language, zero first.
SPELLED = (
    "zero one two three four five six seven eight nine".split(),
    "zéro un deux trois quatre cinq six sept huit neuf".split(),
    "null eins zwei drei vier fünf sechs sieben acht neun".split(),
    "cero uno dos tres cuatro cinco seis siete ocho nueve".split(),
)
DIGIT_OF = {w: str(i) for words in SPELLED for i, w in enumerate(words)} | {"oh": "0"}
AT_WORDS, DOT_WORDS = "at|arobase|arroba|ät", "dot|point|punkt|punto"


def _folded(ch: str) -> str | None:
    """The ASCII text a single non-ASCII character imitates; None if it is no disguise."""
    if ch in INVISIBLE:
        return ""
    kind = unicodedata.category(ch)
    if kind == "Nd":
        return str(unicodedata.digit(ch))
    if kind == "Zs":
        return " "
    if kind == "Pd" or ch == "−":
        return "-"
    if ch in "․。｡·∙":
        return "."
    plain = unicodedata.normalize("NFKC", ch)
    return plain if plain != ch and plain.isascii() and len(plain) == 1 else None


FOLDS = {other: ascii_ for ascii_, others in LOOKALIKES.items() for other in others}
FOLDS |= {ch: to for ch in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(ch) < 0xE000
          and ch not in FOLDS and (to := _folded(ch)) is not None}
FOLDS |= {ch: to for ch in map(chr, range(0x1D400, 0x1D800)) if (to := _folded(ch)) is not None}
FOLDS |= dict.fromkeys(INVISIBLE, "")
# A class of thousands of characters is slow to test, so candidates are found by this one and looked up.
NOT_ASCII = re.compile(r"[^\x00-\x7f]")

_DIGIT_WORDS = "|".join(sorted(DIGIT_OF, key=len, reverse=True))
#: Three or more digits in a row of which words are some, apart by space, hyphen, comma, dot or nothing but a border.
DIGIT_RUN = re.compile(rf"(?<!\w)(?:{_DIGIT_WORDS}|\d+)(?:[ ,_-]{{1,2}}(?:{_DIGIT_WORDS}|\d+)){{2,}}(?!\w)", re.I)
# What a rewritten digit word has behind or before it: a further digit of a run, or the dot of an address.
DIGIT_BEHIND = re.compile(rf"[ ,_-]{{1,2}}(?:{_DIGIT_WORDS}|\d)|\.\w", re.I)
DIGIT_BEFORE = re.compile(r"\d[ ,_-]{1,2}\Z|\w\.\Z")
SPELLED_WORD = re.compile(rf"(?<!\w)(?:{_DIGIT_WORDS})(?!\w)", re.I)
ALNUM = re.compile(r"[^\W_]+")
BRACKET_AT = re.compile(rf"\s*[\[({{<]\s*(?:{AT_WORDS}|@)\s*[\])}}>]\s*", re.I)
BRACKET_DOT = re.compile(rf"\s*[\[({{<]\s*(?:{DOT_WORDS}|\.)\s*[\])}}>]\s*", re.I)
_SEP = r"[\s_-]{1,2}"
# Ends of host names that a disguise in plain words must have, so that prose is left alone.
TOP_LEVEL = "com|org|net|edu|gov|int|mil|info|biz|io|co|me|eu|de|fr|es|it|uk|us|ch|at|be|nl|pt|pl|se|no|dk|fi|ie|ca|au|in|jp|cn|br|mx|ar|ru|test|example"
_LABELS = rf"(?:[A-Za-z0-9-]+(?:{_SEP}(?:{DOT_WORDS}){_SEP}|\.))+(?:{TOP_LEVEL})(?![\w])"
WORD_AT = re.compile(rf"(?<=[A-Za-z0-9])(?:{_SEP}(?:{AT_WORDS}){_SEP})(?={_LABELS})", re.I)
# A bare "at" before an ordinary host is prose ("we look at example.com") unless something else is disguised as well.
DOT_WORD = re.compile(rf"{_SEP}(?:{DOT_WORDS}){_SEP}", re.I)
HOST_AHEAD = re.compile(_LABELS, re.I)
LOCAL_DOT = re.compile(rf"[A-Za-z0-9]{_SEP}dot{_SEP}[A-Za-z0-9]+\Z", re.I)
# Capitals after a small letter or digit are a disguise by themselves, whatever the ending.
CAPITAL_AT = re.compile(rf"(?<=[a-z0-9]){_SEP}AT{_SEP}(?=(?:[a-z0-9-]+(?:{_SEP}DOT{_SEP}|\.))+[a-z]{{2,}}(?!\w))")
# The two signs as character references and in percent form.
CODED = re.compile(r"\s?(?:&#0*64;|&#x0*40;|&commat;)\s?|%40(?=[A-Za-z0-9])", re.I)
CODED_DOT = re.compile(r"&#0*46;|&#x0*2e;|&period;|(?<=[A-Za-z0-9])%2e(?=[A-Za-z0-9])", re.I)
WORD_DOT = re.compile(rf"(?<=[A-Za-z0-9])(?:{_SEP}(?:{DOT_WORDS}){_SEP})(?=[A-Za-z0-9])", re.I)
SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])(?:\s{1,2}@\s{0,2}|@\s{1,2})(?=[A-Za-z0-9-]+\s?\.\s?[A-Za-z0-9-]+)")
SPACED_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?:\s\.\s?[A-Za-z0-9-]+)+")
BLANK_DOT = re.compile(r"\s\.\s?")
DOT_BEFORE, DOT_AFTER = re.compile(r"\w\."), re.compile(r"\.\w")
PLUS = re.compile(rf"(?<!\w)plus[ -]{{1,2}}(?=\d|(?:{_DIGIT_WORDS})\b)", re.I)
# Inner part of both bracket patterns: it starts at a bracket, so it is quick to test.
BRACKET = re.compile(rf"[\[({{<]\s*(?:{AT_WORDS}|{DOT_WORDS}|@|\.)\s*[\])}}>]", re.I)
_AT_SET, _DOT_SET = frozenset(AT_WORDS.split("|")), frozenset(DOT_WORDS.split("|"))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def find_plain(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every plain match; leftmost and non-overlapping within its kind, failing ones dropped."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        # The local part cannot hold an at-sign, so each sign has one leftmost start: as far left as its characters go.
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


class Mapped:
    """A text whose characters know their source span and whether a transducer wrote them."""

    def __init__(self, text: str):
        # The maps are filled in at the first rewrite; most texts have none.
        self.text, self.starts, self.ends, self.changed = text, None, None, bytearray()

    def rewrite(self, pieces: list[tuple[int, int, str]]) -> None:
        """Replace ascending, disjoint ranges by ASCII text; each new character stands for the whole range."""
        if not pieces:
            return
        if self.starts is None:
            n = len(self.text)
            self.starts, self.ends, self.changed = list(range(n)), list(range(1, n + 1)), bytearray(n)
        text, starts, ends, changed, last = [], [], [], bytearray(), 0
        for a, b, new in [*pieces, (len(self.text), len(self.text), "")]:
            text.append(self.text[last:a])
            starts += self.starts[last:a]
            ends += self.ends[last:a]
            changed += self.changed[last:a]
            if a < b:
                text.append(new)
                starts += [self.starts[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
                changed += b"\1" * len(new)
                if not new and changed:  # what vanished still counts as a disguise of its neighbour
                    changed[-1] = 1
            last = b
        self.text, self.starts, self.ends, self.changed = "".join(text), starts, ends, changed


def _lower(text: str) -> str:
    """Lower case of the same length, with the letters that a pattern without case takes for i and s replaced."""
    low = text.lower() if "\u0130" not in text else text.replace("\u0130", "i").lower()
    return low if low.isascii() else low.replace("\u0131", "i").replace("\u017f", "s")


def _digits_meet(text: str, low: str, words: set[str]) -> bool:
    """Whether one of ``words`` stands where a digit word is rewritten: next to another digit, or at a dot of an address."""
    for word in words:
        at = low.find(word)
        while at >= 0:
            end = at + len(word)
            if DIGIT_BEHIND.match(text, end) or DIGIT_BEFORE.search(text[max(0, at - 3):at]):
                return True
            at = low.find(word, end)
    return False


def _word_ats(m: Mapped) -> list[tuple[int, int, str]]:
    """Words for the at-sign whose host or local part is disguised too, or that are joined by underscores."""
    out = []
    for x in WORD_AT.finditer(m.text):
        host, local = HOST_AHEAD.match(m.text, x.end()).end(), x.start()
        while local and m.text[local - 1] in LOCAL_CHARS:
            local -= 1
        if ((x[0][0] == x[0][-1] == "_") or DOT_WORD.search(m.text, x.end(), host) or any(m.changed[local:host])
                or LOCAL_DOT.search(m.text[max(0, x.start() - 80):x.start()])):
            out.append((x.start(), x.end(), "@"))
    return out


def _digit_pieces(text: str) -> list[tuple[int, int, str]]:
    """Spelled digits, and the separators on either side of one, inside runs of at least three digits."""
    out = []
    for run in DIGIT_RUN.finditer(text):
        words = list(SPELLED_WORD.finditer(text, run.start(), run.end()))
        if not words:
            continue
        last = run.start()
        for w in words:
            if last < w.start() and w.start() > run.start() and not text[last:w.start()].strip(" ,_-"):
                out.append((last, w.start(), ""))
            elif w.start() > run.start() and not text[w.start() - 1].isalnum():
                back = w.start()
                while back > last and text[back - 1] in " ,_-":
                    back -= 1
                out.append((back, w.start(), ""))
            out.append((w.start(), w.end(), DIGIT_OF[_lower(w[0])]))
            last = w.end()
        ahead = last
        while ahead < run.end() and text[ahead] in " ,_-":
            ahead += 1
        if last < ahead < run.end():
            out.append((last, ahead, ""))
    return [p for p in out if p[0] < p[1]]


def normalised(text: str) -> Mapped:
    """The text after all transducers, in order.

    A transducer is left out only where its pattern cannot match: every word in a pattern stands between other characters
    than letters and digits, so it must be among the words of the text.
    """
    m = Mapped(text)
    if not text.isascii() and not FOLDS.keys().isdisjoint(text):
        m.rewrite([(x.start(), x.end(), FOLDS[x[0]]) for x in NOT_ASCII.finditer(m.text) if x[0] in FOLDS])
    if "&" in m.text or "%" in m.text:
        m.rewrite([(x.start(), x.end(), "@") for x in CODED.finditer(m.text)])
        m.rewrite([(x.start(), x.end(), ".") for x in CODED_DOT.finditer(m.text)])
    if BRACKET.search(m.text):
        m.rewrite([(x.start(), x.end(), "@") for x in BRACKET_AT.finditer(m.text)])
        m.rewrite([(x.start(), x.end(), ".") for x in BRACKET_DOT.finditer(m.text)])
    # The rewrites below never join or make words, so these stay a superset.
    words = set(ALNUM.findall(_lower(m.text)))
    if not words.isdisjoint(_AT_SET):
        m.rewrite([(x.start(), x.end(), "@") for x in CAPITAL_AT.finditer(m.text)])
        m.rewrite(_word_ats(m))
    if not words.isdisjoint(_DOT_SET):
        m.rewrite([(x.start(), x.end(), ".") for x in WORD_DOT.finditer(m.text)])
    if "@" in m.text:
        m.rewrite([(x.start(), x.end(), "@") for x in SPACED_AT.finditer(m.text)])
        m.rewrite([(d.start(), d.end(), ".") for x in SPACED_HOST.finditer(m.text) for d in BLANK_DOT.finditer(m.text, x.start(), x.end())])
    if "plus" in words:
        m.rewrite([(x.start(), x.end(), "+") for x in PLUS.finditer(m.text)])
    digits = words & DIGIT_OF.keys()
    if not digits or not _digits_meet(m.text, _lower(m.text), digits):
        return m
    m.rewrite(_digit_pieces(m.text))
    # A spelled digit between dots is part of an address of four numbers.
    m.rewrite([(x.start(), x.end(), DIGIT_OF[_lower(x[0])]) for x in SPELLED_WORD.finditer(m.text)
               if DOT_BEFORE.search(m.text, max(0, x.start() - 2), x.start()) or DOT_AFTER.match(m.text, x.end())])
    return m


def find_all(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Plain spans, and those that the transducers add."""
    plain = find_plain(text)
    m = normalised(text)
    if not any(m.changed):
        return plain, []
    added = set()
    for kind, a, b in find_plain(m.text):
        if any(m.changed[a:b]):
            start, end = m.starts[a], m.ends[b - 1]
            if not any(k == kind and s <= start and end <= e for k, s, e in plain):
                added.add((kind, start, end))
    return plain, sorted(added, key=_order)


def _order(span: tuple[str, int, int]) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=_order))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Every found stretch replaced by its kind in angle brackets; overlapping finds become one stretch."""
    out, last = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=_order):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[last:a], f"<{kind}>"]
        last = b
    return "".join([*out, text[last:]])


def detect_pii(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the spans as an array (with ``plain`` telling the plain ones apart) and the redacted text."""

    def make():
        def work(texts):
            spans, clean = [], []
            for t in texts:
                plain, more = find_all(t or "")
                spans.append([{"kind": k, "start": a, "end": b, "plain": p} for p, found in ((True, plain), (False, more))
                              for k, a, b in found])
                clean.append(t if t is None else redacted(t, plain + more))
            return {"spans": spans, "redacted": clean}

        return work

    return map_texts(df, [text], "spans array<struct<kind string, start long, end long, plain boolean>>, redacted string",
                     make, keep)


def redact(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the ``redacted`` text alone; a null text stays null."""

    def make():
        def work(texts):
            return {"redacted": [t if t is None else redacted(t, [s for part in find_all(t) for s in part]) for t in texts]}

        return work

    return map_texts(df, [text], "redacted string", make, keep)


def span_digest(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts of plain spans by kind, their hash, and all spans as text."""

    def make():
        def work(texts):
            out = {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": []}
            for t in texts:
                plain, more = find_all(t or "")
                for k in KINDS:
                    out[f"n_{k}"].append(sum(s[0] == k for s in plain))
                out["base_sha256"].append(sha256(joined(plain).encode()).hexdigest())
                out["spans"].append(joined(plain + more))
            return out

        return work

    return map_texts(df, [text], "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
                     make, keep)
