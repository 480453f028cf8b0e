"""Personal data with offset-preserving deobfuscation.

Base spans come from the plain patterns on the text as it is. Then a chain of
transducers rewrites disguises (look-alike characters and digits of other scripts,
invisible characters, spelled digits, ``[at]`` and ``dot`` forms) while carrying, for
each rewritten character, the range of source characters it stands for; the same
patterns run over the rewritten text and their spans are mapped back to the source.

Defined cases: a null or empty text has no spans; very long texts are read whole (each
pattern is linear in the text); repeated rows are read one by one; an empty table gives
an empty result; carried columns that clash with result columns give way to them.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larder.llm.columns import map_text

KINDS = ("email", "ip", "card", "phone")
FIELDS = [*[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()),
          T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())]

Span = tuple[str, int, int]

# fixed values: the base patterns, with a possessive form where a retry cannot match
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
#: Cheap necessary condition of the number patterns.
HAS_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches: the local part is the whole run of its characters before an @."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and not LOCAL_END.match(text[start - 1]):
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return out


def detect(text: str) -> list[Span]:
    """The base spans of a text, by kind and start."""
    out = emails(text)
    if HAS_DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in IP.finditer(text)
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = "".join(DIGITS.findall(m.group()))
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text)
                    if 8 <= sum(len(d) for d in DIGITS.findall(m.group())) <= 15]
    return out


# fixed values: letters of other scripts that look like Latin ones, and their Latin forms
LOOKALIKE = dict(zip("аеорсухівјѕһԁԛԝкмтАВЕКМНОРСТУХІЈЅԌαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
                     "aeopcyxibjshdqwkmtABEKMHOPCTYXIJSGaeiknoptuxABEZHIKMNOPTYX", strict=True))
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
PUNCTUATION = dict(zip("\u3002\uff0e\uff61\u2024\u2010\u2011\u2012\u2013\u2014\u2212\uff20\ufe6b\uff0b\ufe62\uff08\uff09"
                       "\u00a0\u202f\u2009\u3000", "....------@@++()\x20\x20\x20\x20", strict=True))
# fixed values: spelled digits and separators
SPELLED = dict(zip("zero oh one two three four five six seven eight nine".split(), "00123456789", strict=True))
WORD_DIGIT = "|".join(SPELLED)


def lower(word: str) -> str:
    """A matched word in plain lower case: without regard to case, i and s also match their
    dotless, dotted and long forms."""
    return word.lower().replace("\u0307", "").replace("ı", "i").replace("ſ", "s")


def plain(c: str) -> str | None:
    """What a single character stands for; None to leave it."""
    if c in INVISIBLE:
        return ""
    if c in PUNCTUATION:
        return PUNCTUATION[c]
    if c in LOOKALIKE:
        return LOOKALIKE[c]
    if ord(c) < 0x250:
        return None
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    # full-width, mathematical and enclosed forms of one ASCII character
    form = unicodedata.normalize("NFKC", c)
    return form if len(form) == 1 and form.isascii() else None


#: Characters that a rewrite can start from: beyond Latin, or invisible or odd spaces.
STRANGE = re.compile("[\u00a0\u00ad\u0250-\U0010ffff]")
OPEN, SHUT = r"[\[({<]", r"[\])}>]"
AT = re.compile(rf"(?<!\s)\s*+{OPEN}\s*(?:at|@|ät|arroba|arobase)\s*{SHUT}\s*|&(?:#0*64|#x0*40|commat);|(?<=[A-Za-z0-9])%40(?=[A-Za-z0-9])", re.I)
DOT = re.compile(rf"(?<!\s)\s*+{OPEN}\s*(?:dot|\.|punkt|point|punto)\s*{SHUT}\s*|&(?:#0*46|#x0*2e|period);", re.I)
#: A whole address in words: `name at host dot tld`, each part on its own; at most eight
#: more dotted parts on either side.
SPOKEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]++(?:(?:\.|\s+dot\s+)[A-Za-z0-9_%+-]++){0,8}?"
                    r"(?:\s+at\s+|\s*@\s*)[A-Za-z0-9-]++(?:(?:\s+dot\s+|\s*\.\s*)[A-Za-z0-9-]++){0,8}?"
                    r"(?:\s+dot\s+|\s*\.\s*)[A-Za-z]{2,24}(?![A-Za-z0-9-])", re.I)
SPOKEN_AT, SPOKEN_DOT = re.compile(r"\s+at\s+|\s*@\s*", re.I), re.compile(r"\s+dot\s+|\s*\.\s*", re.I)
#: A run of spelled or plain digits with `dot`, `dash`, `plus`, `double` and `triple`.
DIGIT = rf"(?:(?:double|triple)\s+)?(?:\b(?:{WORD_DIGIT})\b|[0-9])"
BETWEEN = r"[\s.,-]*(?:(?:dot|point|dash|minus)[\s.,-]*)?"
NUMBER = re.compile(rf"(?<![A-Za-z0-9])(?:plus\s+)?{DIGIT}(?:{BETWEEN}{DIGIT})+(?![A-Za-z0-9])", re.I)
NUMBER_PART = re.compile(rf"(plus)\s+|[\s,]*\b(dot|point)\b[\s,]*|[\s,]*\b(?:dash|minus)\b[\s,]*"
                         rf"|(?:(double|triple)\s+)?(?:\b({WORD_DIGIT})\b|([0-9]))|([.-])|[\s,]+", re.I)
TIMES = {"double": 2, "triple": 3}
#: What a rewrite of NUMBER needs: two digits with a word among or before them. Built from
#: the same parts, so that it holds wherever NUMBER matches something to rewrite.
SPELLED_ANY = re.compile(rf"\b(?:{WORD_DIGIT})\b{BETWEEN}(?:\b(?:{WORD_DIGIT})\b|[0-9])|[0-9]{BETWEEN}\b(?:{WORD_DIGIT})\b"
                         rf"|[0-9][\s.,-]*(?:dot|point|dash|minus)[\s.,-]*[0-9]|(?:plus|double|triple)\s+{DIGIT}", re.I)
#: What a rewrite of SPOKEN needs if there is no @: both words.
AT_WORD, DOT_WORD = re.compile(r"\sat\s", re.I), re.compile(r"\sdot\s", re.I)


class Rewritten:
    """A text with, for each character, the source range it stands for and whether a
    rewrite made it."""

    def __init__(self, text: str, starts: list[int], ends: list[int], made: list[bool]):
        self.text, self.starts, self.ends, self.made = text, starts, ends, made

    @classmethod
    def of(cls, text: str) -> Rewritten:
        return cls(text, list(range(len(text))), list(range(1, len(text) + 1)), [False] * len(text))

    def replaced(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """With each [start, end) range replaced by a string. Every character of the
        string stands for the whole range; a range replaced by nothing goes to the
        character before it."""
        if not edits:
            return self
        text, starts, ends, made, at = [], [], [], [], 0
        for lo, hi, new in edits:
            text.append(self.text[at:lo])
            starts += self.starts[at:lo]
            ends += self.ends[at:lo]
            made += self.made[at:lo]
            text.append(new)
            if new:
                starts += [self.starts[lo]] * len(new)
                ends += [self.ends[hi - 1]] * len(new)
                made += [True] * len(new)
            elif made:
                made[-1] = True
            at = hi
        text.append(self.text[at:])
        return Rewritten("".join(text), starts + self.starts[at:], ends + self.ends[at:], made + self.made[at:])


def _characters(r: Rewritten) -> Rewritten:
    return r.replaced([(m.start(), m.end(), new) for m in STRANGE.finditer(r.text) if (new := plain(m.group())) is not None])


def _at_dot(r: Rewritten) -> Rewritten:
    r = r.replaced([(m.start(), m.end(), "@") for m in AT.finditer(r.text)])
    r = r.replaced([(m.start(), m.end(), ".") for m in DOT.finditer(r.text)])
    edits = []
    for m in SPOKEN.finditer(r.text):
        whole = m.group()
        if not re.search(r"\sdot\s", whole, re.I) and not re.search(r"\s@|@\s", whole):
            continue  # `name at host. Next` is prose, `name@host.tld` needs no rewrite
        if re.search(r"\sat\s", whole, re.I) and re.search(r"\s\.|\.\s", whole):
            continue
        own = [(m.start() + x.start(), m.start() + x.end(), "@") for x in SPOKEN_AT.finditer(whole) if x.group() != "@"]
        own += [(m.start() + x.start(), m.start() + x.end(), ".") for x in SPOKEN_DOT.finditer(whole) if x.group() != "."]
        edits += sorted(own)
    return r.replaced(edits)


def _digits(r: Rewritten) -> Rewritten:
    edits = []
    for m in NUMBER.finditer(r.text):
        whole = m.group()
        if not re.search(r"[A-Za-z]", whole):
            continue
        for x in NUMBER_PART.finditer(whole):
            plus, dot, times, word, digit, mark = x.groups()
            digit = SPELLED[lower(word)] if word else digit
            new = "+" if plus else "." if dot else digit * TIMES.get(lower(times or ""), 1) if digit else mark or ""
            if x.group() != new:
                edits.append((m.start() + x.start(), m.start() + x.end(), new))
    return r.replaced(edits)


def hints(text: str) -> tuple[bool, bool, bool]:
    """Necessary conditions of the three transducers: where one is false, its transducer
    rewrites nothing."""
    try:
        text.encode("latin-1")
        strange = "\u00a0" in text or "\u00ad" in text
    except UnicodeEncodeError:
        strange = True
    low = text.lower()
    at_dot = (any(x in low for x in ("@", "[", "(", "{", "<", "%40", "&#", "&commat", "&period"))
              or "dot" in low and bool(DOT_WORD.search(text)) and bool(AT_WORD.search(text)))
    return strange, at_dot, bool(SPELLED_ANY.search(text))


def added(text: str, base: list[Span]) -> list[Span]:
    """Spans that show only after rewriting, in source positions. A span counts if a
    rewritten character lies in it and no base span of its kind covers it."""
    strange, at_dot, digits = hints(text)
    if not (strange or at_dot or digits):
        return []
    r = Rewritten.of(text)
    if strange:
        r = _characters(r)
    if r.made.count(True) or at_dot:
        r = _at_dot(r)
    if digits or r.made.count(True):
        r = _digits(r)
    if True not in r.made:
        return []
    found = []
    for kind, lo, hi in detect(r.text):
        if True in r.made[lo:hi]:
            span = (kind, r.starts[lo], r.ends[hi - 1])
            if not any(k == kind and s <= span[1] and span[2] <= e for k, s, e in base):
                found.append(span)
    return found


def joined(spans: list[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{lo}:{hi}" for k, lo, hi in ordered)


def describe(text: str | None) -> tuple:
    base = detect(text) if text else []
    more = added(text, base) if text else []
    return (*[sum(s[0] == k for s in base) for k in KINDS], hashlib.sha256(joined(base).encode()).hexdigest(),
            joined(base + more), len(more))


def find_pii(df: DataFrame, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """``df`` with the base counts and their digest, and all spans (``kind:start:end`` in
    code points) of every text."""
    def make():
        def run(column: pa.Array) -> list[pa.Array]:
            rows = list(zip(*[describe(x) for x in column.to_pylist()])) or [()] * len(FIELDS)
            return [pa.array(x, pa.string() if f.dataType == T.StringType() else pa.int64()) for x, f in zip(rows, FIELDS)]
        return run

    return map_text(df, text, FIELDS, make, carry)


def redacted(text: str, spans: str) -> str:
    """The text with every span replaced by its kind; overlapping spans go as one, named
    for the first."""
    out, at = [], 0
    ordered = sorted((int(lo), int(hi), k) for k, lo, hi in (s.split(":") for s in spans.split(",") if s))
    merged: list[list] = []
    for lo, hi, k in ordered:
        if merged and lo < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi, k])
    for lo, hi, k in merged:
        out += [text[at:lo], f"<{k.upper()}>"]
        at = hi
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``df`` with the personal data in its texts replaced, and ``n_chars`` (if there is
    such a column) set to the new length; every other column as it is."""
    names = df.columns
    fields = [T.StructField(text, T.StringType())]
    if n_chars in names:
        fields.append(T.StructField(n_chars, T.LongType()))

    def make():
        def run(column: pa.Array) -> list[pa.Array]:
            new = [None if x is None else redacted(x, describe(x)[5]) for x in column.to_pylist()]
            return [pa.array(new, pa.string()), pa.array([None if x is None else len(x) for x in new], pa.int64())][:len(fields)]
        return run

    return map_text(df, text, fields, make).select(*[f"`{c}`" for c in names])
