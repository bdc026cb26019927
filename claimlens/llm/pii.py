"""Personal data found under disguise, with spans of the source text.

Base detectors find e-mail addresses, IP addresses, card and phone numbers in the text as it stands. Then rewriting
transducers run one after the other, each carrying for every output character the source characters it stands for:
look-alike characters and digits of other scripts become ASCII and invisible characters vanish; digits spelled as words
(four or more in a row, or any amid the digits of a number) become digits, ``plus`` before them a plus sign; ``at`` and ``dot`` in
brackets, or spelled out together, between blanks or inside one token between ``_`` or ``-``, become ``@`` and ``.``; blanks between single
letters before an ``@`` and round its signs vanish. Spelled-out addresses need a last label from a fixed list or of two letters that are no common word;
where only ``at`` is spelled, the local part must look like an account, since "look at firma.com" is plain speech. The base detectors run again on the result, and spans found there are mapped back to the source.
A span that a base span of its kind already covers is not added. A text without any trigger skips the rewriting.

Detection is linear in the text: starts inside a run that has failed are not tried again. Nothing is shuffled.

Defined results: a null or empty text has no spans. Repeated rows and null ids are treated like any other row. Spans are
code points, end exclusive, by start, then kind (email, ip, card, phone), then end. Other columns are not read by
``spans``; ``redacted`` keeps them all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Look-alikes, fixed values: source characters and the ASCII characters they stand for, in order.
ALIKE = dict(zip(
    "АВЕЅІЈКМНОРСТХУаеѕіјорсхуһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανι" "–—‐‑‒―−﹣․‧。｡∙﹒﹫⓪①②③④⑤⑥⑦⑧⑨",
    "ABESIJKMHOPCTXYaesijopcxyhdqwABEZHIKMNOPTYXoavi" "--------" "......" "@0123456789", strict=True))
ALIKE |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full-width forms
ALIKE |= {chr(base + d): str(d) for base in (0x660, 0x6F0, 0x966, 0x9E6, 0xE50, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
ALIKE |= {chr(c): str(d) for c, d in ((0xB2, 2), (0xB3, 3), (0xB9, 1), (0x2070, 0), *((0x2070 + k, k) for k in range(4, 10)), *((0x2080 + k, k) for k in range(10)))}
ALIKE |= {chr(c): " " for c in (0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)}
ALIKE |= {chr(c): "" for c in (0xAD, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF)}
LATIN_STRANGE = [c for c in ALIKE if c <= "\xff"]
STRANGE = re.compile("[" + "".join(map(re.escape, ALIKE)) + "]")

# Spelled digits in four languages, fixed values, 0 to 9.
SPELLED = {w: str(d) for words in (
    "zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve",
) for d, w in enumerate(words.split())} | {"oh": "0"}
_WORD = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
DOT_WORDS = ("dot", "punto", "punkt", "point")
_DOT = rf"(?:{'|'.join(DOT_WORDS)})"
AT_WORDS = ("at", "arroba", "arobase")
_AT = rf"(?:{'|'.join(AT_WORDS)})"
_GAP = rf"(?:[\s,_-]{{1,3}}|\s*\.\s*|\s+{_DOT}\s+)"
RUN = re.compile(rf"(?:\bplus{_GAP})?\b{_WORD}(?:{_GAP}{_WORD}\b){{3,}}", re.IGNORECASE)
RUN_PART = re.compile(rf"(plus)|({_WORD})\b|(\.|{_DOT})|[\s,_-]+", re.IGNORECASE)
NUMBER_DOT = re.compile(rf"(?<=[0-9])\s*[\[({{<]?\s*\b{_DOT}\b\s*[\])}}>]?\s*(?=[0-9])", re.IGNORECASE)
BRACKET_AT = re.compile(rf"\s?[\[({{<]\s?{_AT}\s?[\])}}>]\s?", re.IGNORECASE)
BRACKET_SIGN = re.compile(r"\s?[\[({<]\s?([@.])\s?[\])}>]\s?")
BRACKET_DOT = re.compile(rf"\s?[\[({{<]\s?{_DOT}\s?[\])}}>]\s?", re.IGNORECASE)
BRACKETS = re.compile(rf"[\[({{<]\s?(?:@|\.|{_AT}|{_DOT})\s?[\])}}>]")
# Last labels that make a spelled-out "at ... dot ..." an address, fixed values.
TOP = ("com org net edu gov mil int info biz io co uk de fr es it nl eu us ca au ch at be jp cn in br ru pl se no dk fi pt mx ar"
       " app dev ai me tv xyz online site example test invalid local").split()
# Two-letter labels count as a country's unless they are common words, fixed values.
NOT_COUNTRY = "am an as by do he hi if is my of oh ok on or so to up we".split()
_LABEL = r"[A-Za-z0-9-]+"
_LAST = rf"(?:{'|'.join(TOP)}|(?!(?:{'|'.join(NOT_COUNTRY)})(?![A-Za-z]))[A-Za-z]{{2}})(?![A-Za-z0-9-])"
SPELLED_OUT = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+((?:\s{{1,4}}{_DOT}\s{{1,4}}[A-Za-z0-9._%+-]+)*)(?:\s{{1,4}}{_AT}\s{{1,4}}|\s{{0,4}}@\s{{0,4}}){_LABEL}"
    rf"(?:(?:\s{{1,4}}{_DOT}\s{{1,4}}|\.){_LABEL})*\s{{1,4}}{_DOT}\s{{1,4}}{_LAST}", re.IGNORECASE)
SPELLED_SIGN = re.compile(rf"\s+({_AT})\s+|\s*(@)\s*|\s+{_DOT}\s+", re.IGNORECASE)
# "jane.doe at firma.com": the dot stands as it is, so the local part must look like an account (it holds a digit or one of . _ + %).
PLAIN_DOT = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?=[A-Za-z%+-]*[0-9._+%])[A-Za-z0-9._%+-]*[A-Za-z0-9](\s{{1,4}}{_AT}\s{{1,4}}){_LABEL}(?:\.{_LABEL})*\.{_LAST}", re.IGNORECASE)
# "jane_at_firma_dot_com": one token, its signs between _ or -.
TOKEN = re.compile(r"[A-Za-z0-9._%+-]+")
JOINED_AT = re.compile(rf"(?<=[A-Za-z0-9])[_-]{{1,3}}{_AT}[_-]{{1,3}}(?=[A-Za-z0-9])", re.IGNORECASE)
JOINED_DOT = re.compile(rf"(?<=[A-Za-z0-9])[_-]{{1,3}}{_DOT}[_-]{{1,3}}(?=[A-Za-z0-9])", re.IGNORECASE)
JOINED_LAST = re.compile(_LAST, re.IGNORECASE)
# "j a n e @ firma . com": single letters before the sign, or blanks round it and round the dots.
SPACED = re.compile(rf"(?<![A-Za-z0-9._%+-])((?:[A-Za-z0-9] ){{2,63}}[A-Za-z0-9]|[A-Za-z0-9._%+-]+) ?@ ?{_LABEL}(?:(?: \. |\.){_LABEL})*(?: \. |\.){_LAST}")
# Spelled digits between digits of a number.
AMID = re.compile(rf"(?<=[0-9]){_GAP}{_WORD}(?:{_GAP}{_WORD}\b)*{_GAP}(?=[0-9])", re.IGNORECASE)

def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of every base match."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:  # the run of local characters before each @, then a domain: the leftmost match of the pattern
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if any(d in text for d in "0123456789"):
        if "." in text:
            for m in IP.finditer(text):
                parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
                if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                    out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 37 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


class Carried:
    """A rewritten text; first[i] and last[i] bound the source characters that output character i stands for."""

    def __init__(self, text: str):
        self.text, self.first, self.last = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Carried:
        """Replaces the spans of ``edits`` (sorted, apart); each new character stands for the whole span."""
        if not edits:
            return self
        text, first, last, at = [], [], [], 0
        for start, end, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:start] + new)
            first += self.first[at:start]
            last += self.last[at:start]
            if new:
                first += [self.first[start]] * len(new)
                last += [self.last[end - 1]] * len(new)
            at = end
        self.text, self.first, self.last = "".join(text), first, last
        return self


def look_alikes(x: Carried) -> Carried:
    return x.rewrite([(m.start(), m.end(), ALIKE[m[0]]) for m in STRANGE.finditer(x.text)])


def spelled_digits(x: Carried) -> Carried:
    edits = []
    for run in RUN.finditer(x.text):
        for m in RUN_PART.finditer(x.text, run.start(), run.end()):
            edits.append((m.start(), m.end(), "+" if m[1] else SPELLED[m[2].lower()] if m[2] else "." if m[3] else ""))
    x.rewrite(edits)
    edits = []
    for run in AMID.finditer(x.text):
        edits += [(m.start(), m.end(), SPELLED[m[2].lower()] if m[2] else "." if m[3] else "") for m in RUN_PART.finditer(x.text, run.start(), run.end())]
    return x.rewrite(edits)


def joined_address(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """The rewriting of a token like jane_at_firma_dot_com; none for other tokens."""
    at = JOINED_AT.search(text, start, end)
    dots = list(JOINED_DOT.finditer(text, at.end(), end)) if at else []
    tail = JOINED_LAST.match(text, dots[-1].end()) if dots else None
    if not tail or tail.end() != end:
        return []
    signs = [*JOINED_DOT.finditer(text, start, at.start()), *dots]
    return sorted([(at.start(), at.end(), "@"), *((d.start(), d.end(), ".") for d in signs)])


def spaced_addresses(x: Carried) -> Carried:
    edits = []
    for m in SPACED.finditer(x.text):
        edits += [(k, k + 1, "") for k in range(m.start(), m.end()) if x.text[k] == " "]
    return x.rewrite(edits)


def at_and_dot(x: Carried) -> Carried:
    x.rewrite([(m.start(), m.end(), ".") for m in NUMBER_DOT.finditer(x.text)])
    x.rewrite([(m.start(), m.end(), m[1]) for m in BRACKET_SIGN.finditer(x.text)])
    x.rewrite([(m.start(), m.end(), "@") for m in BRACKET_AT.finditer(x.text)])
    x.rewrite([(m.start(), m.end(), ".") for m in BRACKET_DOT.finditer(x.text)])
    edits = []
    for m in SPELLED_OUT.finditer(x.text):
        signs = list(SPELLED_SIGN.finditer(x.text, m.start(1), m.end()))
        edits += [(s.start(), s.end(), "@" if s[1] or s[2] else ".") for s in signs]
    x.rewrite(edits)
    x.rewrite([(m.start(1), m.end(1), "@") for m in PLAIN_DOT.finditer(x.text)])
    low, edits = x.text.lower(), []
    if any(f"{c}{w}{d}" in low for w in AT_WORDS for c in "_-" for d in "_-"):
        for m in TOKEN.finditer(x.text):
            edits += joined_address(x.text, m.start(), m.end())
    return x.rewrite(edits)


def many_spelled(low: str) -> bool:
    """Whether four digit words may stand in a row, dots between them aside, or one amid a number."""
    words = low.replace("-", " ").replace(",", " ").replace("_", " ").replace(".", " ").split()
    if SPELLED.keys().isdisjoint(words):
        return False
    run = 0
    for w in words:
        run = run + 1 if w in SPELLED else run if w in DOT_WORDS else 0
        if run == 4:
            return True
    return AMID.search(low) is not None


def strange_characters(text: str) -> bool:
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return STRANGE.search(text) is not None
    return any(c in text for c in LATIN_STRANGE)


def disguised(text: str) -> list[tuple[int, int, int]]:
    """Spans of the rewritten text, mapped back; none if nothing in the text asks for rewriting."""
    low = text.lower()
    signs = (any(w in low for w in DOT_WORDS) or any(c in low for c in "[({<") and BRACKETS.search(low) is not None
             or PLAIN_DOT.search(text) is not None)
    spaced = "@ " in low or " @" in low
    strange = strange_characters(text)
    spelled = many_spelled(low)
    if not (signs or strange or spelled or spaced):
        return []
    x = Carried(text)
    if strange:
        look_alikes(x)
    if spelled or strange:
        spelled_digits(x)
    if signs or strange:
        at_and_dot(x)
    if spaced or strange:
        spaced_addresses(x)
    if x.text == text:
        return []
    return [(x.first[s], k, x.last[e - 1]) for s, k, e in detect(x.text)]


def all_spans(text: str | None) -> list[tuple[int, int, int, bool]]:
    """(start, kind's place, end, base) of a text: base spans, and those of the rewriting that no base span covers."""
    if not text:
        return []
    base = detect(text)
    out = [(*s, True) for s in base]
    for s, k, e in set(disguised(text)):
        if not any(k == kind and start <= s and e <= end for start, kind, end in base):
            out.append((s, k, e, False))
    return sorted(out)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans: one row per document row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("spans", SPANS)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[(KINDS[k], s, e, b) for s, k, e, b in all_spans(t.as_py())] for t in batch.column(1)]
            found = [[{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, arrow)], names=["doc_id", "spans"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every span of ``text`` replaced by its kind in brackets, and ``n_chars`` counted anew."""

    @F.pandas_udf("string")
    def clean(texts):
        def one(text: str | None) -> str | None:
            out, at = [], 0
            for s, k, e, _ in all_spans(text):
                if s >= at:
                    out.append(f"{text[at:s]}[{KINDS[k].upper()}]")
                at = max(at, e)
            return f"{''.join(out)}{text[at:]}" if out else text
        return texts.map(one)

    small_batches(docs.sparkSession)
    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
