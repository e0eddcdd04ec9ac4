"""Personal data: detection in whole texts, also behind disguises, by offset-preserving rewriting.

Four detectors find emails, IP addresses, card and phone numbers. A chain of small transducers then
rewrites the text: look-alike characters to the plain ones, invisible ones to nothing, spelled digits
to digits, "at" and "dot" in their usual disguises to the signs. Every character of the result knows
the span of source characters that it stands for, so what the detectors find in the result is a span
of the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from copy import copy
from itertools import accumulate

from pyspark.sql import DataFrame

from tidings.llm.catalog import in_arrow, narrow, query, table, texts

KINDS = ("email", "ip", "card", "phone")

#: Letters of other scripts that look like the letter after them.
LOOKALIKES = (
    "аa еe оo рp сc уy хx іi јj ѕs һh ԁd ԛq ԝw АA ВB ЕE КK МM НH ОO РP СC ТT ХX ІI ЈJ ЅS"
    " αa οo νv ιi ρp υu ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ⅼl ıi ɡg ӏl"
)
#: Other signs for the dot and the hyphen.
DOTS, HYPHENS = "․。｡。", "‐‑‒–—−﹣"
INVISIBLE = "​‌‍⁠﻿­"
#: Last labels after which a mere "at" with plain dots is an address.
LAST_LABELS = frozenset(
    "com org net edu gov mil int info biz name pro mobi asia tel jobs travel museum coop aero cat"
    " app dev xyz online site shop store tech cloud blog email agency digital group world live news"
    " space club work company solutions services systems software network media studio design"
    " global center page link art wiki academy berlin london example test invalid localhost"
    " ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs"
    " bt bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee"
    " eg er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk"
    " hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la"
    " lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my"
    " mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro"
    " rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk"
    " tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw".split()
)
#: Words that follow "dot" in prose and are no top-level domain.
NO_LABELS = frozenset(
    "on the and of or an for from with was were are that this these those which who then than but"
    " if not into onto over under its his her their our they she he we when where will would could"
    " should has had have been being as-is".split()
)
DIGIT_WORDS = "zero one two three four five six seven eight nine".split()

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behind changes no match: where a run of digits fails, so does every end of it.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ in turn takes the run of local characters before it and the domain after it."""
    out, end, seen = [], 0, 0
    at = text.find("@")
    while at >= 0:
        left = text[max(end, seen) : at]
        start = at - (len(left) - len(left.rstrip(LOCAL)))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((start, end))
        seen = at + 1
        at = text.find("@", seen)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def is_card(text: str) -> bool:
    digits = digits_of(text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def is_ip(text: str) -> bool:
    # Leading zeros count for nothing; more than three other digits are beyond 255.
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in text.split("."))


def detect(text: str) -> list[Span]:
    """Spans of all kinds, by kind and start."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", s, e) for s, e in emails(text)]
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if is_ip(m[0])]
    out += [("card", *m.span()) for m in CARD.finditer(text) if m.end() - m.start() > 12 and is_card(m[0])]
    if "+" in text:
        out += [
            ("phone", *m.span())
            for m in PHONE.finditer(text)
            if 9 <= len(digits_of(m[0])) <= 15
        ]
    return out


def _plain_characters() -> dict[int, str]:
    """Every character that stands for one plain character, or for none."""
    table = {}
    for code in range(0x80, 0x20000):
        c = chr(code)
        plain = unicodedata.normalize("NFKC", c)
        digit = unicodedata.decimal(c, None)
        if digit is not None:
            table[code] = str(digit)
        elif len(plain) == 1 and " " <= plain <= "~":
            table[code] = plain
    table |= {ord(p[0]): p[1] for p in LOOKALIKES.split()}
    table |= {ord(c): "." for c in DOTS} | {ord(c): "-" for c in HYPHENS}
    return table | {ord(c): "" for c in INVISIBLE}


PLAIN = _plain_characters()
PLAIN_SET = frozenset(map(chr, PLAIN))

_WORDS = "|".join(DIGIT_WORDS)
_DOT = (
    r"(?: \. | _dot_ | \x20{1,3} dot \x20{1,3} | \x20{0,3} [\[({<] \x20{0,3} (?:dot|\.) \x20{0,3} [\])}>] \x20{0,3} )"
)
_AT = r"\x20{0,3} [\[({<] \x20{0,3} (?:at|@) \x20{0,3} [\])}>]"
#: Signs in their disguises. Numbers of spaces and labels looked ahead at are bounded, so every search
#: is linear. A bare "at" needs a label and a dot after it, which are not the local part of an address.
SIGNS = re.compile(
    rf"""(?ix)
    (?P<at> {_AT} \x20{{0,3}} | &(?:\#64|\#x40|commat);
        | _at_ (?= [a-z0-9-]{{1,63}} {_DOT} [a-z0-9] )
        | \x20{{1,3}} at \x20{{1,3}} (?= [a-z0-9-]{{1,63}} {_DOT} [a-z0-9] )
            (?! [a-z0-9_%+-]{{1,63}}+ (?: {_DOT} [a-z0-9_%+-]{{1,63}}+ ){{0,6}}
                (?: @ | {_AT} | \x20{{1,3}} at \x20{{1,3}} [a-z0-9-]{{1,63}}+ {_DOT} [a-z] ) ) )
    | (?P<dot> &(?:\#46|\#x2e|period); | _dot_ (?= [a-z0-9] ) | \x20{{0,3}} [\[({{<] \x20{{0,3}} (?:dot|\.) \x20{{0,3}} [\])}}>] \x20{{0,3}}
        | \x20{{1,3}} dot \x20{{1,3}} (?= [a-z0-9] ) )
    """
)
#: A run of spelled and other digits, "plus" and the signs.
_BETWEEN = r"[ ,.()\[\]{}<>-]{1,7}"
_TOKEN = rf"(?:{_WORDS}|oh|dot|point|[0-9]++)"
SPELLED = re.compile(rf"(?i)\b(?:plus[ ,.-]{{1,3}}|\+[ ]{{0,3}})?(?:{_TOKEN}(?:{_BETWEEN}|\b))++")
TOKEN = re.compile(rf"(?i)plus|\+|{_WORDS}|oh|[0-9]+|dot|point")
#: No detector takes fewer digits.
FEWEST_DIGITS = 4
WORD_HINT = re.compile(
    rf"(?i)\b(?:{_WORDS}){_BETWEEN}(?:{_WORDS}|oh|dot|point|[0-9])|(?:[0-9]|\b(?:oh|dot|point)){_BETWEEN}(?:{_WORDS})\b"
)
BARE_AT = re.compile(r" +at +")
#: Signs in brackets or as entities, as SIGNS takes them, in lower case.
BRACKET_HINT = re.compile(r"[\[({<] {0,3}(?:at|dot|@|\.) {0,3}[\])}>]")
ENTITY_HINT = re.compile(r"&(?:#64|#x40|commat|#46|#x2e|period);")
LABEL = re.compile(r"[^\W_](?:[^\W_]|-)*")
DISGUISED_DOT = re.compile(r"(?i) dot |[\[({<] *(?:dot|\.) *[\])}>]")
#: A bare "at" before a label and a plain dot, in lower case.
AT_HINT = re.compile(r" at {1,3}[a-z0-9-]{1,63}\.[a-z0-9]")


class Rewritten:
    """A text with, for each of its characters, the start and end of what it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.starts = range(len(text))
        self.ends = range(1, len(text) + 1)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Put strings in place of spans, in order; each stands for its whole span."""
        if not edits:
            return
        text, starts, ends, last = [], [], [], 0
        for s, e, new in edits:
            text += [self.text[last:s], new]
            starts += [*self.starts[last:s], *[self.starts[s]] * len(new)]
            ends += [*self.ends[last:s], *[self.ends[e - 1]] * len(new)]
            last = e
        self.text = "".join([*text, self.text[last:]])
        self.starts, self.ends = [*starts, *self.starts[last:]], [*ends, *self.ends[last:]]

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


def plain_edits(text: str) -> list[tuple[int, int, str]]:
    return [(i, i + 1, PLAIN[ord(c)]) for i, c in enumerate(text) if c in PLAIN_SET]


def sign_edits(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), "@" if m["at"] else ".") for m in SIGNS.finditer(text)]


def digit_edits(text: str, apart: bool = False) -> list[tuple[int, int, str]]:
    """Spelled digits, and what lies between the digits of a run; a dot there stays one.

    With ``apart``, what lies between two numbers that are not spelled stays as it is.
    """
    out = []
    for run in SPELLED.finditer(text):
        tokens = [(t.start() + run.start(), t.end() + run.start(), t[0].lower()) for t in TOKEN.finditer(run[0])]
        spelled = sum(word in DIGIT_WORDS for *_, word in tokens)
        digits = sum(len(w) if w.isdigit() else w in DIGIT_WORDS or w == "oh" for *_, w in tokens)
        if not spelled or digits < FEWEST_DIGITS:
            continue
        last, before = run.start(), ""
        for start, end, word in tokens:
            between = text[last:start]
            if between and not (apart and before.isdigit() and word.isdigit()):
                out.append((last, start, "." if "." in between else ""))
            if word in ("dot", "point"):
                out.append((start, end, "."))
            elif not word.isdigit():
                new = "+" if word in ("plus", "+") else "0" if word == "oh" else _digit(word)
                out.append((start, end, new))
            last, before = end, word
    return out


def _digit(word: str) -> str:
    return word if word.isdigit() else str(DIGIT_WORDS.index(word))


def disguised(text: str) -> bool:
    """Whether any rewriting could apply: most texts are spared it."""
    low = text.lower()
    return (
        ("dot" in low and " dot " in low)
        or BRACKET_HINT.search(low) is not None
        or "_at_" in low
        or "_dot_" in low
        or ("&" in low and ENTITY_HINT.search(low) is not None)
        or (("zero" in low or "five" in low or "one" in low or "two" in low or "nine" in low
             or "three" in low or "four" in low or "six" in low or "seven" in low or "eight" in low)
            and WORD_HINT.search(text) is not None)
        or (" at " in low and AT_HINT.search(low) is not None)
        or (not text.isascii() and not PLAIN_SET.isdisjoint(text))
    )


def hidden(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the rewritten text shows, none of which a span of ``base`` covers whole."""
    if not disguised(text):
        return []
    taken, out = sorted((s, e) for _, s, e in base), {}
    reach = list(accumulate((e for _, e in taken), max))
    for seen in rewritings(text):
        for kind, s, e in detect(seen.text):
            start, end = seen.source(s, e)
            # Spaces that a sign or digit took along at the edges are no part of the find.
            own = text[start:end]
            start, end = start + len(own) - len(own.lstrip(" ,.-")), end - (len(own) - len(own.rstrip(" ,.-")))
            if kind == "email":
                end = start + address_length(text[start:end])
            before = bisect_right(taken, (start, len(text)))
            if start < end and (not before or reach[before - 1] < end):
                out[kind, start, end] = None
    return list(out)


def rewritings(text: str) -> list[Rewritten]:
    """The rewritten text; a second one where numbers near spelled digits may also stand alone."""
    seen = Rewritten(text)
    seen.replace(plain_edits(text))
    ways = [digit_edits(seen.text)]
    if ways[0] and (other := digit_edits(seen.text, apart=True)) != ways[0]:
        ways.append(other)
    out = []
    for edits in ways:
        one = copy(seen)
        one.replace(edits)
        one.replace(sign_edits(one.text))
        out.append(one)
    return out


def address_length(own: str) -> int:
    """The length of a found address; after a bare "at" up to its last label that can be one, or 0."""
    parts = BARE_AT.split(own.lower(), maxsplit=1)
    if len(parts) == 1:
        return len(own)
    end = len(own)
    first = end - len(parts[1])
    cuts = [m.span() for m in LABEL.finditer(own, first)]
    while len(cuts) > 1:
        label = own[slice(*cuts[-1])].lower()
        if DISGUISED_DOT.search(own, first, cuts[-1][0]):
            fits = label not in NO_LABELS and (label.isalpha() and len(label) > 1 or label.startswith("xn--"))
        else:
            fits = label in LAST_LABELS
        if fits:
            return cuts[-1][1]
        cuts.pop()
        while cuts and own[slice(*cuts[-1])].lower() == "dot":
            cuts.pop()
    return 0


def listed(spans: list[Span]) -> str:
    """``kind:start:end``, by kind in the fixed order, then start, joined by commas."""
    ordered = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{s}:{e}" for k, s, e in ordered)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with a mark of its kind for each span; of overlapping spans the union goes."""
    out, last = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= last:
            out += [text[last:s], f"[{kind.upper()}]"]
        last = max(last, e)
    return "".join([*out, text[last:]])


FOUND = (
    "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint,"
    " base_sha256 string, spans string, n_hidden bigint"
)


def found(docs: DataFrame) -> DataFrame:
    """Counts of the base spans, their digest, and all spans, for every document.

    ``docs`` has doc_id and text; other columns are ignored. A null or empty text has no spans and
    the digest of the empty string; a null doc_id stays null; repeated rows give repeated rows; an
    empty table gives no rows. Offsets are code points, ends exclusive.
    """

    def work(batch):
        rows = []
        for text in texts(batch):
            base = detect(text)
            more = hidden(text, base)
            count = [sum(k == kind for k, *_ in base) for kind in KINDS]
            digest = hashlib.sha256(listed(base).encode()).hexdigest()
            rows.append((*count, digest, listed(base + more), len(more)))
        names = [f"n_{k}" for k in KINDS] + ["base_sha256", "spans", "n_hidden"]
        return {"doc_id": batch.column(0)} | dict(zip(names, map(list, zip(*rows))))

    return in_arrow(narrow(docs, "doc_id", "text"), work, FOUND)


def clean(text: str) -> str:
    base = detect(text)
    return redacted(text, base + hidden(text, base))


@query("op5_deobfuscated_pii")
def op5_deobfuscated_pii(spark, sf_dir):
    return found(table(spark, sf_dir, "documents"))
