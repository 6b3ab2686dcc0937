"""Personal information inside free text, by anchor expansion.

Two Aho-Corasick passes over the lower-cased text find the anchors: words that
announce a number, a street or a name, street words and given names in the one;
at-signs and their spellings, schemes of addresses, and digits in the other.
From each anchor a small deterministic parser grows outward, validates what it
finds (grouping, announcing words before it, check digits) and fixes its
borders.  Nothing is searched for away from an anchor.  Overlapping finds are
settled in the order of KINDS; what is left is replaced by a typed placeholder.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("account", "email", "id_number", "phone", "address", "name")

# fixed values: cue words, by what they announce
AT_SIGNS = ("@", "(at)", "[at]", "{at}")
SCHEMES = ("://", "www.")
ID_CUES = ("ssn", "social security", "my social", "mrn", "patient number", "patient no", "patient id", "member id", "member no", "member number", "nhs no", "nhs number", "insurance no", "insurance number", "insurance id", "medical record", "record number", "national id", "passport", "policy number", "policy no", "tax id", "hospital number", "licence number", "license number")
ACCOUNT_CUES = ("iban", "account number", "account no", "acct", "acct no", "account", "sort code", "routing number", "card number", "card no", "credit card", "debit card")
PHONE_CUES = ("call", "phone", "tel", "telephone", "text me", "my number", "mobile", "cell", "fax", "whatsapp", "ring", "dial", "reach me at", "desk", "reception", "helpline", "hotline", "switchboard")
OTHER_CUES = ("pmid", "doi", "isbn", "issn", "trial", "lot", "batch", "bill", "ref", "code", "firmware", "version", "invoice", "order", "serial", "model", "nct", "build", "took")
STREETS = ("street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "drive", "dr", "close", "court", "ct", "boulevard", "blvd", "way", "terrace", "ter", "place", "pl", "square", "sq", "crescent", "cres", "grove", "gardens", "row", "hill", "parkway", "pkwy", "highway", "hwy", "hollow", "circle", "cir", "trail", "trl", "loop", "walk", "mews", "alley", "crossing", "ridge", "heights", "pike", "bend")
STREET_STARTS = ("rue", "avenue", "boulevard", "via", "calle", "plaza", "rua", "impasse", "chemin")
STREET_ENDS = ("straße", "strasse", "weg", "platz", "gasse", "allee", "straat", "laan", "str")
FLATS = ("flat", "apt", "apartment", "unit", "suite")
NAME_BEFORE = ("my name is", "name:", "ask for", "signed,", "signed", "dr", "dr.", "mr", "mr.", "mrs", "mrs.", "ms", "ms.", "prof", "prof.", "doctor", "professor", "nurse", "neighbour", "neighbor", "sincerely,", "regards,", "called me", "i am called", "down as", "listed as", "registered as")
NOT_NAMES = frozenset("the a an my your his her our their this that it i he she we they you and or but if so at in on for with to of as by from when while since until after before is are was were be been do does did has have had will would can could should may might must not no yes who what which where why how one two three four five six seven eight nine ten monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december today tomorrow gp clinic study trial form everyone someone anyone nobody both each some any all more less most least well still just only even then there here now again google internet".split())

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+'-")
_DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])")
_SPELT = re.compile(r"\s*[A-Za-z0-9-]+(?:\s*[(\[{]\s*dot\s*[)\]}]\s*[A-Za-z0-9-]+)+|\s*" + _DOMAIN.pattern)
_DIGITS = re.compile(r"(?<![\w.,/=&?-])(?:\+\s?)?\(?\d[\d\s().\-/]{3,}\d(?![\d=])")
#: What parts two numbers: line breaks, tabs, three blanks.
_WIDE_GAP = re.compile(r"\s*[^\S \xa0\u2000-\u200a\u202f\u205f\u3000\u1680]\s*|\s{3,}")
_LIST_MARK = re.compile(r"\d{1,3}[.)]\s+(?=[(\d])")
_GROUPED = re.compile(r"(?:1[-. ])?\(?\d{3}\)?[-. ]\d{3}[-.]\d{4}")
_SSN = re.compile(r"(?<!\d)\d{3}([- ])\d{2}\1\d{4}(?!\d)")
_CODED = re.compile(r"(?<!\w)(?:[A-Z]{2,3} ?\d{4} \d{4} \d{2}|[A-Z]{2,3} ?\d{4}[- ]?\d{4}|[A-Z]{2}\d{7})(?!\w)")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_CARD = re.compile(r"(?<![\w.-])[3-6]\d{3}(?:([ -]?)\d{4}(?:\1\d{4}){2}(?:\1?\d{1,3})?|([ -]?)\d{6}\2\d{4,5})(?![\w-])")
_ACCOUNT = re.compile(r"\W{0,3}(?:(?:is|was|no|number|nr|ending)\b\W{0,3}){0,2}(\d[\d -]{4,20}\d)(?![\w])", re.I)
_ID_TOKEN = re.compile(r"\W{0,3}(?:(?:is|was|no|number|nr|id)\b\W{0,3}){0,2}([A-Za-z]{0,3} ?\d[\dA-Za-z]*(?:[ /.-]\d+)*)", re.I)
#: What may stand between an announcing word and its number.
_TO_OTHER = re.compile(r"\W{0,3}(?:no\.?|number|is|#)?\W{0,3}")
_TO_ID = re.compile(r"\W*(?:is|no\.?|number)?\W*")
_SPACE = r"[^\S\n]+"
_HOUSE = r"(?<![\w.,/-])\d{1,5}[a-zA-Z]?"
_FLAT = rf"(?:(?i:flat|apt\.?|apartment|unit|suite){_SPACE}\d+[a-zA-Z]?,?\s+)?"
_PROPER = r"(?:[A-Z][\w'’.-]*|(?:[NSEW]|North|South|East|West)\.?)"
_UNIT = rf"(?:,?{_SPACE}(?i:apt\.?|apartment|unit|suite|flat|no\.?|#){_SPACE}?\d+[a-zA-Z]?)?"
_TOWN = rf"(?:,\s[A-Z][\w'’-]+(?:{_SPACE}[A-Z][\w'’-]+){{0,2}})?(?:,?{_SPACE}[A-Z]{{2}}{_SPACE}\d{{5}}(?:-\d{{4}})?)?"
_ANY_STREET = "|".join(STREETS)
_PROPER_STREET = re.compile(rf"{_FLAT}{_HOUSE}{_SPACE}(?:{_PROPER}{_SPACE}){{1,4}}(?i:{_ANY_STREET})\b\.?{_UNIT}{_TOWN}")
_LOWER_STREET = re.compile(rf"(?i:{_FLAT}){_HOUSE}{_SPACE}(?:[a-z][a-z'’-]+{_SPACE}){{1,3}}(?:{_ANY_STREET})\b")
_FOREIGN_STREET = re.compile(rf"{_HOUSE},?{_SPACE}(?:bis{_SPACE})?(?i:{'|'.join(STREET_STARTS)}){_SPACE}(?:(?:de|des|du|della|de la|del|la|le|l'|da|do){_SPACE})?{_PROPER}(?:{_SPACE}{_PROPER}){{0,3}}{_TOWN}")
_GERMAN_STREET = re.compile(rf"\b[A-ZÄÖÜ][\wäöüß-]*(?i:{'|'.join(STREET_ENDS)}\.?){_SPACE}\d{{1,4}}[a-z]?\b")
#: House number, postcode, town; the street's words stand before it.
_POSTED = re.compile(rf"\d{{1,4}}[a-zA-Z]?,?{_SPACE}(?:[A-Z]{{1,2}}-)?\d{{4,5}}{_SPACE}[^\W\d_a-z][^\W\d_A-Z]{{2,}}(?:[ -][^\W\d_a-z][^\W\d_A-Z]{{2,}})?")
_STREET_WORDS = re.compile(rf"(?:[^\W\d_a-z][\w'’.-]*{_SPACE}){{1,3}}$")
_SMALL = frozenset("of the a an to and or is are was were in on at for with without after before into mg mcg ml iu drops scoops capsules days weeks months hours years minutes mornings cycles flares sessions visits weekends steps times percent blocks miles km more less than that this my your down per".split())
_NUMBERED = re.compile(r"^(?:(?:flat|apt\.?|apartment|unit|suite)\s+\d+[a-z]?,?\s+)?\d+[a-z]?\b")
_APART = re.compile(r"[\W_]")
_INITIALS = re.compile(r"(?:[^\W\d_a-z]\.[^\S\n]?){1,3}(?=[^\W\d_])")
_NAME_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


class Anchors:
    """Places of the anchors of a text by kind, in order."""

    def __init__(self) -> None:
        self.at: dict[str, list[tuple[int, int, str]]] = {}

    def add(self, kind: str, s: int, e: int, cue: str) -> None:
        self.at.setdefault(kind, []).append((s, e, cue))

    def of(self, kind: str) -> list[tuple[int, int, str]]:
        return self.at.get(kind, [])


class Finder:
    """The automata and parsers; ``given`` are given names in lower case."""

    def __init__(self, given: frozenset[str], ordinary: frozenset[str]) -> None:
        self.given, self.ordinary = given, ordinary
        cues: dict[str, list[tuple[str, str]]] = {}
        listed = (("id", ID_CUES), ("account", ACCOUNT_CUES), ("phone", PHONE_CUES), ("other", OTHER_CUES), ("street", (*STREETS, *STREET_STARTS)), ("flat", FLATS), ("before", NAME_BEFORE), ("given", given))
        for kind, words in listed:
            for c in words:
                # words are met with a space on either side in the text whose other characters are spaces
                entry = cues.setdefault(f" {_APART.sub(' ', c).strip()} ", [])
                if (kind, c) not in entry:
                    entry.append((kind, c))
        for c in STREET_ENDS:
            cues.setdefault(f"{c} ", []).append(("ends", c))
        self.words = ahocorasick.Automaton()
        for c, entry in cues.items():
            self.words.add_word(c, (len(c.strip()), entry))
        self.words.make_automaton()
        self.signs = ahocorasick.Automaton()
        for kind, listed_ in (("at", AT_SIGNS), ("url", SCHEMES), ("digit", "0123456789")):
            for c in listed_:
                self.signs.add_word(c, (len(c), kind))
        self.signs.make_automaton()

    def anchors(self, low: str) -> Anchors:
        out = Anchors()
        for end, (size, entry) in self.words.iter(f" {_APART.sub(' ', low)} "):
            for kind, cue in entry:
                out.add(kind, end - 1 - size, end - 1, cue)
        last = -2
        for end, (size, kind) in self.signs.iter(low):
            if kind != "digit":
                out.add(kind, end - size + 1, end + 1, kind)
            else:
                if end != last + 1:  # the first of a run of digits
                    out.add("digit", end, end + 1, kind)
                last = end
        return out

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of what was found, in order, without overlaps."""
        low = text.lower()
        if len(low) != len(text):  # a few letters grow when lower-cased; offsets have to stay
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        at = self.anchors(low)
        hits: list[tuple[int, int, str]] = []
        for s, e, _ in at.of("at"):
            hits += self._email(text, s, e)
        links = [self._link(text, s) for s, _, _ in at.of("url")]
        for _, e, _ in at.of("id"):
            hits += self._announced(text, e)
        for _, e, _ in at.of("account"):
            m = _ACCOUNT.match(text, e)
            hits += [(m.start(1), m.end(1), "account")] if m else []
        figures = [d for d, _, _ in at.of("digit") if not any(a <= d < b for a, b in links)]
        if figures:
            hits += self._numbers(text, low, figures, at)
            if at.of("street"):
                hits += self._streets(text, low, figures, at)
            for d in figures:
                m = _POSTED.match(text, d)
                words = _STREET_WORDS.search(text, max(0, d - 80), d) if m else None
                if words and words.group().split()[-1].lower() not in NOT_NAMES:
                    hits.append((words.start(), m.end(), "address"))
            for s, _, _ in at.of("ends"):
                while s > 0 and (text[s - 1].isalnum() or text[s - 1] == "-"):
                    s -= 1
                m = _GERMAN_STREET.match(text, s)
                hits += [(m.start(), m.end(), "address")] if m else []
        names = [h for s, e, _ in at.of("given") for h in self._given(text, s, e)]
        for _, e, cue in at.of("before"):
            if cue[-1] not in ":," or text[e : e + 1] == cue[-1]:
                names += self._after_cue(text, cue, e)
        names = [h for h in names if not any(a < h[1] and h[0] < b for a, b in links)]
        hits += names + self._again(text, names)
        return settle(hits) if hits else hits

    # addresses of mail and pages ------------------------------------------
    def _email(self, text: str, s: int, e: int) -> list[tuple[int, int, str]]:
        k = s
        if text[s] == "@":
            right = _DOMAIN.match(text, e)
        else:
            right = _SPELT.match(text, e)
            while k > 0 and text[k - 1].isspace():
                k -= 1
        end = k
        while k > 0 and text[k - 1] in _LOCAL:
            k -= 1
        if not right or k == end or text[end - 1] in ".'":
            return []
        if text[k] == "'":
            k += 1
        return [(k, right.end(), "email")] if k < end else []

    def _link(self, text: str, s: int) -> tuple[int, int]:
        """The address around a scheme: to the next blank or bracket."""
        a, b = s, s
        while a > 0 and text[a - 1].isalpha():
            a -= 1
        while b < len(text) and not text[b].isspace() and text[b] not in "<>\"":
            b += 1
        return a, b

    # numbers ------------------------------------------------------------
    def _announced(self, text: str, e: int) -> list[tuple[int, int, str]]:
        """A number that follows a word announcing an identity number."""
        m = _ID_TOKEN.match(text, e)
        if not m or sum(c.isdigit() for c in m[1]) < 5:
            return []
        return [(m.start(1), m.end(1), "id_number")]

    def _numbers(self, text: str, low: str, figures: list[int], at: Anchors) -> list[tuple[int, int, str]]:
        out: list[tuple[int, int, str]] = []

        def told(s: int, kind: str, between: re.Pattern) -> bool:
            """Whether a cue of the kind stands before a place, with no more between them than the pattern allows."""
            return any(s - 40 <= e <= s and between.fullmatch(low, e, s) for _, e, _ in at.of(kind))

        def called(s: int) -> bool:
            return any(s - 22 <= a and e <= s for a, e, _ in at.of("phone"))

        upto = 0
        for d in figures:
            m = _SSN.match(text, d)
            if m:
                out.append((d, m.end(), "id_number"))
            k = d - (text[d - 1 : d] == " ")
            while k > 0 and d - k < 5 and "A" <= text[k - 1] <= "Z":
                k -= 1
            if k < d and text[k] != " ":
                m = _CODED.match(text, k)
                if m and m.end() > d and not told(k, "other", _TO_OTHER):
                    out.append((k, m.end(), "id_number"))
                m = _IBAN.match(text, k)
                if m and (iban_holds(m.group()) or told(k, "account", _TO_ID)):
                    out.append((k, m.end(), "account"))
            m = _CARD.match(text, d)
            if m and (luhn_holds(m.group()) or told(d, "account", _TO_ID)):
                out.append((d, m.end(), "account"))
            if d < upto:
                continue
            # the run of figures may begin with a bracket or a plus sign
            for s in range(max(0, d - 3), d + 1):
                m = _DIGITS.match(text, s) if text[s] in "+(" or s == d else None
                if m:
                    begin, upto = s, m.end()
                    for gap in [*_WIDE_GAP.finditer(text, s, upto), None]:
                        stop = gap.start() if gap else upto
                        out += [(a, b, "phone") for a, b in phones(text, begin, stop, called, lambda p: told(p, "other", _TO_OTHER) or told(p, "id", _TO_ID))]
                        begin = gap.end() if gap else begin
                    break
        return out

    # addresses ----------------------------------------------------------
    def _streets(self, text: str, low: str, figures: list[int], at: Anchors) -> list[tuple[int, int, str]]:
        """House numbers (or flats) with a street word ahead of them."""
        out = []
        ways = [s for s, _, _ in at.of("street")]
        for d in [*figures, *(s for s, _, _ in at.of("flat"))]:
            if not any(d < w <= d + 140 for w in ways):
                continue
            for p in (_PROPER_STREET, _FOREIGN_STREET):
                m = p.match(text, d)
                out += [(d, m.end(), "address")] if m else []
            m = _LOWER_STREET.match(low, d)
            if m:
                inner = re.findall(r"[a-z'’-]+", _NUMBERED.sub("", m.group()))
                if inner and not any(w in _SMALL for w in inner):
                    out.append((d, m.end(), "address"))
        return out

    # names --------------------------------------------------------------
    def _namelike(self, w: str) -> bool:
        return len(w) > 1 and w.lower() not in NOT_NAMES and w.lower() not in self.ordinary

    def _sure(self, w: str) -> bool:
        return w.lower() in self.given and w.lower() not in self.ordinary

    def _grow(self, text: str, at: int, lower_too: bool) -> tuple[int, int] | None:
        """One to three name words from ``at`` on; in lower case only where the cue allows it."""
        first = _INITIALS.match(text, at)
        end, n = first.end() if first else at, 0
        start = None
        while n < 3:
            m = _NAME_TOKEN.match(text, end + (0 if n == 0 else 1)) if n == 0 or (end < len(text) and text[end] in "  ") else None
            if not m:
                break
            w = m.group()
            known = w.lower() in self.given
            if not (known or self._namelike(w)) or not (w[0].isupper() or lower_too):
                break
            if len(w) == 1:
                break
            start = m.start() if start is None else start
            end, n = m.end(), n + 1
        return (first.start() if first else start, end) if start is not None else None

    def _after_cue(self, text: str, cue: str, e: int) -> list[tuple[int, int, str]]:
        m = re.compile(r"[^\S\n]*[:,]?[^\S\n]*").match(text, e)
        at = m.end()
        free = cue in ("my name is", "name:", "i am called")
        if cue in ("dr", "mr", "ms", "mrs", "prof") and at < len(text) and text[at] == ".":
            at = re.compile(r"\.?[^\S\n]*").match(text, at).end()
        if shouting(text, at) and _NAME_TOKEN.match(text, at) and not self._sure(_NAME_TOKEN.match(text, at).group()):
            return []
        if cue == "nurse" and not re.match(r"[A-Z][a-z]", text[at : at + 2]):
            return []
        got = self._grow(text, at, free)
        if not got:
            return []
        s, t = got
        if free:  # the name ends before a verb or conjunction; two words at most
            words = [x.end() for x in _NAME_TOKEN.finditer(text, s, t)]
            t = words[min(1, len(words) - 1)]
        first = _NAME_TOKEN.match(text, _NAME_TOKEN.search(text, s).start()).group()
        given = _NAME_TOKEN.match(text, t + 2) if first.isupper() and text[t : t + 2] == ", " else None
        if given and given.group().isupper() and self._namelike(given.group()):  # surname first
            t = given.end()
        if cue in ("ask for", "down as", "listed as", "registered as", "signed", "nurse", "neighbour", "neighbor", "called me", "doctor", "professor") and first.lower() not in self.given and not first[0].isupper():
            return []
        return [(s, t, "name")]

    def _again(self, text: str, names: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Other places of the surnames of a text's names."""
        known = {m.group() for s, e, _ in names for m in _NAME_TOKEN.finditer(text, s, e)}
        sure = {w for w in known if len(w) > 3 and w[0].isupper() and not w.isupper() and w.lower() not in self.given and self._namelike(w)}
        return [(m.start(), m.end(), "name") for w in sure for m in re.finditer(rf"(?<![\w@.-]){re.escape(w)}(?![\w@-])", text)]

    def _given(self, text: str, s: int, e: int) -> list[tuple[int, int, str]]:
        """A listed given name; one that is also a word needs a surname beside it."""
        w = text[s:e]
        if text[s - 1 : s] in ("@", "/", ".", "-", "_") or text[e : e + 1] in ("@", "_", "/") or re.match(r"[.-][\w]", text[e : e + 2]) or re.match(r"\d", text[e : e + 1]):
            return []
        after = re.compile(r"[^\S\n]([^\W\d_][\w'’-]+|[^\W\d_]\.)").match(text, e)
        before = re.search(r"([^\W\d_]+),?[^\S\n]$", text[max(0, s - 32) : s])
        nxt = after[1] if after else ""
        ordinary = w.lower() in self.ordinary
        if ordinary and w.isupper() and (shouting(text, s) or nxt.isupper() and not self._namelike(nxt)):
            return []
        if w[0].isupper():
            if nxt and nxt[0].isupper() and self._namelike(nxt.rstrip(".")) or (nxt and len(nxt) == 2 and nxt[1] == "." and nxt[0].isupper()):
                return [(s, after.end(), "name")]
            if w.isupper() and before and before[1].isupper() and text[s - 2 : s] == ", " and self._namelike(before[1]) and len(before[1]) > 2:
                return [(max(0, s - 32) + before.start(1), e, "name")]
            if not ordinary and not w.isupper():
                return [(s, e, "name")]
        elif not ordinary and surname_like(nxt):
            return [(s, after.end(), "name")]
        return []


def shouting(text: str, at: int) -> bool:
    """Whether the text before a place is in capitals throughout."""
    near = [c for c in text[max(0, at - 24) : at] if c.isalpha()]
    return len(near) >= 4 and all(c.isupper() for c in near)


def surname_like(w: str) -> bool:
    return len(w) > 4 and w.isalpha()


def iban_holds(raw: str) -> bool:
    """Whether the check digits of an international account number are right."""
    c = raw.replace(" ", "")
    return 15 <= len(c) <= 34 and int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1


def luhn_holds(raw: str) -> bool:
    """Whether the check digit of a card number is right."""
    d = [int(c) for c in raw if c.isdigit()]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0


def phone_like(raw: str, digits: str, called: bool) -> bool:
    """Whether a run of digits is grouped, or announced, as a telephone number.

    An international number starts with + and has 9 to 15 digits.  Others have
    10 or 11: three-three-four with a trunk 1 or without, or a leading 0 and
    two to four groups.  Without groups a telephone word has to stand before it.
    """
    if not 9 <= len(digits) <= 15 or re.search(r"\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}|/", raw):
        return False
    groups = re.findall(r"\d+", raw)
    if raw.startswith("+"):
        return len(groups) >= 2 or len(digits) >= 10
    if re.fullmatch(r"(?:1[-. ])?\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}", raw):
        return True
    if digits[0] == "0" and len(digits) in (10, 11) and 2 <= len(groups) <= 5 and "." not in raw:
        return True
    return called and len(digits) in (10, 11) and len(groups) <= 5


def phones(text: str, s: int, e: int, called: Callable[[int], bool], other: Callable[[int], bool]) -> list[tuple[int, int]]:
    """Telephone numbers in a run of digits without wide gaps.

    If the whole run is none, the longest leading groups that are one count; as
    blanks may part figures of any kind, they have to be grouped by more than
    blanks or be announced.  A number that another word announces is none.  What
    follows a number is looked at again.
    """
    out = []
    while s < e:
        while s < e and text[s] in " .-/)":
            s += 1
        mark = _LIST_MARK.match(text, s, e)
        s = mark.end() if mark else s
        if other(s):
            break
        ends = [e, *(x.start() for x in reversed(list(re.compile(r"\s+").finditer(text, s, e))))]
        for k in ends:
            raw = text[s:k].rstrip(" .-/(")
            if not phone_like(raw, "".join(c for c in raw if c.isdigit()), called(s)):
                continue
            if k == e or _GROUPED.fullmatch(raw) or called(s):
                out.append((s, s + len(raw)))
                s += len(raw)
                break
        else:
            break
    return out


def settle(hits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Non-overlapping finds: earlier kinds of KINDS win, then longer ones."""
    out: list[tuple[int, int, str]] = []
    for s, e, k in sorted(set(hits), key=lambda h: (KINDS.index(h[2]), h[0] - h[1], h[0])):
        if all(e <= a or s >= b for a, b, _ in out):
            out.append((s, e, k))
    return sorted(out)


def redact(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    """The text with [EMAIL], [PHONE] ... in place of the finds; all else stays."""
    if not text or not found:
        return text
    parts, at = [], 0
    for s, e, k in found:
        parts += [text[at:s], f"[{k.upper()}]"]
        at = e
    return "".join([*parts, text[at:]])


_FIELDS = [("table_name", pa.string()), ("row_key", pa.string()), ("redacted", pa.string()), ("found", pa.list_(pa.struct([("start_char", pa.int64()), ("end_char", pa.int64()), ("pii_kind", pa.string())])))]


def find_personal_data(df: DataFrame, given_names: DataFrame, common_words: DataFrame, *, most_names: int = 1_000_000) -> DataFrame:
    """(table_name, row_key, redacted, found) of every row of (table_name, row_key, text).

    ``given_names``: (given_name), ``common_words``: (word); both are lists of
    bounded size (more than ``most_names`` raises).  ``found`` holds start, end
    (code points) and kind; offsets are those of the original text.  Null texts
    stay null and hold nothing; a placeholder already in the text is not found
    again.  No shuffle.
    """
    lists = []
    for frame, c in ((given_names, "given_name"), (common_words, "word")):
        got = [r[0] for r in frame.where(f"{c} is not null").select(F.lower(c)).distinct().limit(most_names + 1).collect()]
        if len(got) > most_names:
            raise ValueError(f"too many rows of {c}")
        lists.append(frozenset(got))
    given, common = lists

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(frozenset(x for x in given if x.strip()), common | AMBIGUOUS)
        for b in batches:
            texts = b.column(2).to_pylist()
            found = [finder.find(t) if t else [] for t in texts]
            clean = [redact(t, f) for t, f in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(clean, pa.string()), pa.array([[{"start_char": s, "end_char": e, "pii_kind": k} for s, e, k in f] for f in found], _FIELDS[3][1])], names=[n for n, _ in _FIELDS])

    return df.select("table_name", "row_key", "text").mapInArrow(run, "table_name string, row_key string, redacted string, found array<struct<start_char: long, end_char: long, pii_kind: string>>")


# fixed values: given names that are also ordinary words, and so need a surname beside them
AMBIGUOUS = frozenset("art bill dawn drew eve faith gene ginger grace hope jack jasmine mark may pearl rose ruby sage summer will iris ivy joy june lily olive robin sky violet amber april august autumn daisy heather holly penny poppy pat rob sue chase grant miles frank dean".split())
