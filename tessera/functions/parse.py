"""Parsers of running text: case numbers, statutes, citations, dates, outcomes, spelling, facets.

Columns of regular expressions where these suffice; ranges of case numbers and one-pass spelling are small functions
that run in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of case types, their abbreviations without dots and blanks, and their codes.
CASE_NAMES = {
    "civil petition for leave to appeal": "CP", "criminal petition for leave to appeal": "CRP", "civil review petition": "REVP", "criminal review petition": "CRREVP",
    "civil misc application": "CMA", "civil miscellaneous application": "CMA", "constitution petition": "CONSTP", "constitutional petition": "CONSTP",
    "human rights case": "HRC", "suo motu case": "SMC", "jail petition": "JP", "civil appeal": "CA", "civil petition": "CP", "criminal appeal": "CRA", "criminal petition": "CRP",
}
CASE_LETTERS = {"cpla": "CP", "crlpla": "CRP", "crpla": "CRP", "crp": "REVP", "cma": "CMA", "constp": "CONSTP", "smc": "SMC", "hrc": "HRC", "crla": "CRA", "cra": "CRA", "crlp": "CRP", "ca": "CA", "cp": "CP"}
CASE_TITLES = {
    "CA": "Civil Appeal", "CP": "Civil Petition", "CRA": "Criminal Appeal", "CRP": "Criminal Petition", "REVP": "Civil Review Petition", "CRREVP": "Criminal Review Petition",
    "CMA": "Civil Misc. Application", "CONSTP": "Constitution Petition", "HRC": "Human Rights Case", "SMC": "Suo Motu Case", "JP": "Jail Petition",
}
MOST_IN_RANGE = 50
CASE_REF = "struct<key:string,type:string,number:string,registry:string,year:int,display:string>"

_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\S")


class Scan:
    """A text's tokens (words, numbers, single signs) and a place among them."""

    def __init__(self, text: str):
        found = list(_TOKEN.finditer(text))
        self.tokens = [m.group() for m in found]
        self.low = [t.lower() for t in self.tokens]
        self.touch = [k > 0 and found[k - 1].end() == m.start() for k, m in enumerate(found)]
        self.spans = [m.span() for m in found]

    def at(self, k: int) -> str:
        return self.low[k] if k < len(self.low) else ""

    def skip(self, k: int, *words: str) -> int:
        return k + 1 if self.at(k) in words else k

    def phrase(self, k: int, words: list[str]) -> int | None:
        """The place after these words, which dots may follow; the last may be plural. None: they don't stand here."""
        for n, word in enumerate(words):
            if self.at(k) != word and not (n == len(words) - 1 and self.at(k) == word + "s"):
                return None
            k = self.skip(k + 1, ".")
        return k

    def letters(self, k: int, most: int = 4) -> list[tuple[str, int]]:
        """The abbreviations that begin here, without their dots, and the place after each: the longest first."""
        out, joined = [], ""
        for _ in range(most):
            if not self.at(k).isalpha() or not self.at(k).isascii():
                break
            joined += self.at(k)
            k = self.skip(k + 1, ".")
            out.append((joined, k))
        return out[::-1]


_NAMES = sorted(((n.split(), code) for n, code in CASE_NAMES.items()), key=lambda x: -len(x[0]))


def _case_type(s: Scan, k: int) -> tuple[str, int] | None:
    """(code, place after it) of the case type that is named or abbreviated at a place."""
    if k and s.touch[k] and s.tokens[k - 1].isalpha():
        return None
    for words, code in _NAMES:
        if words[0] == s.at(k) and (after := s.phrase(k, words)) is not None:
            return code, after
    return next(((CASE_LETTERS[a], after) for a, after in s.letters(k) if a in CASE_LETTERS), None)


def _year(s: Scan, k: int) -> int | None:
    """The year after "of", a slash or a hyphen."""
    t = s.at(k + 1)
    good = s.at(k) in ("of", "/", "-") and len(t) == 4 and t.isdigit() and t[:2] in ("19", "20")
    return int(t) if good and not (s.at(k + 2).isalpha() and s.touch[k + 2]) else None


def _numbers(s: Scan, k: int) -> tuple[list[tuple[bool, int, str]], int, int] | None:
    """(whether it closes a range, number, registry) of a list of case numbers, its year, and the place after that."""
    out, closes = [], False
    while s.at(k).isdigit() and len(s.at(k)) <= 9:
        number, k, registry = int(s.at(k)), k + 1, ""
        if s.at(k) == "-" and len(s.at(k + 1)) == 1 and s.at(k + 1).isalpha():
            registry, k = s.tokens[k + 1].upper(), k + 2
        out.append((closes, number, registry))
        if (year := _year(s, k)) is not None:
            return out, year, k + 2
        if s.at(k) not in (",", "&", "and", "to", "-"):
            break
        closes, k = s.at(k) == "to", k + 1
    return None


def _cases(s: Scan) -> Iterator[tuple[str, int, tuple[list[tuple[bool, int, str]], int, int]]]:
    """(code, place of the first number, what ``_numbers`` reads there) of every mention of cases."""
    k = 0
    while k < len(s.tokens):
        found = _case_type(s, k) if s.tokens[k].isalpha() else None
        if found is None:
            k += 1
            continue
        code, start = found
        start = s.skip(s.skip(start, "no", "nos", "number", "numbers"), ".")
        listed = _numbers(s, start)
        if listed is None:
            k += 1
            continue
        yield code, start, listed
        k = listed[2]


def case_refs(text: str | None) -> list[dict]:
    """The cases that a text names, in order, once each: TYPE-NUMBER[-REGISTRY]-YEAR keys with their parts. A number after
    "to" closes a range, which is filled where both ends have the same registry and at most MOST_IN_RANGE lie between."""
    out = {}
    for code, _, (numbers, year, _) in _cases(Scan(text or "")):
        last, before = None, ""
        for closes, n, registry in numbers:
            filled = closes and last is not None and registry == before and 0 < n - last <= MOST_IN_RANGE
            for m in range(last + 1, n + 1) if filled else (n,):
                number = f"{m}-{registry}" if registry else str(m)
                key = f"{code}-{number}-{year}"
                out.setdefault(key, {"key": key, "type": code, "number": str(m), "registry": registry or None, "year": year, "display": f"{CASE_TITLES[code]} No. {number} of {year}"})
            last, before = n, registry
    return list(out.values())


def without_case_numbers(text: str | None) -> str | None:
    """The text with blanks for the digits of the cases' numbers; their years stay."""
    if text is None:
        return None
    s, out = Scan(text), list(text)
    for _, start, (_, _, end) in _cases(s):
        for k in range(start, end - 1):
            if s.tokens[k].isdigit():
                i, j = s.spans[k]
                out[i:j] = " " * (j - i)
    return "".join(out)


def case_numbers(text: str | None) -> list[str]:
    """The keys alone."""
    return [r["key"] for r in case_refs(text)]


ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def roman(value: str) -> int | None:
    """The number of a roman numeral up to hundreds; None for anything else."""
    total, last = 0, 0
    for c in reversed(value.lower()):
        if c not in ROMAN:
            return None
        total += ROMAN[c] if ROMAN[c] >= last else -ROMAN[c]
        last = max(last, ROMAN[c])
    return total or None


def roman_of(n: int) -> str:
    """A number up to 399 as a roman numeral."""
    tens = lambda d, one, five, ten: ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)[d]
    return "C" * (n // 100) + tens(n // 10 % 10, "X", "L", "C") + tens(n % 10, "I", "V", "X")


# Codes by their names and by their abbreviations without dots, and what a named act ends with.
CODE_NAMES = {"pakistan penal code": "PPC", "code of criminal procedure": "CrPC", "code of civil procedure": "CPC", "qanun e shahadat order": "QSO", "qanun e shahadat": "QSO", "control of narcotic substances act": "CNSA"}
CODE_LETTERS = {"ppc": "PPC", "crpc": "CrPC", "cpc": "CPC", "qso": "QSO", "cnsa": "CNSA"}
ACTS = ("act", "ordinance", "order", "rules")
#: Small words within an act's name, and words before a name that aren't of it.
INSIDE = ("of", "the", "and", "for", "on", "in", "to")
NOT_IN_NAMES = ("the", "under", "of", "in", "and", "by", "per", "vide", "see", "within", "whether")
MOST_NAME_WORDS = 10
#: The year behind an act's name, in a text.
ACT_YEAR = r"(?:Act|Ordinance|Order|Rules)\s*,?\s*(?:18|19|20)[0-9][0-9]"


def _numbered(s: Scan, k: int, digits: int) -> tuple[str, int] | None:
    """A section's number with its letter and bracketed parts ("9(c)", "185 (3)"), and the place after it."""
    if not s.at(k).isdigit() or len(s.at(k)) > digits:
        return None
    out, k = s.tokens[k], k + 1
    if len(s.at(k)) == 1 and s.at(k).isalpha() and s.touch[k]:
        out, k = out + s.tokens[k], k + 1
    while s.at(k) == "(":
        j = k + 1
        while s.at(j).isalnum() and (j == k + 1 or s.touch[j]):
            j += 1
        part = "".join(s.tokens[k + 1 : j])
        if s.at(j) != ")" or not 0 < len(part) <= 4:
            break
        out, k = f"{out}({part})", j + 1
    return out, k


def _code(s: Scan, k: int) -> tuple[str, int] | None:
    """A code's name or abbreviation, after "of", "of the" or a comma."""
    k = s.skip(k, "of", ",")
    k = s.skip(k, "the")
    for name, code in CODE_NAMES.items():
        j = k
        for word in name.split():
            j = s.skip(j, "-") if word in ("e", "shahadat") else j
            if s.at(j) != word:
                break
            j += 1
        else:
            return code, j
    return next(((CODE_LETTERS[a], after) for a, after in s.letters(k) if a in CODE_LETTERS), None)


def _act(s: Scan, k: int) -> str | None:
    """The act whose last word stands at a place, with its year: the capitalised words before it, small words between."""
    j = s.skip(k + 1, ",")
    year = s.at(j)
    if not (s.tokens[k][0].isupper() and year.isdigit() and len(year) == 4 and year[:2] in ("18", "19", "20")):
        return None
    first = k
    while first and s.low[first - 1] not in CODE_LETTERS and k - first < MOST_NAME_WORDS and (s.tokens[first - 1][0].isupper() or s.low[first - 1] in INSIDE or (s.tokens[first - 1] in "()'-" and first > 1)):
        first -= 1
    while first < k and (s.low[first] in NOT_IN_NAMES or not s.tokens[first][0].isupper()):
        first += 1
    words = "".join(t if s.touch[i] and i > first else f" {t}" for i, t in enumerate(s.tokens[first : k + 1], first)).split()
    return f"{' '.join(words)} {year}" if len(words) > 1 else None


def statutes(text: str | None) -> list[str]:
    """Articles, sections with their code (without one they name nothing), orders with rules (of the CPC unless said), and
    named acts with their year: in this order, each in the order of the text, once."""
    s = Scan(text or "")
    articles, sections, orders, acts = [], [], [], []
    for k, word in enumerate(s.low):
        if k and s.touch[k] and s.tokens[k - 1].isalnum():
            continue
        after = s.skip(k + 1, ".")
        dotted = after > k + 1
        if word in ("article", "articles") or (word in ("art", "arts") and dotted):
            if found := _numbered(s, after if dotted else k + 1, 3):
                articles.append(f"Article {found[0]}")
        elif word in ("section", "sections") or (word in ("sec", "secs", "s", "ss") and dotted):
            found = _numbered(s, after, 4)
            if found and (code := _code(s, found[1])):
                sections.append(f"Section {found[0]} {code[0]}")
        elif word == "order" and (number := roman(s.at(k + 1)) or (int(s.at(k + 1)) if s.at(k + 1).isdigit() else None)):
            j = s.skip(k + 2, ",")
            found = _numbered(s, j + 1, 3) if s.at(j) in ("rule", "rules") else None
            if found:
                code = _code(s, found[1])
                orders.append(f"Order {number} Rule {found[0]} {code[0] if code else 'CPC'}")
        if word in ACTS and (name := _act(s, k)):
            acts.append(name)
    return list(dict.fromkeys([*articles, *sections, *orders, *acts]))


def _all(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(group))


def statutes_of(c: Column) -> Column:
    """``statutes`` as a column; only texts with a keyword are scanned."""
    return apply(statutes, "array<string>", F.when(c.rlike(r"(?i)\b(?:art|sec|ss?\.|order|act\b|ordinance|rules)"), c))


CITATION = r"\b(?:(?:19|20)\d\d\s+(?:SCMR|CLC|PCr\.?LJ|PTD|PLC|YLR|MLD)\s+\d+|(?:PLD|AIR)\s+(?:19|20)\d\d\s+(?:SC|Supreme Court|Lahore|Karachi|Peshawar)\s+\d+)"


def citations_of(c: Column) -> Column:
    """Law reports in order of place, once each: "2010 SCMR 123" and "PLD 2010 SC 123", journals without dots."""
    plain = lambda x: F.replace(F.replace(F.regexp_replace(x, r"\s+", " "), F.lit("PCr.LJ"), F.lit("PCrLJ")), F.lit("Supreme Court"), F.lit("SC"))
    return F.array_distinct(F.transform(_all(c, CITATION, 0), plain))


MONTHS = "january february march april may june july august september october november december".split()
DATE = r"(?i)\b(?:\d{1,2}[./-]\d{1,2}[./-](?:\d{4}|\d{2})\b|\d{1,2}(?:st|nd|rd|th)?\s+(?:" + "|".join(MONTHS) + r"),?\s+\d{4}\b)"


def first_date_of(c: Column, pivot: int = 50) -> Column:
    """The first valid date in a text as DD.MM.YYYY: d.m.yyyy, d.m.yy or "5th March, 2020"; two-digit years below the pivot
    are of this century."""
    months = F.array(*[F.lit(m) for m in MONTHS])

    def parsed(x: Column) -> Column:
        part = F.split(F.regexp_replace(F.lower(x), r"(?<=\d)(?:st|nd|rd|th)\b|,", ""), r"[./\s-]+")
        month = F.when(part[1].rlike("^[0-9]"), part[1].cast("int")).otherwise(F.array_position(months, part[1]).cast("int"))
        year = F.when(F.length(part[2]) == 2, F.when(part[2].cast("int") < pivot, F.lit("20")).otherwise("19")).otherwise("")
        return F.try_to_date(F.concat_ws("-", F.concat(year, part[2]), month.cast("string"), part[0]), "yyyy-M-d")

    return F.date_format(F.get(F.filter(F.transform(_all(c, DATE, 0), parsed), lambda d: d.isNotNull()), F.lit(0)), "dd.MM.yyyy")


#: How outcomes are worded, in order of priority.
OUTCOMES = {"partly allowed": r"partly\s+(?:allowed|accepted)", "remanded": r"remand(?:ed)?", "allowed": r"(?:allowed|accepted)", "dismissed": r"dismissed|dismiss", "disposed": r"disposed\s+of", "withdrawn": r"withdrawn"}


def outcome_of(c: Column) -> Column:
    """The outcome that a final order words; "unknown" for none, or when it is both allowed and dismissed."""
    has = {k: F.coalesce(c.rlike(rf"(?i)\b(?:{p})\b"), F.lit(False)) for k, p in OUTCOMES.items()}
    out = F.when(has["allowed"] & has["dismissed"] & ~has["partly allowed"], "unknown")
    for k, on in has.items():
        out = out.when(on, k)
    return out.otherwise("unknown")


# How transliterated terms are written, and the form they take. Doubled letters, blanks and hyphens don't count.
SPELLINGS = {
    "nikah nama": "nikahnama nikahnamah nekahnama nekahnamah",
    "nikah": "nikah nekah",
    "haq mehr dower": "haqmehr haqmehar haqmeher haqmahr haqmahar haqmaher haqemehr haqemehar haqemeher haqemahr haqemahar haqemaher",
    "khula": "khula khulah khola kholah",
    "talaq divorce": "talaq talak telaq telak",
    "iddat": "idat idah",
    "jahez dowry": "jahez jahes jahaz jahas jaheiz jaheis jahaiz jahais jahiz",
    "nafqa maintenance allowance": "nafqa nafqah nafaqa nafaqah",
    "hizanat custody of minor": "hizanat hizhanat hidanat hidhanat",
    "hiba gift": "hiba hibah heba hebah",
    "haq shufa pre-emption": "haqshufa haqshufah haqshofa haqshofah haqeshufa haqeshufah haqeshofa haqeshofah",
    "shufa pre-emption": "shufa shufah shofa shofah",
    "pre-emption": "preemption",
    "wirasat inheritance": "wirasat wiraset wirsat wirset virasat viraset virsat virset",
    "intiqal mutation": "intiqal inteqal",
    "patwari": "patwari patvari",
    "waqf": "wakf",
    "qisas": "qisas qises qasas qases qesas qeses",
    "diyat": "diyat",
    "jirga": "jirga jirgah jirqa jirqah",
}
_WORDS = re.compile(r"[A-Za-z]+")
_BETWEEN = re.compile(r"[\s-]*")
MOST_SPELLED_WORDS = 4


def single(word: str) -> str:
    """Lower case, doubled letters as one."""
    return re.sub(r"(.)\1+", r"\1", word.lower())


_FORMS = {single(v): form for form, variants in SPELLINGS.items() for v in variants.split()}


def spelling(text: str | None) -> str | None:
    """Variants replaced in one pass, the longest run of words first: what a replacement makes isn't read again."""
    if text is None:
        return None
    words = list(_WORDS.finditer(text))
    out, end, k = [], 0, 0
    while k < len(words):
        joined, best = "", None
        for n in range(k, min(k + MOST_SPELLED_WORDS, len(words))):
            if n > k and not _BETWEEN.fullmatch(text, words[n - 1].end(), words[n].start()):
                break
            joined += words[n].group()
            if (form := _FORMS.get(single(joined))) is not None:
                best = n, form
        if best is None:
            k += 1
            continue
        out += [text[end : words[k].start()], best[1]]
        end, k = words[best[0]].end(), best[0] + 1
    return "".join([*out, text[end:]])


NARRATIVE_WORDS = 25
FACETS = {"outcome": ("dismiss", "allow", "granted", "refused", "remand"), "procedure": ("appeal", "petition", "court", "filed", "trial"), "issue": ("whether", "question", "claim", "right")}


def clauses(text: str | None) -> list[str]:
    """A text cut at sentences' ends and before ", and", ", but", ", then"; a clause of fewer than four words stays with the
    one before."""
    out: list[str] = []
    for c in re.split(r"(?:[.;!?]|,\s+(?:and|but|then)\b)\s*", text or ""):
        c = c.strip()
        if out and 0 < len(c.split()) < 4:
            out[-1] += " " + c
        elif c:
            out.append(c)
    return out


def facets(text: str | None) -> dict[str, str]:
    """The clauses of a narrative by what they speak of: outcome, procedure, issue, or else facts."""
    out: dict[str, list[str]] = {}
    for c in clauses(text):
        kind = next((k for k, words in FACETS.items() if any(w in c.lower() for w in words)), "facts")
        out.setdefault(kind, []).append(c)
    return {k: ". ".join(v) for k, v in out.items()}


def apply(f: Callable, kind: str, c: Column) -> Column:
    """A parser as a column, in Arrow batches."""

    @F.pandas_udf(kind)
    def run(s):
        return s.map(f)

    return run(c)


def _with_case(c: Column) -> Column:
    """The texts that may name a case: an "of", a slash or a hyphen before a year."""
    return F.when(c.rlike(r"(?:(?i:of)|/|-)\s*(?:19|20)[0-9]{2}"), c)


def case_numbers_of(c: Column) -> Column:
    return apply(case_numbers, "array<string>", _with_case(c))


def without_case_numbers_of(c: Column) -> Column:
    """``without_case_numbers`` as a column; texts that can't name a case stay."""
    return F.coalesce(apply(without_case_numbers, "string", _with_case(c)), c)


def case_refs_of(c: Column) -> Column:
    """The cases that a text names, as structs; only texts with a number and a year are scanned."""

    @F.arrow_udf(f"array<{CASE_REF}>")
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.struct([("key", pa.string()), ("type", pa.string()), ("number", pa.string()), ("registry", pa.string()), ("year", pa.int32()), ("display", pa.string())])
        return pa.array([case_refs(t) for t in texts.to_pylist()], pa.list_(kind))

    return run(_with_case(c))


def spelling_of(c: Column) -> Column:
    return apply(spelling, "string", c)
