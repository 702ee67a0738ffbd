"""Case cards: headers, card texts, captions (bench, parties, counsel), query types.

Native columns where rules are per field; small row functions where a caption must be read in order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.parse import apply, case_numbers_of, citations_of, outcome_of, statutes_of

# The columns of a card and their weights in search.
CARD_COLUMNS = ("case_display", "case_keys", "appellant", "respondent", "bench", "statutes", "subject", "headnote", "issues", "holding", "keywords")
WEIGHTS = (3, 3, 4, 4, 1.5, 2, 1.5, 1, 1, 1, 2)


def _set(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def contextual_header(case: Column, subject: Column, section: Column) -> Column:
    """[case | subject | section], without blank parts and without a section "Other"; empty when nothing is left."""
    parts = F.concat_ws(" | ", _set(case), _set(subject), F.when(F.lower(section) != "other", _set(section)))
    return F.when(parts == "", "").otherwise(F.concat(F.lit("["), parts, F.lit("]")))


def card_row(values: Column) -> Column:
    """A list field as one text: its non-empty entries, joined by "; "."""
    return F.array_join(F.filter(values, lambda v: v.isNotNull() & (v != "")), "; ")


def card_text(fields: dict[str, Column]) -> Column:
    """A card as lines "Name: value"; fields that are missing have no line."""
    return F.concat_ws("\n", *[F.when(_set(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.trim(c))) for name, c in fields.items()])


def readable_status(flags: dict[str, Column], required: list[str]) -> Column:
    """complete when all stores have it, searchable when the required ones have, else null."""
    on = {k: F.coalesce(c, F.lit(False)) for k, c in flags.items()}
    every = lambda names: F.forall(F.array(*[on[n] for n in names]), lambda x: x)
    return F.when(every(list(flags)), "complete").when(every(required), "searchable")


def effective_plan(plan: Column, ends: Column, now: Column) -> Column:
    """The plan until it ends, then "free"; a plan without an end stays."""
    return F.when(F.coalesce(ends <= now, F.lit(False)), "free").otherwise(F.coalesce(plan, F.lit("free")))


def facet_relevance(scores: Column, best: int = 2) -> Column:
    """The mean of the best facet scores."""
    top = F.slice(F.sort_array(scores, asc=False), 1, best)
    return F.when(F.size(scores) > 0, F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / F.size(top))


def facet_query(c: Column, most: int = 60) -> Column:
    """The first words of a text, as many as a query may have."""
    return F.array_join(F.slice(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)), 1, most), " ")


def name_case(name: str) -> str:
    """Words with a capital first; initials stay capital."""
    return " ".join(w.upper() if re.fullmatch(r"(?:[a-z]\.)+", w.lower()) else w[:1].upper() + w[1:].lower() for w in name.split())


_JUSTICE = re.compile(r"(?im)^\s*(?:\d+[.)]\s*)?(?:(?:hon'?ble\s+)?(?:mr|mrs|ms|miss)\.?\s+)?justice\s+([A-Z][A-Za-z.'’ -]+?)(?:,?\s*(HCJ|CJ|C\.J\.?))?\s*$")


def bench(caption: str | None) -> list[str]:
    """The judges named in a caption, in order, once each; a chief justice is marked."""
    found = [name_case(m[1].strip(" ,-")) + (" (CJ)" if m[2] else "") for m in _JUSTICE.finditer(caption or "")]
    return list(dict.fromkeys(found))


_VERSUS = re.compile(r"(?im)^\s*(?:versus|v/s|vs?\.?)\s*$|\s+(?:versus|v/s|vs?\.)\s+")
_ROLE = re.compile(r"(?i)[\s.…]*\(?(?:appellants?|respondents?|petitioners?|plaintiffs?|defendants?)(?:\(s\))?(?:\s*\(in .*?\))?\)?\.?\s*$")
_OTHERS = re.compile(r"(?i)\s+(?:and|&)\s+(?:others?|another|\d+\s+others?)\b.*$")


def first_party(block: str) -> str:
    """The first name of a party's block, without numbers, roles, "and others" and what follows "through"."""
    for line in block.splitlines():
        name = re.sub(r"^\s*\(?\d+[.)]\s*", "", line)
        name = re.split(r"(?i)\bthrough\b", _OTHERS.sub("", _ROLE.sub("", name)))[0].strip(" .,;:…-")
        if len(name) > 2 and not re.match(r"(?i)(?:in the|present|civil|criminal|constitution|writ|c\.|appeal|petition|on appeal|against)", name):
            return name
    return ""


def parties(caption: str | None) -> list[str]:
    """[first side, second side] of a caption; empty where it has no "versus"."""
    t = caption or ""
    m = _VERSUS.search(t)
    if not m:
        return []
    before = "\n".join(reversed(t[: m.start()].splitlines()))
    return [first_party(before), first_party(t[m.end() :])]


def counsel(caption: str | None) -> list[str]:
    """"role: name" of the lawyers after "For the ..." lines; a line without a role keeps the last one."""
    role, out = "", []
    for line in (caption or "").splitlines():
        m = re.match(r"(?i)\s*for\s+the\s+([a-z() ]+?)\s*(?:[:\-–]\s*(.*))?$", line)
        text = line
        if m:
            role, text = m[1].strip().lower(), m[2] or ""
        for n in re.findall(r"((?:Mr|Mrs|Ms|Miss|Malik|Syed|Ch)\.?\s+[A-Z][\w.'’ -]+?)\s*,\s*(?:Sr\.\s*)?(?:ASC|AOR|AAG|DAG|Advocate)", text):
            if role:
                out.append(f"{role}: {n.strip()}")
    return list(dict.fromkeys(out))


def lower_court_spans(text: str | None, most: int = 600) -> list[tuple[int, int]]:
    """Bracketed "(On appeal from ... )" passages, nested brackets counted."""
    out, t = [], text or ""
    for m in re.finditer(r"(?i)\(\s*(?:on appeal|against the)", t):
        depth = 0
        for k in range(m.start(), min(len(t), m.start() + most)):
            depth += (t[k] == "(") - (t[k] == ")")
            if not depth:
                out.append((m.start(), k + 1))
                break
    return out


def key_from_filename(name: str | None) -> str | None:
    """The case key in a file's name like "c.p._12_2020.pdf"."""
    m = re.match(r"(?i)(c\.?p|c\.?a|crl\.?a|crl\.?p|w\.?p)\.?[\s_-]*(?:no\.?)?[\s_-]*(\d+)[\s_-]*(?:of)?[\s_-]*((?:19|20)\d{2})", (name or "").strip())
    return f"{m[1].replace('.', '').upper()}-{int(m[2])}-{m[3]}" if m else None


#: Number words (fixed values).
NUMBERS = {w: k for k, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split())}
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}


def numbers_in(text: str | None) -> list[str]:
    """Numbers of a text as digits, spelled ones too, sorted."""
    t = (text or "").lower()
    found = set(re.findall(r"\d+", t))
    words = re.findall(r"[a-z]+", t)
    for a, b in zip(words, [*words[1:], ""], strict=True):
        if a in TENS:
            found.add(str(TENS[a] + (NUMBERS[b] if NUMBERS.get(b, 99) < 10 else 0)))
        elif a in NUMBERS:
            found.add(str(NUMBERS[a]))
    return sorted(found)


def query_type_of(c: Column) -> Column:
    """What a query asks by: case number, citation, statute, outcome, entity, paraphrase, issue, or unknown."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    some = lambda a: F.size(a) > 0
    out = F.when(F.coalesce(F.size(words), F.lit(0)) == 0, "unknown").when(some(case_numbers_of(c)), "case").when(some(citations_of(c)), "citation").when(some(statutes_of(c)), "statute")
    out = out.when(c.rlike(r"\s(?:v|vs|versus)\.?\s"), "entity").when((outcome_of(c) != "unknown") & (F.size(words) <= 8), "disposition")
    return out.when((F.size(words) >= 2) & (capital >= 0.6 * F.size(words)), "entity").when(F.size(words) >= 12, "paraphrase").otherwise("issue")


#: Words that say nothing of a subject; for each category the words that name it in a query, and the phrases that show it
#: in a text (fixed values).
GENERIC = (
    "a", "an", "the", "of", "on", "in", "for", "with", "about", "regarding", "related", "to", "and", "or",
    "any", "all", "some", "show", "me", "find", "give", "list", "get", "search", "see", "want", "need", "legal",
    "law", "laws", "dispute", "disputes", "case", "cases", "matter", "matters", "issue", "issues", "judgment", "judgments", "judgement", "judgements",
    "decision", "decisions", "court", "courts", "appeal", "appeals", "petition", "petitions", "suit", "suits", "litigation", "proceedings", "supreme", "high",
    "pakistan", "type", "kind", "kinds", "sort", "example", "examples",
)
TRIGGERS = {
    "family": ("family", "families", "matrimonial", "marital", "domestic", "marriage"),
    "property": ("property", "properties", "land", "lands", "ownership", "title", "possession", "tenancy", "rent", "revenue"),
    "service": ("service", "employment", "employee", "employees", "servant", "servants", "civil", "job", "jobs"),
    "election": ("election", "elections", "electoral", "poll", "polls", "vote", "votes"),
    "criminal": ("criminal", "crime", "crimes", "murder", "offence", "offences"),
    "bail": ("bail",),
    "tax": ("tax", "taxes", "taxation", "customs", "duty"),
    "intellectual_property": ("trademark", "trademarks", "trade", "mark", "marks", "copyright", "patent", "patents", "brand", "brands", "intellectual"),
    "contract": ("contract", "contracts", "agreement", "agreements"),
    "constitutional": ("constitutional", "constitution", "fundamental", "rights", "writ"),
}
PHRASES = {
    "family": ("dower", "haq mehr", "nikah", "nikahnama", "nikah nama", "khula", "talaq", "divorce", "dissolution of marriage", "maintenance allowance", "custody of minor", "guardianship", "family court", "family settlement", "widow", "legal heirs", "inheritance", "husband", "wife"),
    "property": ("mutation", "khasra", "revenue record", "declaration of ownership", "recovery of possession", "possession of the land", "sale deed", "tenancy", "ejectment", "pre-emption", "evacuee", "proprietary rights"),
    "service": ("civil servant", "service tribunal", "promotion", "seniority", "dismissal from service", "removal from service", "reinstatement", "departmental inquiry", "regularisation", "regularization"),
    "election": ("election petition", "election tribunal", "returned candidate", "polling", "re-poll", "constituency", "representation of the people act"),
    "criminal": ("murder", "qatl", "conviction", "acquittal", "sentence", "f.i.r", "fir", "pakistan penal code", "ppc"),
    "bail": ("bail", "pre-arrest", "post-arrest"),
    "tax": ("income tax", "sales tax", "customs duty", "tax assessment", "federal board of revenue"),
    "intellectual_property": ("trade mark", "trademark", "copyright", "patent infringement", "patents ordinance", "passing off", "registrar of trade marks"),
    "contract": ("breach of contract", "specific performance", "agreement to sell"),
    "constitutional": ("article 199", "article 184", "article 185", "fundamental rights", "writ petition", "constitution petition"),
}
MOST_CATEGORY_WORDS = 5


def category_of(c: Column) -> Column:
    """The category of a query of at most MOST_CATEGORY_WORDS words whose telling words all belong to one; "too_broad"
    without a telling word; else "none"."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-z][a-z\-]*"), F.lit(0))
    telling = F.filter(words, lambda w: ~w.isin(*GENERIC))
    out = F.when((F.size(words) == 0) | (F.size(words) > MOST_CATEGORY_WORDS), "none").when(F.size(telling) == 0, "too_broad")
    for name, own in TRIGGERS.items():
        out = out.when(F.size(F.array_except(telling, F.array(*[F.lit(w) for w in own]))) == 0, name)
    return out.otherwise("none")


def category_phrases_of(c: Column, category: str) -> Column:
    """The category's phrases that a text holds between non-letters, sorted."""
    from tessera.functions.text import phrase_hits

    return phrase_hits(c, [p.replace(".", r"\.") for p in PHRASES[category]])


def category_text(category: str) -> str:
    """A category as a query: all its phrases."""
    return " ".join(PHRASES[category])


def ungrounded(sentence: str, source: str) -> list[str]:
    """Names and numbers of a sentence that its source doesn't hold."""
    low, flat = source.lower(), re.sub(r"[^a-z0-9]", "", source.lower())
    words = re.findall(r"(?<!^)\b[A-Z][A-Za-z]+\b|\b\d[\d.,/-]*\d\b|\b\d\b", sentence)
    return [w for w in words if w.lower() not in low and re.sub(r"[^a-z0-9]", "", w.lower()) not in flat]


def grounded_text(text: str | None, source: str | None) -> str:
    """The sentences of a text that hold nothing its source lacks."""
    return " ".join(s for s in re.split(r"(?<=[.!?])\s+", text or "") if s and not ungrounded(s, source or ""))


def json_in(text: str | None) -> str | None:
    """The outermost JSON object in a noisy answer, or null."""
    import json

    t = re.sub(r"^```(?:json)?|```$", "", (text or "").strip(), flags=re.M)
    a, b = t.find("{"), t.rfind("}")
    if a < 0 or b <= a:
        return None
    try:
        return json.dumps(json.loads(t[a : b + 1]), sort_keys=True)
    except ValueError:
        return None


def bench_of(c: Column) -> Column:
    return apply(bench, "array<string>", c)


def parties_of(c: Column) -> Column:
    return apply(parties, "array<string>", c)


def counsel_of(c: Column) -> Column:
    return apply(counsel, "array<string>", c)


def numbers_of(c: Column) -> Column:
    return apply(numbers_in, "array<string>", c)


def json_of(c: Column) -> Column:
    return apply(json_in, "string", c)
