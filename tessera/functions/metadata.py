"""What a judgment says about itself, in one struct: each field is read in its own region of the text.

The caption is what stands before the heading; dates are read behind their labels, decided before announced before signed
before heard; case numbers before the parties and outside of the brackets that name the court below. Regions and dates are
column functions; the caption, a few thousand characters, is read in one Arrow batch function, and whole texts by the
parsers of ``parse``.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import cards, parse

# How far a caption reaches, at most and where no heading ends it, and the ends of a text that are searched.
CAPTION_MOST, CAPTION_DEFAULT = 8000, 2500
SIGNED_TAIL, OUTCOME_TAIL = 700, 1500
CITIES = {"karachi": "K", "lahore": "L", "peshawar": "P", "quetta": "Q", "islamabad": ""}
PAGE_MARK = r"(?i)-{2,}\s*page\s+[0-9]+\s*-{2,}"
HEADING = r"(?m)^(?:JUDGMENT|JUDGEMENT|ORDER|SHORT ORDER)[ \t]*$"


def cleaned(text: Column) -> Column:
    """Without page marks, marks of lost characters as blanks, every line trimmed."""
    one = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), PAGE_MARK, "\n"), "[�…“”‘’\r]", " ")
    return F.regexp_replace(one, r"(?m)^[ \t]+|[ \t]+$", "")


def caption_of(clean: Column) -> Column:
    """A cleaned text's caption: up to the heading that follows "PRESENT", or CAPTION_DEFAULT characters."""
    head = F.substring(clean, 1, CAPTION_MOST)
    start = F.coalesce(F.nullif(F.regexp_instr(head, F.lit(r"(?i)\bpresent\b")), F.lit(0)), F.lit(1))
    rest = F.substring(head, start, F.lit(CAPTION_MOST))
    heading = F.regexp_instr(rest, F.lit(HEADING))
    return F.when(heading > 0, F.substring(head, F.lit(1), start + heading - 2)).otherwise(F.substring(head, 1, CAPTION_DEFAULT))


def _after(region: Column, label: str, most: int) -> Column:
    """The first date within so many characters behind a label."""
    return parse.first_date_of(F.nullif(F.regexp_extract(region, rf"(?is)\b{label}(.{{0,{most}}})", 1), F.lit("")))


def decision_date(caption: Column, clean: Column) -> Column:
    """(date, source): a date of decision in the caption, else announced or signed in a city at the end, else the date of hearing."""
    tail = F.substring(clean, -SIGNED_TAIL, SIGNED_TAIL)
    dates = [
        ("caption_decision", _after(caption, r"date\s+of\s+(?:decision|judgment|announcement)\s*:?\s*", 40)),
        ("announced", _after(tail, r"announced\b", 80)),
        ("signature", _after(tail, rf"(?:{'|'.join(CITIES)})\b[\s,]*(?:the)?", 60)),
        ("hearing", _after(caption, r"date\s+of\s+hearing\s*:?\s*", 40)),
    ]
    found = F.coalesce(*[F.when(d.isNotNull(), F.struct(d.alias("date"), F.lit(source).alias("source"))) for source, d in dates])
    return F.coalesce(found, F.struct(F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("source")))


_COURT = re.compile(r"\b(?:court|tribunal|board|authority)\b", re.IGNORECASE)
_COURT_FROM = re.compile(r"\b(?:by|of|from)\s+(?:the\s+)?(?:learned\s+)?(?=[A-Z])")
_COURT_TO = re.compile(r"\s+(?:in|dated|passed|vide|whereby)\b|\(")
_DATED = re.compile(r"\bdated\s+(\d{1,2}\s*[./-]\s*\d{1,2}\s*[./-]\s*\d{2,4})", re.IGNORECASE)


def lower_court(caption: str) -> tuple[str | None, str | None]:
    """(court, date of its decision) of the first bracket that names what the case comes from."""
    for a, b in cards.lower_court_spans(caption):
        span = " ".join(caption[a:b].split()).strip("()[] ")
        dated = _DATED.search(span)
        court = None
        for start in _COURT_FROM.finditer(span):
            name = _COURT_TO.split(span[start.end() :])[0].strip(" ,.;")
            if _COURT.search(name):
                court = name
                break
        return court, re.sub(r"\s", "", dated[1]) if dated else None
    return None, None


_SIDES = re.compile(r"(?im)^.*?(?:\.{2,}|…)?\s*\(?(?:appellant|petitioner|applicant)s?\b.*$|^\s*(?:versus|v/s|vs?\.?)\s*$")


def before_parties(caption: str) -> str:
    """Where a caption names its own case: before the first party's role or "versus", without the brackets on the court below."""
    end = _SIDES.search(caption)
    region = caption[: end.start()] if end else caption
    for a, b in reversed(cards.lower_court_spans(region)):
        region = f"{region[:a]} {region[b:]}"
    return region


def caption_fields(caption: str | None) -> dict:
    text = caption or ""
    sides = cards.parties(text)
    court, dated = lower_court(text)
    refs = parse.case_refs(" ".join(before_parties(text).split()))
    return {"case_refs": refs, "bench": cards.bench(text), "appellant": sides[0] if sides else None, "respondent": sides[1] if sides else None, "lower_court": court, "impugned": dated, "counsel": cards.counsel(text)}


_REF = pa.struct([("key", pa.string()), ("type", pa.string()), ("number", pa.string()), ("registry", pa.string()), ("year", pa.int32()), ("display", pa.string())])
_CAPTION = pa.struct([("case_refs", pa.list_(_REF)), ("bench", pa.list_(pa.string())), ("appellant", pa.string()), ("respondent", pa.string()), ("lower_court", pa.string()), ("impugned", pa.string()), ("counsel", pa.list_(pa.string()))])
CAPTION = f"struct<case_refs:array<{parse.CASE_REF}>,bench:array<string>,appellant:string,respondent:string,lower_court:string,impugned:string,counsel:array<string>>"


def whole_names(statutes: Column) -> Column:
    """Without fragments cut within brackets ("Transfer) Rules 1974")."""
    return F.filter(statutes, lambda s: ~(F.contains(s, F.lit(")")) & ((F.instr(s, F.lit("(")) == 0) | (F.instr(s, F.lit(")")) < F.instr(s, F.lit("("))))))


def metadata(docs: DataFrame, id_column: str, text_column: str, order_column: str | None = None) -> DataFrame:
    """(id, case_refs, case_keys, case_display, bench, appellant, respondent, lower_court, impugned_date, decision_date,
    decision_date_source, counsel, statutes, citations, outcome, outcome_source) of every document. ``order_column``: its final
    order where one was cut out; the outcome is read there, else at the text's end."""

    @F.arrow_udf(CAPTION)
    def read(captions: pa.Array) -> pa.Array:
        return pa.array([caption_fields(c) for c in captions.to_pylist()], _CAPTION)

    order = F.lit("") if order_column is None else F.coalesce(F.col(f"`{order_column}`"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), order.alias("final"), cleaned(F.col(text_column)).alias("clean"))
    rows = rows.withColumn("caption", caption_of(F.col("clean")))
    rows = rows.select("id", "text", "final", "clean", "caption", read("caption").alias("c"), parse.statutes_of(F.col("text")).alias("statutes"))
    in_order, in_tail = parse.outcome_of(F.col("final")), parse.outcome_of(F.substring("clean", -OUTCOME_TAIL, OUTCOME_TAIL))
    date = decision_date(F.col("caption"), F.col("clean"))
    first = F.get("c.case_refs", F.lit(0)).getField("display")
    more = F.when(F.size("c.case_refs") > 1, F.concat(F.lit(" (+"), (F.size("c.case_refs") - 1).cast("string"), F.lit(" connected)"))).otherwise("")
    return rows.select(
        "id", "c.case_refs", F.transform("c.case_refs", lambda r: r["key"]).alias("case_keys"), F.concat(first, more).alias("case_display"), "c.bench", "c.appellant", "c.respondent", "c.lower_court",
        parse.first_date_of(F.col("c.impugned")).alias("impugned_date"), date["date"].alias("decision_date"), date["source"].alias("decision_date_source"), "c.counsel",
        whole_names(F.col("statutes")).alias("statutes"), parse.citations_of(F.col("text")).alias("citations"),
        F.when(in_order != "unknown", in_order).otherwise(in_tail).alias("outcome"), F.when(in_order != "unknown", "final_order").when(in_tail != "unknown", "raw_tail").alias("outcome_source"),
    )


# The courts that are the highest, other forums, and the words of outcomes, the more specific first.
SUPREME = ("supreme court", "apex court", "this court")
FORUMS = ("high court", "trial court", "appellate court", "session court", "sessions court", "district court", "family court", "civil court", "lower court", "courts below", "court below", "tribunal", "registrar", "department", "inspector", "commissioner", "board", "authority", "magistrate", "ombudsman", "inquiry", "ministry")
OUTCOMES = {
    "partly_allowed": ("partly allowed", "partially allowed", "partly accepted", "partially accepted", "partly granted", "partly set aside"),
    "remanded": ("remanded", "remands", "remand", "sent back", "sent it back", "sent the case back", "sent the matter back", "remitted"),
    "disposed": ("disposed of",),
    "dismissed": ("dismissed", "dismisses", "rejected", "rejects", "upheld", "upholds", "maintained", "refused", "declined", "affirmed", "confirmed"),
    "allowed": ("allowed", "allows", "accepted", "accepts", "set aside", "sets aside", "reversed", "reverses", "restored", "acquitted", "quashed", "struck down", "reinstated", "in his favour", "in her favour", "in their favour", "in our favour", "in my favour"),
}
MATTERS = ("appeal", "appeals", "petition", "petitions", "leave", "revision", "case", "matter")
LEAVE = ("leave granted", "leave was granted", "leave to appeal was granted", "granted leave")
DEPARTMENTAL = ("departmental appeal", "service appeal", "representation")


def _places(clause: str, phrases) -> list[int]:
    """Where phrases begin, between characters that are no letters; ``clause`` in lower case with single blanks."""
    out = []
    for p in phrases:
        at = clause.find(p)
        while at >= 0:
            if not (at and clause[at - 1].isalpha()) and not clause[at + len(p) : at + len(p) + 1].isalpha():
                out.append(at)
            at = clause.find(p, at + 1)
    return sorted(out)


def _outcome(clause: str) -> tuple[str, int] | None:
    """(label, place of the first outcome word) of a clause."""
    label = next((k for k, words in OUTCOMES.items() if _places(clause, words)), None)
    return label and (label, min(p for words in OUTCOMES.values() for p in _places(clause, words)))


def supreme_outcome(text: str | None) -> str | None:
    """The outcome that a description gives as the highest court's: of the last clause in which that court is the nearest forum
    named before the outcome, or the one by which it came; else of the last clause with an outcome, if it speaks of an appeal or
    petition after the court was named, and of no other forum."""
    own, last, seen = None, None, None
    for k, clause in enumerate(parse.clauses(text)):
        low = " ".join(clause.lower().split())
        found = _outcome(low)
        if _places(low, SUPREME):
            seen = k if seen is None else seen
            if found and not _places(low, LEAVE):
                label, at = found
                before = [(p, True) for p in _places(low[:at], SUPREME)] + [(p, False) for p in _places(low[:at], FORUMS)]
                if _places(low[at:], [f"by {the}{c}" for the in ("", "the ") for c in SUPREME]) or (before and max(before)[1]):
                    own = label
                    continue
        if found and (_places(low, MATTERS) or _places(low, FORUMS)):
            last = k, low, found[0]
    if own or last is None or seen is None:
        return own
    k, low, label = last
    alone = k > seen and _places(low, MATTERS[:4]) and not _places(low, FORUMS) and not _places(low, DEPARTMENTAL)
    return label if alone else None


def supreme_outcome_of(c: Column) -> Column:
    """``supreme_outcome`` as a column; only texts that name the court are read."""
    return parse.apply(supreme_outcome, "string", F.when(F.lower(c).rlike("|".join(SUPREME)), c))


def registry_of(refs: Column, text: Column) -> Column:
    """The registry letter of the first case that has one, else of the one city that a text names."""
    own = F.get(F.filter(F.transform(refs, lambda r: r["registry"]), lambda x: x.isNotNull()), F.lit(0))
    letters = F.create_map(*[F.lit(x) for pair in CITIES.items() for x in pair])
    named = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0)), lambda w: letters[w]), lambda x: x != ""))
    return F.coalesce(own, F.when(F.size(named) == 1, F.get(named, F.lit(0))))


def query_analysis(queries: DataFrame, id_column: str, text_column: str, first_year: int = 1947, last_year: int = 2026) -> DataFrame:
    """(id, case_refs, statutes, citations, parties, years, registry, outcome, narrative, type) of every query: the years without those
    of acts and without numbers of cases, the parties of "X v. Y", for descriptions the highest court's outcome."""
    c = F.col("text")
    rows = queries.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.select("id", "text", parse.case_refs_of(c).alias("case_refs"), parse.statutes_of(c).alias("statutes"), parse.without_case_numbers_of(c).alias("unnumbered"), supreme_outcome_of(c).alias("supreme"))
    versus = r"(?is)^\s*(.+?)\s+(?:v|vs|versus)\.?\s+(.+?)\s*$"
    parties = F.when(c.rlike(versus), F.transform(F.array(F.regexp_extract(c, versus, 1), F.regexp_extract(c, versus, 2)), lambda p: F.trim(p, F.lit(" .,")))).otherwise(F.array().cast("array<string>"))
    acts = F.flatten(F.transform("statutes", lambda s: F.regexp_extract_all(s, F.lit("(?:19|20)[0-9]{2}$"), F.lit(0))))
    years = F.array_distinct(F.filter(F.transform(F.array_except(F.regexp_extract_all("unnumbered", F.lit(r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?=$|[^0-9])"), F.lit(1)), acts), lambda y: y.cast("int")), lambda y: y.between(first_year, last_year)))
    narrative = F.regexp_count(c, F.lit(r"\S+")) >= parse.NARRATIVE_WORDS
    worded = parse.outcome_of(c)
    outcome = F.when(narrative, F.col("supreme")).otherwise(F.when(worded != "unknown", worded))
    return rows.select("id", "case_refs", "statutes", parse.citations_of(c).alias("citations"), F.filter(parties, lambda p: p != "").alias("parties"), years.alias("years"), registry_of(F.col("case_refs"), c).alias("registry"), outcome.alias("outcome"), narrative.alias("narrative"), cards.query_type_of(c).alias("type"))
