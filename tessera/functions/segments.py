"""Paragraphs and sections of long texts, within a document's row: nothing is shuffled.

Paragraphs come from a line automaton: its lines are numbered, an orphaned number, a page mark, the start of a
quotation, blank, or running text, and a line begins a paragraph or continues one by its own kind and that of
the last line that wasn't blank. Every character of a text is in one paragraph; joined by line breaks they are the text.

Sections are spans of paragraphs in a fixed order. A section begins at its heading or first cue; the order at the last
disposal that isn't part of the signatures. Starts out of order are dropped and missing ones put in between by fixed
shares, so that any text has six ordered spans without gaps, some of which may be empty.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARAGRAPHS = "array<struct<kind:string,number:bigint,text:string>>"

_LINE = re.compile(r"[ \t]*(?:(?P<mark>\d+|-+ *page \d+(?: of \d+)? *-*|page \d+ of \d+)|(?P<orphan>\(?(?P<a>\d{1,4})[.)])|(?P<numbered>\(?(?P<b>\d{1,4})[.)])[ \t]+\S.*|(?P<quote>[\"“‘>]).*|(?P<text>\S.*))?[ \t\r\f]*", re.IGNORECASE | re.DOTALL)


def line_kind(line: str) -> tuple[str, int | None]:
    """(kind, number): blank, mark (a page's number), orphan (a paragraph's number alone), numbered, quote or text."""
    found = _LINE.fullmatch(line)
    kind = found.lastgroup if found else "text"
    kind = {"a": "orphan", "b": "numbered"}.get(kind, kind) or "blank"
    number = found and (found["a"] or found["b"])
    return kind, int(number) if number else None


def begins(kind: str, before: str | None, gap: bool) -> bool:
    """Whether a line that isn't blank begins a paragraph; ``before``: the kind of the last such line, ``gap``: blank lines between."""
    if before is None or "mark" in (kind, before) or kind in ("numbered", "orphan"):
        return True
    if before == "orphan":  # its paragraph, however many blank lines follow
        return False
    return gap or (kind == "quote" and before != "quote")


def split_paragraphs(text: str) -> list[tuple[str, int | None, str]]:
    """(kind, number, text) of every paragraph; blank lines belong to the paragraph before them, or to the first."""
    lines = text.split("\n")
    starts: list[tuple[int, str, int | None]] = []
    before, gap = None, False
    for k, line in enumerate(lines):
        kind, number = line_kind(line)
        if kind == "blank":
            gap = True
            continue
        if begins(kind, before, gap):
            starts.append((k, "numbered" if kind == "orphan" else kind, number))
        before, gap = kind, False
    if not starts:
        return [("blank", None, text)] if text else []
    bounds = [0, *(k for k, _, _ in starts[1:]), len(lines)]
    return [(kind, number, "\n".join(lines[a:b])) for (_, kind, number), a, b in zip(starts, bounds, bounds[1:])]


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text; null and empty texts have none."""

    @F.arrow_udf(PARAGRAPHS)
    def run(texts: pa.Array) -> pa.Array:
        rows = [[dict(zip(("kind", "number", "text"), p)) for p in split_paragraphs(t.as_py() or "")] for t in texts]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("number", pa.int64()), ("text", pa.string())])))

    return run(text.cast("string"))


SECTIONS = ("HEADER", "FACTS", "ARGUMENTS", "ISSUES", "ANALYSIS", "ORDER")
#: Shares of the paragraphs between two known starts that a section in between gets.
SHARES = (10, 15, 13, 10, 42, 10)
#: How a section's first paragraph is known: by phrases near its beginning.
CUES = {
    "FACTS": ("brief facts", "facts of the case", "facts leading to", "briefly stated", "background of"),
    "ARGUMENTS": ("learned counsel", "learned asc", "attorney general", "advocate general", "it was argued", "it was contended", "on behalf of the appellant", "on behalf of the petitioner", "on behalf of the respondent"),
    "ISSUES": ("leave was granted", "leave to appeal was granted", "question for determination", "questions for determination", "question involved", "questions involved", "points for determination", "the issue is", "the controversy is"),
    "ANALYSIS": ("we have heard", "we have considered", "we have examined", "having heard", "having considered", "after hearing", "in our view", "in our opinion", "we find that", "we hold that", "we are of the view"),
}
HEADINGS = {"FACTS": ("facts", "background"), "ARGUMENTS": ("arguments", "submissions"), "ISSUES": ("issues", "questions"), "ANALYSIS": ("analysis", "discussion", "reasons"), "ORDER": ("order", "conclusion", "decision")}
MATTERS = ("appeal", "appeals", "petition", "petitions", "application", "impugned judgment", "impugned order", "impugned decree")
OUTCOMES = ("allowed", "dismissed", "disposed of", "remanded", "accepted", "converted", "set aside", "upheld", "maintained", "modified", "quashed")
TRAILERS = ("chief justice", "justice", "judge", "approved for reporting", "not approved for reporting", "announced in", "announced on", "islamabad", "lahore", "karachi", "quetta", "peshawar", "bench", "certified to be true", "date of hearing", "date of decision")
HEAD, TRAILER_CHARS = 300, 400


def folded(text: Column) -> Column:
    """Lower case, white space as single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _any(text: Column, phrases) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def is_trailer(text: Column, trailers=TRAILERS) -> Column:
    """Short, and at least half of its lines begin like those of a signature block."""
    lines = F.filter(F.transform(F.split(text, "\n"), folded), lambda x: x != "")
    like = lambda x: F.exists(F.array(*[F.lit(t) for t in trailers]), lambda t: x.startswith(t))
    hits = F.size(F.filter(lines, like))
    return (F.length(F.trim(text)) <= TRAILER_CHARS) & (hits >= F.greatest(F.lit(1), F.floor(F.size(lines) / 2)))


def disposal_pattern(matters, outcomes) -> str:
    edge = r"(?:^|$|[^\p{L}\p{N}])"
    return rf"{edge}(?:{'|'.join(matters)}){edge}(?:[^.]*[^.\p{{L}}\p{{N}}])?(?:{'|'.join(outcomes)}){edge}"


def is_disposal(text: Column, matters=MATTERS, outcomes=OUTCOMES) -> Column:
    """Some sentence names a matter and after it what becomes of it."""
    return folded(text).rlike(disposal_pattern(matters, outcomes))


def _heading(text: Column, names) -> Column:
    return F.regexp_replace(text, r"^[0-9.)( ]+|[ .:]+$", "").isin(*names)


def starts_found(paras: Column, heads: Column, cues: dict | None = None, matters=MATTERS, outcomes=OUTCOMES) -> Column:
    """Where each section seems to start, as an array of lists of paragraph indexes by section; the header's is empty."""
    cues = CUES if cues is None else cues
    where = lambda test: F.filter(F.transform(heads, lambda h, k: F.when(test(h), k)), lambda k: k.isNotNull())
    found = [where(lambda h, s=s: _any(h, cues.get(s, ())) | _heading(h, HEADINGS[s])) for s in SECTIONS[1:-1]]
    last = F.filter(F.transform(paras, lambda p, k: F.when(is_disposal(p["text"], matters, outcomes) & ~is_trailer(p["text"]), k)), lambda k: k.isNotNull())
    return F.array(F.array().cast("array<int>"), *found, F.when(F.size(last) > 0, F.array(F.array_max(last))).otherwise(F.array().cast("array<int>")))


def _between(places: Column, above: Column, below: Column) -> Column:
    return F.filter(places, lambda x: (x > above) & F.coalesce(x < below, F.lit(True)))


def starts(total: Column, found: Column) -> Column:
    """The sections' starts and the end: ascending, from 0 to ``total``.

    The order's start is taken first; of the others each takes its first place after the section before and before the
    order. A missing start lies between its known neighbours by SHARES (rounded down).
    """
    order = F.get(F.filter(found[len(SECTIONS) - 1], lambda k: k > 0), F.lit(0))
    known: list[Column] = [F.lit(0)]
    reached: Column = F.lit(0)
    for k in range(1, len(SECTIONS) - 1):
        at = F.array_min(_between(found[k], reached, order))
        known.append(at)
        reached = F.coalesce(at, reached)
    known += [order, total]
    out = []
    for k, at in enumerate(known):
        before, after = range(k - 1, -1, -1), range(k + 1, len(known))
        share = lambda i, j: sum(SHARES[i:j])
        a, b = F.coalesce(*[known[i] for i in before] or [F.lit(0)]), F.coalesce(*[known[i] for i in after] or [total])
        of_a = F.coalesce(*[F.when(known[i].isNotNull(), share(i, k)) for i in before] or [F.lit(0)])
        of_b = F.coalesce(*[F.when(known[i].isNotNull(), share(k, i)) for i in after] or [F.lit(0)])
        out.append(F.coalesce(at, (a + F.floor((b - a) * of_a / (of_a + of_b))).cast("int")).cast("int"))
    return F.array(*out)


def spans(docs: DataFrame, id_column: str, text_column: str, cues: dict | None = None, matters=MATTERS, outcomes=OUTCOMES) -> DataFrame:
    """(id, paras, found, bounds): a document's paragraphs without page marks, what was found, and its sections' bounds."""
    rows = docs.select(F.col(id_column).alias("id"), paragraphs(F.col(text_column)).alias("all"))
    rows = rows.select("id", F.filter("all", lambda p: ~p["kind"].isin("mark", "blank")).alias("paras"))
    rows = rows.select("id", "paras", F.transform("paras", lambda p: folded(F.substring(p["text"], 1, HEAD))).alias("heads"))
    rows = rows.select("id", "paras", starts_found(F.col("paras"), F.col("heads"), cues, matters, outcomes).alias("found"))
    return rows.select("id", "paras", "found", starts(F.size("paras"), F.col("found")).alias("bounds"))


def _text(k: int) -> Column:
    first, stop = F.col("bounds")[k], F.col("bounds")[k + 1]
    return F.array_join(F.slice("paras.text", first + 1, stop - first), "\n")


def section_rows(spanned: DataFrame) -> DataFrame:
    """(id, section, first, stop, text): the six spans of every document, a span's text joined by line breaks."""
    rows = F.array(*[F.struct(F.lit(s).alias("section"), F.col("bounds")[k].alias("first"), F.col("bounds")[k + 1].alias("stop"), _text(k).alias("text")) for k, s in enumerate(SECTIONS)])
    return spanned.select("id", F.explode(rows).alias("s")).select("id", "s.*")


def labelled(spanned: DataFrame, cues: dict | None = None, matters=MATTERS, outcomes=OUTCOMES) -> DataFrame:
    """(id, idx, section, label): every paragraph with its span's section, and the label that its own words give: a
    trailer, a disposal in the last third, else the first section in the order ANALYSIS, ARGUMENTS, ISSUES, FACTS whose cue
    stands near its beginning, else its span's section."""
    cues = CUES if cues is None else cues
    own = lambda p, k: F.when(is_trailer(p["text"]), "TRAILER").when(is_disposal(p["text"], matters, outcomes) & (3 * k >= 2 * F.size("paras")), "ORDER")

    def label(p: Column, k: Column) -> Column:
        head, out = folded(F.substring(p["text"], 1, HEAD)), own(p, k)
        for s in ("ANALYSIS", "ARGUMENTS", "ISSUES", "FACTS"):
            out = out.when(_any(head, cues.get(s, ())), s)
        section = F.element_at(F.array(*[F.lit(s) for s in SECTIONS]), F.size(F.filter(F.slice("bounds", 1, len(SECTIONS)), lambda b: b <= k)))
        return F.struct(section.alias("section"), out.otherwise(section).alias("label"))

    return spanned.select("id", F.posexplode(F.transform("paras", label)).alias("idx", "x")).select("id", "idx", "x.*")


#: What a parse may lack, and what it costs.
PENALTIES = {"court": 0.1, "judge": 0.1, "case_number": 0.05, "facts_analysis": 0.1, "no_question": 0.1, "generic_issues": 0.15, "no_outcome": 0.1, "order_trailer": 0.15, "no_submission": 0.1, "facts_caption": 0.1}
START_SCORE, ISSUES_ALLOWED = 0.95, 2
GENERIC = "conforms to the established legal principles"


def section_texts(spanned: DataFrame) -> DataFrame:
    """(id, HEADER, FACTS, ...): a document's sections as columns."""
    return spanned.select("id", *[_text(k).alias(s) for k, s in enumerate(SECTIONS)])


def quality(wide: DataFrame) -> DataFrame:
    """(id, issues, score, passes): the ten checks of a parse (``section_texts``); each issue costs, two may pass."""
    header, facts, arguments, issues, order = (folded(F.col(s)) for s in ("HEADER", "FACTS", "ARGUMENTS", "ISSUES", "ORDER"))
    leaks = sum((F.contains(facts, F.lit(w)).cast("int") for w in ("versus", "date of hearing", "for the appellant", "for the respondent")), F.lit(0))
    checks = {
        "court": ~F.contains(header, F.lit("supreme court")),
        "judge": ~F.contains(header, F.lit("justice")),
        "case_number": ~header.rlike("(civil|criminal|constitution) (appeal|petition)"),
        "facts_analysis": _any(facts, ("we have", "we are", "we find", "we hold", "in our view")),
        "no_question": ~_any(issues, ("whether", "?")),
        "generic_issues": F.contains(issues, F.lit(GENERIC)),
        "no_outcome": ~_any(order, OUTCOMES),
        "order_trailer": (order == "") | is_trailer(F.col("ORDER")),
        "no_submission": (arguments != "") & ~_any(arguments, ("learned counsel", "learned asc", "argued that", "submitted that", "contended that", "urged that", "on behalf of")),
        "facts_caption": leaks >= 2,
    }
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()]))
    cost = sum((F.when(test, PENALTIES[name]).otherwise(0.0) for name, test in checks.items()), F.lit(0.0))
    scored = wide.select("id", found.alias("issues"), F.round(F.greatest(F.lit(0.0), START_SCORE - cost), 4).alias("score"))
    return scored.withColumn("passes", F.size("issues") <= ISSUES_ALLOWED)
