"""What generated texts claim, held against their sources: as column functions over rows of (text, source).

A row holds a text and the source it was made from (joined by id beforehand); claims are cut out, looked up in the
source's words and, where that fails, searched in the source itself, so a text is read once and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.segments import folded

# Words that may be capitalised without standing in a source.
GENERIC = """
the a an this that these it its in on of for and but or court supreme high appeal appeals appellant appellants respondent
respondents petition petitioner petitioners tribunal judgment order pakistan constitution article section act rules ordinance
civil criminal however whether while after since because although thus hence accordingly held holding having consequently
therefore further also where when which who whom
""".split()
CUT = "\x01"
#: Before a capitalised word stands no letter, digit or underscore.
NAME = r"(?:^|[^\p{L}\p{N}_])(\p{Lu}[\p{L}'’-]{2,})"
MARKED = r"[\p{L}\p{N}_][\p{L}\p{N}_./-]*"
DATE = r"^(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}|(?:19|20)[0-9]{2})$"


def flat(text: Column) -> Column:
    """White space as single blanks; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")


def sentences(text: Column) -> Column:
    """A text cut after a full stop, question or exclamation mark, blanks and before a capital A-Z."""
    marked = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"([.!?])\s+([A-Z])", f"$1{CUT}$2")
    return F.filter(F.split(marked, CUT), lambda s: s != "")


def names(sentence: Column) -> Column:
    """Capitalised words of three letters and more, without possessive endings and generic words."""
    found = F.transform(F.regexp_extract_all(sentence, F.lit(NAME), F.lit(1)), lambda w: F.regexp_replace(w, "(?:['’]s|['’-]+)$", ""))
    return F.filter(found, lambda w: ~F.lower(w).isin(*GENERIC))


def dates(sentence: Column) -> Column:
    """Dates of three numbers and years of 1900 to 2099."""
    words = F.transform(F.regexp_extract_all(sentence, F.lit(MARKED), F.lit(0)), lambda w: F.regexp_replace(w, "[./-]+$", ""))
    return F.filter(words, lambda w: w.rlike(DATE))


def unsupported(sentence: Column, low: Column, plain: Column) -> Column:
    """The sentence's names and dates that its source lacks; ``low``, ``plain``: the source by ``flat``, in lower case and as it is."""
    return F.concat(F.filter(names(sentence), lambda w: ~F.contains(low, F.lower(w))), F.filter(dates(sentence), lambda d: ~F.contains(plain, d)))


def grounded(rows: DataFrame, source: str, texts: list[str], lists: list[str] = ()) -> DataFrame:
    """The rows with the sentences of ``texts`` and the entries of ``lists`` kept that hold nothing the source lacks, and
    with ``checked`` (how many were looked at) and ``dropped``: array of (field, tokens, sentence)."""
    kind = "array<struct<field:string,tokens:array<string>,sentence:string>>"
    rows = rows.withColumn("plain_", flat(F.col(source))).withColumn("low_", F.lower("plain_"))
    fields = [*texts, *lists]

    def judged(c: str) -> Column:
        parts = sentences(F.col(c)) if c in texts else F.coalesce(F.col(c), F.array().cast("array<string>"))
        return F.transform(parts, lambda s: F.struct(F.lit(c).alias("field"), unsupported(F.coalesce(s, F.lit("")), F.col("low_"), F.col("plain_")).alias("tokens"), s.alias("sentence")))

    for c in fields:
        rows = rows.withColumn(f"{c}_judged_", judged(c))
    checked = sum((F.size(f"{c}_judged_") for c in fields), F.lit(0)).cast("long")
    dropped = F.concat(*[F.filter(f"{c}_judged_", lambda j: F.size(j["tokens"]) > 0) for c in fields]).cast(kind)
    out = rows.withColumn("checked", checked).withColumn("dropped", dropped)
    for c in fields:
        held = F.transform(F.filter(f"{c}_judged_", lambda j: F.size(j["tokens"]) == 0), lambda j: j["sentence"])
        out = out.withColumn(c, F.array_join(held, " ") if c in texts else held)
    return out.drop("plain_", "low_", *[f"{c}_judged_" for c in fields])


def as_list(raw: Column) -> Column:
    """A JSON value as a list of texts: a text alone, or the entries of an array, an object by its values; trimmed, blanks out."""
    listed = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    entry = lambda x: F.when(x.startswith("{"), F.array_join(F.transform(F.map_values(F.from_json(x, "map<string,string>")), lambda v: F.trim(v)), " ")).otherwise(x)
    texts = F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(entry(x), x, F.lit(""))))
    return F.filter(texts, lambda x: x != "")


def card_fields(answer: Column, subjects: list[str], other: str = "Other", keywords: int = 8) -> Column:
    """A card of the fields of a JSON answer: (subject, headnote, issues, holding, keywords). The subject is one of
    ``subjects`` in any case, else ``other``; the other fields are trimmed or made lists; at most so many keywords."""
    fields = F.from_json(answer, "map<string,string>")
    text = lambda name: F.trim(F.coalesce(fields[name], F.lit("")))
    known = F.create_map(*[F.lit(x) for s in subjects for x in (s.lower(), s)])
    subject = F.coalesce(known[F.lower(text("subject"))], F.lit(other))
    return F.struct(subject.alias("subject"), text("headnote").alias("headnote"), as_list(fields["issues"]).alias("issues"), text("holding").alias("holding"), F.slice(as_list(fields["keywords"]), 1, keywords).alias("keywords"))


# Spelled numbers.
NUMBER_WORDS = {w: n for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
NUMBER_WORDS |= {w: 10 * n for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety hundred".split(), 2)}


def numbers(text: Column) -> Column:
    """The numbers of a text as digits, distinct: runs of digits, and spelled ones, where a ten and a one that follow it are one."""
    spelled = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    words = F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0)), lambda w: spelled[w])
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    before = F.zip_with(words, F.concat(F.array(F.lit(None).cast("int")), words), lambda a, b: F.struct(a.alias("own"), b.alias("last")))
    joined = F.filter(pairs, lambda p: (p["a"] >= 20) & p["b"].between(1, 9))
    alone = F.filter(F.zip_with(before, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda p, n: F.struct(p["own"].alias("own"), p["last"].alias("last"), n.alias("next"))), lambda p: p["own"].isNotNull() & ~(F.coalesce(p["own"].between(1, 9) & (p["last"] >= 20), F.lit(False)) | F.coalesce((p["own"] >= 20) & p["next"].between(1, 9), F.lit(False))))
    digits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[0-9]+"), F.lit(0))
    return F.array_distinct(F.concat(digits, F.transform(joined, lambda p: (p["a"] + p["b"]).cast("string")), F.transform(alone, lambda p: p["own"].cast("string"))))


def added(text: Column, raw: Column, *entities) -> Column:
    """What a rewrite has that the raw query lacks: its numbers, and what each of ``entities`` (a function from a text to a
    list of texts, such as case keys or statutes) finds."""
    return F.concat(*[F.array_except(f(text), f(raw)) for f in (*entities, numbers)])


# Fixed values of the check of a summary: laws, and topics of a source that rule out words in its summary.
LAWS = ("land acquisition act", "arbitration act", "customs act", "family courts act", "illegal dispossession act", "code of civil procedure", "crpc", "penal code", "constitution", "shariat", "ordinance")
LAW_NUMBERS = ("act of [0-9]{4}", "section [0-9]+")
CONFLICTS = (
    (("land acquisition",), ("section 18",), ("arbitration", "section 32")),
    (("central excise", "customs"), (), ("arbitration", "family")),
    (("family courts act", "dowry", "dissolution of marriage"), (), ("arbitration", "customs")),
)
FORBIDDEN = (
    "the judgment addresses the core dispute", "this is a legal appeal concerning allegations", "the case concerned", "alleged offences", "the evidence on record",
    "reviewed the legal issues and interpreted the relevant statutory provisions",
)
OUTCOME_WORDS = ("allowed", "dismissed", "set aside", "upheld", "remanded", "partially allowed")
LEAST_WORDS = 15


def _has(text: Column, phrases) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def summary_issues(summary: Column, source: Column) -> Column:
    """Why a summary can't be trusted: empty (it or its source), law (one the source lacks), topic (words that the source's
    topic rules out), phrase (a forbidden one), short, outcome (no word of one). None: it may be shown."""
    own, other = folded(F.coalesce(summary, F.lit(""))), folded(F.coalesce(source, F.lit("")))
    laws = F.regexp_extract_all(own, F.lit("|".join((*LAWS, *LAW_NUMBERS))), F.lit(0))
    topic = F.lit(False)
    for any_of, all_of, ruled_out in CONFLICTS:
        here = _has(other, any_of)
        for phrase in all_of:
            here = here & F.contains(other, F.lit(phrase))
        topic = topic | (here & _has(own, ruled_out))
    checks = {
        "empty": (own == "") | (other == ""),
        "law": F.exists(laws, lambda w: ~F.contains(other, w)),
        "topic": topic,
        "phrase": _has(own, FORBIDDEN),
        "short": F.regexp_count(own, F.lit(r"\S+")) < LEAST_WORDS,
        "outcome": ~_has(own, OUTCOME_WORDS),
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()]))


# The headings of an answer, and what stands under one without content.
SUBSTANCE = ("[RELEVANT FACTS]", "[LEGAL ISSUE]", "[COURT REASONING]")
DECISION = "[FINAL DECISION]"
HEADINGS = (*SUBSTANCE, DECISION, "[KEY PRINCIPLE]", "[FIT WITH YOUR SITUATION]")
NOT_FOUND, NO_AUTHORITY = "not found in retrieved judgments", "[NO RELEVANT AUTHORITY]"


def answer_part(answer: Column, heading: str) -> Column:
    """What stands under a heading, up to the next one; empty where the heading is missing."""
    after = F.when(F.contains(answer, F.lit(heading)), F.substring(answer, F.instr(answer, F.lit(heading)) + len(heading), F.length(answer))).otherwise("")
    for other in HEADINGS:
        after = F.substring_index(after, other, 1)
    return F.regexp_replace(after, r"^\s+|\s+$", "")


def unsupported_answer(answer: Column) -> Column:
    """Whether an answer reports a decision though nothing was found under any heading of substance."""
    filled = lambda h: (answer_part(answer, h) != "") & ~F.contains(F.lower(answer_part(answer, h)), F.lit(NOT_FOUND))
    any_filled = F.lit(False)
    for h in SUBSTANCE:
        any_filled = any_filled | filled(h)
    return ~F.contains(answer, F.lit(NO_AUTHORITY)) & ~any_filled & filled(DECISION)


def ranked(ranking: Column, labels: Column, fallback: Column) -> Column:
    """A judge's ranking of labels as ids: ``labels`` is a map from a label to an id; unknown and repeated labels are dropped, and
    ids that the judge left out follow in the order of ``fallback``."""
    own = F.filter(F.transform(F.coalesce(ranking, F.array().cast("array<string>")), lambda x: labels[F.trim(x)]), lambda i: i.isNotNull())
    return F.array_distinct(F.concat(own, fallback))
