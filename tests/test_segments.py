"""Paragraphs and section spans: published cases, and properties over made-up texts."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import segments
from tessera.functions.segments import SECTIONS, SHARES, split_paragraphs

LINES = ["1. First point", "2.", "3)", "(4) in brackets", "", "", "  ", "running text", "more of it", "12", "--- PAGE 3 ---", "Page 2 of 9", '"quoted', "> cited", "“curled”", "appeal is dismissed.", "Judge", "we have heard both", "12.5 acres", "2017 was a year", " "]


def test_split_keeps_every_character():
    rng = random.Random(1)
    for _ in range(500):
        text = "\n".join(rng.choice(LINES) for _ in range(rng.randint(0, 25)))
        parts = split_paragraphs(text)
        assert "\n".join(p for _, _, p in parts) == text
        for kind, _, part in parts:
            assert kind == "blank" or part.strip() or chr(160) in part
            assert (kind == "mark") == (part.strip() in ("12", "--- PAGE 3 ---", "Page 2 of 9"))
    assert split_paragraphs("") == [] and split_paragraphs("\n \n") == [("blank", None, "\n \n")]


def test_split_rules():
    kinds = lambda text: [(k, n, p.strip()) for k, n, p in split_paragraphs(text)]
    assert kinds("Intro line\nwrapped\n\n2.\n\nThe second point\nwrapped\n3. Third") == [("text", None, "Intro line\nwrapped"), ("numbered", 2, "2.\n\nThe second point\nwrapped"), ("numbered", 3, "3. Third")]
    assert kinds("4)\n5. five") == [("numbered", 4, "4)"), ("numbered", 5, "5. five")]
    assert kinds('as held:\n"first\nwrapped\n"second" he said') == [("text", None, "as held:"), ("quote", None, '"first\nwrapped'), ("quote", None, '"second" he said')]
    assert kinds("one\n17\ntwo") == [("text", None, "one"), ("mark", None, "17"), ("text", None, "two")]
    assert kinds("7.")[0][:2] == ("numbered", 7)
    text = "line\n" * 200_000
    assert len(split_paragraphs(text)) == 1


def repaired(total, found):
    """The spans' bounds by plain loops."""
    order = found[-1][0] if found[-1] and found[-1][0] > 0 else None
    known, last = [0], 0
    for places in found[1:-1]:
        at = next((k for k in sorted(places) if k > last and (order is None or k < order)), None)
        known.append(at)
        last = last if at is None else at
    known += [order, total]
    out = []
    for k, at in enumerate(known):
        if at is None:
            a = max(i for i in range(k) if known[i] is not None)
            b = min(i for i in range(k, len(known)) if known[i] is not None)
            at = known[a] + (known[b] - known[a]) * sum(SHARES[a:k]) // sum(SHARES[a:b])
        out.append(at)
    return out


def test_bounds_against_loops(spark):
    rng = random.Random(2)
    cases = []
    for k in range(400):
        total = rng.choice([0, 1, 2, 3, 5, 8, 15, 40, 200])
        found = [[]] + [sorted(rng.sample(range(total), min(total, rng.choice([0, 0, 1, 3])))) for _ in range(4)]
        found.append([rng.randrange(total)] if total and rng.random() < 0.5 else [])
        cases.append((k, total, found))
    df = spark.createDataFrame(cases, "id long, total int, found array<array<int>>")
    got = {r.id: r.b for r in df.select("id", segments.starts(F.col("total"), F.col("found")).alias("b")).collect()}
    for k, total, found in cases:
        assert got[k] == repaired(total, found)
        assert got[k] == sorted(got[k]) and got[k][0] == 0 and got[k][-1] == total and len(got[k]) == 7


JUDGMENT = "\n\n".join(
    [
        "SUPREME COURT OF X\nMr. Justice A\nCIVIL APPEAL No. 5 of 2014",
        "Brief facts are that the suit was filed.",
        "Learned counsel for the appellant argued that the decree is bad.",
        "Leave was granted to consider whether the suit was in time?",
        "We have heard the parties. The issue is old.",
        "The petition was allowed below. That was long ago and the matter went on.",
        "In our view nothing is left.",
        "The appeal is dismissed with costs.\nThe parties may act on it.\nThe record goes back.\nThe file is closed.\nLet it be known.",
        "Judge\nJudge\nIslamabad, 2 May",
    ]
)


def test_sections_of_a_judgment(spark):
    rows = [(1, JUDGMENT), (2, None), (3, ""), (4, "one line"), (5, "\n\n".join(f"para {k}" for k in range(50))), (6, "Facts\n\nhe came\n\nORDER:\n\nthe appeal stands allowed")]
    spanned = segments.spans(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    got = {(r.id, r.section): (r["first"], r["stop"], r.text) for r in segments.section_rows(spanned).collect()}
    assert len(got) == 6 * len(SECTIONS)
    assert [got[1, s][:2] for s in SECTIONS] == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 7), (7, 9)]
    assert got[1, "ORDER"][2].startswith("The appeal is dismissed")
    assert all(got[i, s] == (0, 0, "") for i in (2, 3) for s in SECTIONS)
    assert [got[4, s][:2] for s in SECTIONS] == [(0, 0)] * 5 + [(0, 1)]
    assert [got[5, s][:2] for s in SECTIONS] == [(0, 5), (5, 12), (12, 19), (19, 24), (24, 45), (45, 50)]
    assert [got[6, s][:2] for s in SECTIONS][1] == (0, 0) or got[6, "ORDER"][0] == 3
    labels = {(r.id, r.idx): (r.section, r.label) for r in segments.labelled(spanned).collect()}
    assert labels[1, 8] == ("ORDER", "TRAILER") and labels[1, 7] == ("ORDER", "ORDER") and labels[1, 5] == ("ANALYSIS", "ANALYSIS") and labels[1, 6] == ("ANALYSIS", "ANALYSIS")
    quality = {r.id: r for r in segments.quality(segments.section_texts(spanned)).collect()}
    assert quality[1].issues == [] and quality[1].score == 0.95 and quality[1].passes
    assert set(quality[2].issues) == {"court", "judge", "case_number", "no_question", "no_outcome", "order_trailer"} and not quality[2].passes
    assert quality[2].score == pytest.approx(0.35)
