"""The parsers on pairs of a text and what stands in it."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import cards, parse

CASES = {
    "CIVIL APPEAL NO. 5-Q OF 2014": "CA-5-Q-2014",
    "CIVIL APPEAL NO.43-Q OF 2018": "CA-43-Q-2018",
    "Civil Appeal No. 1 of 2020": "CA-1-2020",
    "Civil Petition No. 34-Q of 2019": "CP-34-Q-2019",
    "CIVIL APPEALS NOS.06 AND 724 OF 2016": "CA-6-2016 CA-724-2016",
    "Civil Appeals No.26-K to 28-K of 2021": "CA-26-K-2021 CA-27-K-2021 CA-28-K-2021",
    "C.A. 23-P/2017": "CA-23-P-2017",
    "C.A.23-P/2017": "CA-23-P-2017",
    "CA 5-Q/2014": "CA-5-Q-2014",
    "C.P.L.A. 34-Q/2019": "CP-34-Q-2019",
    "Crl.A. 12-L of 2019": "CRA-12-L-2019",
    "Criminal Petition No. 99-L of 2020": "CRP-99-L-2020",
    "Constitution Petition No. 39 of 2019": "CONSTP-39-2019",
    "Suo Motu Case No. 7 of 2017": "SMC-7-2017",
    "Civil Petition for Leave to Appeal No. 3-K of 2020": "CP-3-K-2020",
    "CIVIL PETITIONS NO.45 AND 64 TO 70 OF 2018": "CP-45-2018 CP-64-2018 CP-65-2018 CP-66-2018 CP-67-2018 CP-68-2018 CP-69-2018 CP-70-2018",
    "H.R.C. NO. 36629-S OF 2018": "HRC-36629-S-2018",
    "bail granted despite murder charges": "",
    "Article 199 of the Constitution": "",
    "judgment dated 18.03.2014": "",
    "CIVIL APPEAL NO. 23-P OF 2017 (On appeal against the judgment dated 12.05.2017 passed by the Peshawar High Court in Civil Revision No. 699-P/2013)": "CA-23-P-2017",
    "Civil Appeals No. 1 to 90 of 2020": "CA-1-2020 CA-90-2020",
    "Civil Appeals No. 1-K to 3-L of 2020": "CA-1-K-2020 CA-3-L-2020",
}
STATUTES = {
    "under Article 199 of the Constitution": ["Article 199"],
    "Article 185(3) of the Constitution": ["Article 185(3)"],
    "Art. 184 (3)": ["Article 184(3)"],
    "section 302 PPC": ["Section 302 PPC"],
    "s.302 PPC": ["Section 302 PPC"],
    "Section 302 of the Pakistan Penal Code": ["Section 302 PPC"],
    "section 497 Cr.P.C.": ["Section 497 CrPC"],
    "Section 9(c) of the CNSA": ["Section 9(c) CNSA"],
    "Order XXI Rule 1 CPC": ["Order 21 Rule 1 CPC"],
    "the Civil Servants Act, 1973": ["Civil Servants Act 1973"],
    "under the Representation of the People Act, 1976": ["Representation of the People Act 1976"],
    "Service Tribunals Act 1973": ["Service Tribunals Act 1973"],
    "section 9 alone names no code": [],
    "bail granted despite murder charges": [],
    "Under Article 199 and Section 302 PPC, Order IX rule 13 of the Evidence Act, 1872": ["Article 199", "Section 302 PPC", "Order 9 Rule 13 CPC", "Evidence Act 1872"],
}
SPELLINGS = {
    "nikkah case issue": "nikah case issue",
    "Nikaah": "nikah",
    "nikahnama forged": "nikah nama forged",
    "nikkah-nama": "nikah nama",
    "haq mahar not paid": "haq mehr dower not paid",
    "haq-e-mehr": "haq mehr dower",
    "khulla decree": "khula decree",
    "talaaq notice": "talaq divorce notice",
    "heba of land": "hiba gift of land",
    "haq shufa suit": "haq shufa pre-emption suit",
    "preemption suit": "pre-emption suit",
    "virasat mutation": "wirasat inheritance mutation",
    "qasas and diyat": "qisas and diyat",
    "Mehr Ali v. State": "Mehr Ali v. State",
    "constable dismissed from service": "constable dismissed from service",
    "the hearing was adjourned": "the hearing was adjourned",
    "shuffle, tally, ideal, khaled, hibernate": "shuffle, tally, ideal, khaled, hibernate",
    "": "",
}
CATEGORIES = {
    "legal dispute": "too_broad",
    "any case": "too_broad",
    "family dispute": "family",
    "family disputes": "family",
    "matrimonial matters": "family",
    "election cases": "election",
    "service matter": "service",
    "trade mark cases": "intellectual_property",
    "family dispute over evacuee land in Tando Adam": "none",
    "who owns a brand name after a company is restructured": "none",
    "imran khan bail case": "none",
    "case of car selling": "none",
    "C.A. 57-K/2018": "none",
}


@pytest.mark.parametrize("said", CASES)
def test_case_numbers(said):
    got = parse.case_numbers(said)
    want = CASES[said].split()
    assert got[: len(want)] == want and bool(got) == bool(want)


@pytest.mark.parametrize("said", SPELLINGS)
def test_spelling(said):
    assert parse.spelling(said) == SPELLINGS[said]


def mapped(spark, f, said):
    df = spark.createDataFrame([(x,) for x in said], "t string").select("t", f(F.col("t")).alias("out"))
    return {r.t: r.out for r in df.collect()}


def test_statutes(spark):
    assert mapped(spark, parse.statutes_of, [*STATUTES, None]) == STATUTES | {None: []}
    assert parse.roman_of(21) == "XXI" and [parse.roman(parse.roman_of(n)) for n in range(1, 400)] == list(range(1, 400))


def test_categories(spark):
    assert mapped(spark, cards.category_of, [*CATEGORIES, None, ""]) == CATEGORIES | {None: "none", "": "none"}
    grounds = {"the dower deed in the Nikah Nama": ["dower", "nikah nama"], "maintenance of the building": []}
    assert mapped(spark, lambda c: cards.category_phrases_of(c, "family"), grounds) == grounds
    assert mapped(spark, lambda c: cards.category_phrases_of(c, "criminal"), ["an F.I.R. was made", "in custody", "fxixr"]) == {"an F.I.R. was made": ["f.i.r"], "in custody": [], "fxixr": []}


def test_dates_outcomes_and_citations(spark):
    dates = {"31.02.2020 then 5th March, 2021": "05.03.2021", "1/2/49 ": "01.02.2049", "1/2/51 ": "01.02.1951", "none": None, "3 may 1999": "03.05.1999", None: None}
    assert mapped(spark, parse.first_date_of, dates) == dates
    outcomes = {"The appeal is allowed.": "allowed", "allowed in part, dismissed in part": "unknown", "partly allowed and dismissed": "partly allowed", None: "unknown", "": "unknown"}
    assert mapped(spark, parse.outcome_of, outcomes) == outcomes
    cited = {"see 2011 SCMR 7 and PLD 2010 Supreme Court 5, 2011  SCMR 7": ["2011 SCMR 7", "PLD 2010 SC 5"], None: []}
    assert mapped(spark, parse.citations_of, cited) == cited
