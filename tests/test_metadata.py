"""The metadata struct on a whole judgment, regions and precedence, attribution of outcomes, query analysis."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import metadata, parse

CAPTION = """IN THE SUPREME COURT OF PAKISTAN
--- PAGE 1 ---
ORDER
PRESENT:
MR. JUSTICE SH. AZMAT SAEED, HCJ
MR. JUSTICE OMAR KHAN
CIVIL APPEALS NOS. 5-Q AND 7 TO 9 OF 2014
(On appeal from the judgment dated 12.05.2013 passed by the Peshawar High Court, Bannu Bench in Civil Revision No. 699-P/2013)
Gul Khan and others … Appellant(s)
VERSUS
1. Province of KPK through Secretary … Respondent(s)
For the Appellant: Mr. Ali Zafar, Sr. ASC
Date of hearing: 3rd May, 2017
JUDGMENT
Mr. X filed under Section 302 PPC and the Land Acquisition Act, 1894 and (Appointment) Rules 1974. See 2010 SCMR 123.
Date of decision: 01.01.1999
"""


def one(spark, text, order=None):
    df = spark.createDataFrame([(1, text, order)], "id long, text string, final string")
    return metadata.metadata(df, "id", "text", "final").first()


def test_whole_judgment(spark):
    r = one(spark, CAPTION + "filler " * 150 + "\nThe appeal is dismissed.\nAnnounced in open court on 7.8.17.\nIslamabad, the 9th August, 2017")
    assert r.case_keys == ["CA-5-Q-2014", "CA-7-2014", "CA-8-2014", "CA-9-2014"]
    assert r.case_display == "Civil Appeal No. 5-Q of 2014 (+3 connected)"
    assert (r.case_refs[0].type, r.case_refs[0].number, r.case_refs[0].registry, r.case_refs[0].year) == ("CA", "5", "Q", 2014)
    assert r.bench == ["Sh. Azmat Saeed (CJ)", "Omar Khan"]
    assert (r.appellant, r.respondent) == ("Gul Khan", "Province of KPK")
    assert (r.lower_court, r.impugned_date) == ("Peshawar High Court, Bannu Bench", "12.05.2013")
    assert (r.decision_date, r.decision_date_source) == ("07.08.2017", "announced")
    assert (r.outcome, r.outcome_source) == ("dismissed", "raw_tail")
    assert r.statutes == ["Section 302 PPC", "Land Acquisition Act 1894"] and r.citations == ["2010 SCMR 123"]
    assert one(spark, CAPTION, "The appeal is allowed.").outcome_source == "final_order"


def test_precedence_of_dates(spark):
    body = "filler " * 150
    when = lambda text: (one(spark, text).decision_date, one(spark, text).decision_date_source)
    assert when(CAPTION + body) == ("03.05.2017", "hearing")
    assert when(CAPTION + body + "\nLahore, the 4th June, 2018") == ("04.06.2018", "signature")
    assert when(CAPTION.replace("Date of hearing", "Date of announcement : 31.12.16\nDate of hearing") + body + "\nAnnounced on 1.1.2020") == ("31.12.2016", "caption_decision")
    assert when("no dates at all") == (None, None)


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "JUDGMENT"), (4, "x" * 300_000), (5, "(On appeal " * 3000)]
    got = metadata.metadata(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()
    assert len(got) == 5 and all(r.case_keys == [] and r.decision_date is None and r.outcome == "unknown" for r in got)


def test_statutes_and_refs_by_place():
    assert parse.case_refs("CP 1/2019, C.P. 1 of 2019")[0]["display"] == "Civil Petition No. 1 of 2019"
    assert len(parse.case_refs("CP 1/2019, C.P. 1 of 2019")) == 1
    assert parse.case_numbers("the escp 5/2014 and cast 3 of 2014") == []
    assert parse.statutes("Order 21 Rule 58(2), s. 9 of the QSO; Arts. 4 and Section 10-A CPC") == ["Article 4", "Section 9 QSO", "Order 21 Rule 58(2) CPC"]
    assert parse.spelling("nikkah namah and haq mehr") == "nikah nama and haq mehr dower"


@pytest.mark.parametrize(
    ("said", "outcome"),
    [
        ("The tribunal reinstated him. The department appealed to the Supreme Court. The Supreme Court set aside the order of the tribunal.", "allowed"),
        ("The High Court ruled in her favour and we appealed to the Supreme Court.", None),
        ("Leave to appeal was granted by the Supreme Court on this point.", None),
        ("His plea went up to the Supreme Court of the land. In the end the appeal was dismissed with costs.", "dismissed"),
        ("His plea went up to the Supreme Court of the land. In the end the departmental appeal was dismissed with costs.", None),
        ("The appeal was partly allowed by this Court in the last round.", "partly_allowed"),
        ("They lost in the family court and the suit was dismissed there.", None),
        ("The matter was remanded by the apex court to the High Court.", "remanded"),
        (None, None),
        ("", None),
    ],
)
def test_supreme_outcome(said, outcome):
    assert metadata.supreme_outcome(said) == outcome


def test_query_analysis(spark):
    long = "my brother was removed from service and the tribunal reinstated him. The department went to the Supreme Court in Quetta and Lahore. After a hearing there the Supreme Court upheld the removal with costs"
    asked = {1: "Gul Khan vs. State of X", 2: "C.A. 5-Q/2014", 3: "bail in Karachi 2015 under Family Courts Act, 1964", 4: long, 5: None, 6: "appeal dismissed 1890 2035 1999"}
    got = {r.id: r for r in metadata.query_analysis(spark.createDataFrame([*asked.items()], "id long, text string"), "id", "text").collect()}
    assert got[1].parties == ["Gul Khan", "State of X"] and got[1].type == "entity"
    assert got[2].registry == "Q" and got[2].years == [2014] and got[2].type == "case"
    assert got[3].registry == "K" and got[3].years == [2015] and got[3].statutes == ["Family Courts Act 1964"]
    assert got[4].narrative and got[4].outcome == "dismissed" and got[4].registry is None
    assert got[5].type == "unknown" and got[5].case_refs == [] and got[5].outcome is None
    assert got[6].outcome == "dismissed" and got[6].years == [1999]


def test_numbers_of_cases_are_no_years(spark):
    asked = {1: "C.A. 1947-L/2014 and in 2011", 2: "C.A. 2013-L/2014 in 2013", 3: "Civil Appeals Nos. 1999, 2001 to 2003 of 2014", 4: "C.A. 2014-L/2014", 5: "in 1999, 2001", 6: "it was 1950 - 1960", 7: None}
    got = {r.id: r.years for r in metadata.query_analysis(spark.createDataFrame([*asked.items()], "id long, text string"), "id", "text").collect()}
    assert got == {1: [2014, 2011], 2: [2014, 2013], 3: [2014], 4: [2014], 5: [1999, 2001], 6: [1950, 1960], 7: []}


def test_registry_needs_one_city(spark):
    df = spark.createDataFrame([(1, "Lahore and lahore"), (2, "Lahore, Quetta"), (3, "Islamabad")], "id long, t string").withColumn("refs", F.expr(f"cast(array() as array<{parse.CASE_REF}>)"))
    assert [r.x for r in df.orderBy("id").select(metadata.registry_of(F.col("refs"), F.col("t")).alias("x")).collect()] == ["L", None, None]
