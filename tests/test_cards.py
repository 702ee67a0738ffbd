from tessera.functions import cards

CAPTION = """IN THE SUPREME COURT
PRESENT:
Mr. Justice A. B. KHAN, CJ
Mrs. Justice sara noor
Civil Appeal No. 12 of 2019
(On appeal from the judgment (in appeal) of the High Court)
1. Ahmad Ali and others
...Appellants
Versus
The State through Secretary
...Respondent
For the appellants: Mr. Zia Ud Din, ASC
Syed Hasan, AOR
For the respondent: Ms. Amna Shah, DAG
"""


def test_captions():
    assert cards.bench(CAPTION) == ["A. B. Khan (CJ)", "Sara Noor"]
    assert cards.parties(CAPTION) == ["Ahmad Ali", "The State"]
    assert cards.counsel(CAPTION) == ["appellants: Mr. Zia Ud Din", "appellants: Syed Hasan", "respondent: Ms. Amna Shah"]
    (a, b), = cards.lower_court_spans(CAPTION)
    assert CAPTION[a:b] == "(On appeal from the judgment (in appeal) of the High Court)"
    assert cards.parties("no sides") == [] and cards.bench(None) == [] and cards.counsel(None) == []


TYPES = {"Civil Appeal No. 3 of 2001": "case", "2011 SCMR 7": "citation", "Section 302 PPC": "statute", "Ali v. State": "entity", "appeals dismissed": "disposition", "rights of tenants": "issue", " ".join(["word"] * 13): "paraphrase", "": "unknown", None: "unknown"}


def test_query_types(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(x,) for x in TYPES], "t string").select("t", cards.query_type_of(F.col("t")).alias("k"))
    assert {r.t: r.k for r in rows.collect()} == TYPES


def test_small_parsers():
    assert cards.numbers_in("twenty-five of 7 and forty") == ["25", "40", "5", "7"]
    assert cards.key_from_filename("c.p._12_2020.pdf") == "CP-12-2020" and cards.key_from_filename("x.pdf") is None
    assert cards.json_in('noise ```json\n{"b": 1, "a": [2]}\n``` end') == '{"a": [2], "b": 1}' and cards.json_in("none") is None
    assert cards.grounded_text("He met Ali. He met Omar in 1999.", "ali was there") == "He met Ali."


def test_card_columns(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("CA-1-2000", " ", "Other", ["a", "", "b"], [0.1, 0.9, 0.5])], "c string, s string, t string, l array<string>, f array<double>")
    got = row.select(
        cards.contextual_header(F.col("c"), F.col("s"), F.col("t")).alias("h"), cards.card_row(F.col("l")).alias("r"), cards.card_text({"Case": F.col("c"), "Subject": F.col("s")}).alias("t"), F.round(cards.facet_relevance(F.col("f")), 6).alias("f"), cards.facet_query(F.lit("a b c"), 2).alias("q"),
        cards.readable_status({"x": F.lit(True), "y": F.lit(None).cast("boolean")}, ["x"]).alias("status"), cards.effective_plan(F.lit("pro"), F.lit(1), F.lit(2)).alias("plan"),
    ).first()
    assert tuple(got) == ("[CA-1-2000]", "a; b", "Case: CA-1-2000", 0.7, "a b", "searchable", "free")
