"""The parsers of judgments read every whole document, as it is."""

import pytest

from tessera.plans import sections  # noqa: F401
from tessera.plans.catalogue import QUERIES

TAIL = "x " * 3000 + "\nPLD 2010 Supreme Court 5. Section 302 PPC. Civil Appeal No. 12 of 2019. We saw khulla.\n"


@pytest.mark.parametrize("name", ["case_numbers", "statutes", "citations", "spelling", "captions", "segment_sections", "parse_quality"])
def test_each_document_is_read(spark, tmp_path, name):
    spark.createDataFrame([(7, TAIL), (8, "Nothing here."), (9, TAIL)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r[0]: tuple(r)[1:] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert set(rows) == {7, 8, 9} and rows[7] == rows[9]
    if name in ("case_numbers", "statutes", "citations"):
        assert rows[7][0] and not rows[8][0]
