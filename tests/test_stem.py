import pytest

from tessera.functions.stem import fold, stem


@pytest.mark.parametrize(
    ("word", "root"),
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("digitizer", "digit"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("allotted", "allot"), ("allotment", "allot"), ("be", "be"), ("r2d2", "r2d2")],
)
def test_published_examples(word, root):
    assert stem(word) == root


def test_fold():
    assert fold("NÓOR") == "noor"

