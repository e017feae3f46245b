"""Near dedup: every threshold has bands that find its pairs."""

import pytest

from marginalia.llm import near_dedup

DOCS = "doc_id long, text string"


def near(share_from: int, pairs: int) -> list[tuple]:
    """Pairs of 104 words: 100 shingles each, of which share_from - 4 are common."""
    rows = []
    for i in range(pairs):
        words = [f"p{i}_{j}" for j in range(104)]
        rows.append((2 * i, " ".join(words)))
        rows.append((2 * i + 1, " ".join(words[:share_from] + [f"q{i}_{j}" for j in range(share_from, 104)])))
    return rows


@pytest.mark.parametrize("percent", [10, 30, 50, 70, 80, 85, 95, 100])
def test_bands_find_pairs_at_the_threshold(percent):
    bands, rows = near_dedup.bands_of(percent)
    assert bands * rows <= near_dedup.REGISTERS and (1 - (percent / 100) ** rows) ** bands < 1e-6


def test_pairs_far_below_the_default_are_found(spark):
    # 68 of 100 shingles are common: similarity 68 / 132
    found = near_dedup.near_duplicates(spark.createDataFrame(near(72, 200), DOCS), percent=50)
    assert found.filter("kept").count() == 200


def test_pairs_from_80_percent_are_found(spark):
    # 90 of 100 shingles are common: similarity 90 / 110; then 88 / 112, too little
    rows = near(94, 60) + [(d + 1000, f"x{t}".replace(" ", " x")) for d, t in near(92, 60)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), percent=80).filter("kept")
    assert sorted(r.doc_id for r in found.collect()) == sorted(r[0] for r in near_dedup.brute_force(rows, 80) if r[3])
    assert found.count() == 60 + 120


def test_short_texts_keep_their_links(spark):
    """6 against 7 shingles: the registers' estimate alone would reject some of so many pairs."""
    rows = []
    for i in range(3000):
        words = [f"s{i}_{j}" for j in range(11)]
        rows += [(2 * i, " ".join(words[:10])), (2 * i + 1, " ".join(words))]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS))
    assert found.filter("kept").count() == 3000
