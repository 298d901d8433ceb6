"""Rows and entities that earlier limits left out."""

import pytest
from cases import got, prose, table

from furrow.llm import pii, quality
from furrow.llm.common import Scratch


def documents(n, start=0, lang="en", source="s"):
    return [(start + k, prose(start + k, 60 + k % 150), lang, source, 0, "", "", 0.0, 0) for k in range(n)]


def junk(i, lang="en", source="s"):
    return (i, " ".join(f"{w}#$%&*<>{w}{w}{w}" for w in prose(i, 80).split()), lang, source, 0, "", "", 0.0, 0)


@pytest.mark.parametrize(
    "rows",
    [
        [*documents(60), junk(9000)],  # one group of under 100 rows
        [*documents(200), *documents(5, 500, source="few"), junk(9000, source="few")],  # few rows of a large language
        [*documents(200), *documents(5, 500, "de"), junk(9000, "de")],  # a small language
        [*documents(20), junk(9000)],  # a small corpus
    ],
)
def test_rows_of_small_groups_are_judged(spark, rows):
    out = got(quality.quality(spark, table(spark, rows)))
    assert not out[9000][0]["base_failed"] and not out[9000][0]["kept"]
    assert sum(r[0]["kept"] for r in out.values()) >= 0.97 * (len(rows) - 1)


def test_prediction_quantiles():
    assert quality.prediction_quantile(0.95, 5, 20_000) == pytest.approx(11.07, abs=0.02)
    assert quality.prediction_quantile(0.95, 1, 11) == pytest.approx(2.228**2 * 12 / 11, rel=2e-3)


def test_more_names_than_forty_attempts_could_hold(spark):
    n = 25_000  # of family names in Cyrillic script attempts 0 to 39 gave 23,325
    names = spark.range(n).selectExpr("'family-cyrillic' as kind", "concat('ё', id) as canon")
    out = pii.settle(spark, Scratch(spark), names, b"test").collect()
    tries = {r["canon"]: r["attempt"] for r in out}
    assert len({pii.surrogate(b"test", "family-cyrillic", f"ё{k}", tries.get(f"ё{k}", 0)) for k in range(n)}) == n


def test_exhausted_formats_get_longer():
    assert len(pii.surrogate(b"test", "phone", "+112345", pii.WIDEN)) == 8
    assert pii.shaped("phone", "+1 1 23 45", "+1678901") == "+1 6 78 901"
    assert len({pii.surrogate(b"test", "ip", "10.1.2.3", pii.WIDEN + k).split(".")[0] for k in range(20)}) > 1
