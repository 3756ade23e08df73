from datetime import date

import pytest

from steppe.config import Config, Period, Target, accumulation_months, expected_split_rows, load_config, parse_years, violations
from steppe.plans.inputs import CONFIG


def test_the_default_configuration_breaks_no_rule():
    assert violations(CONFIG) == []


@pytest.mark.parametrize(
    ("splits", "targets", "word"),
    [
        ({"train": Period.years(2001, 2005), "test": Period.years(2005, 2006)}, (), "overlaps"),
        ({"train": Period.years(2001, 2005), "test": Period.years(2006, 2007)}, (), "gap"),
        ({"train": Period.years(2001, 2005)}, (Target("spi_6", 6),), "accumulates"),
        ({"train": Period.years(2001, 2005)}, (Target("spi_1", 9),), "reaches"),
        ({"train": Period.years(2001, 2005)}, (Target("spi_3", 1),), "known at issue"),
        ({"train": Period.years(2001, 2005)}, (Target("spi_1", 1, "classification"),), "threshold"),
    ],
)
def test_violations_are_named(splits, targets, word):
    assert any(word in v for v in violations(Config(Period.years(2001, 2003), splits, targets)))


def test_fit_period_must_not_reach_into_held_out_years():
    config = Config(Period.years(2001, 2006), {"train": Period.years(2001, 2004), "test": Period.years(2006, 2007)})
    assert any("fit period" in v for v in violations(config))


def test_months_years_and_names():
    assert Period.years(1981, 2025).months == 540
    assert expected_split_rows(2820, Period.years(1981, 2025)) == 1_522_800
    assert Period(date(2000, 1, 1), date(2000, 3, 1)).gap_to(Period(date(2000, 6, 1), date(2000, 7, 1))) == 2
    assert [accumulation_months(t) for t in ("spi_3", "spei_12", "sm_anom", "spi_x")] == [3, 12, 1, 1]
    assert parse_years("1981-1983", 0, 1) == [1981, 1982, 1983] and parse_years("1990", 0, 1) == [1990] and parse_years("", 5, 6) == [5, 6]


def test_config_file(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("fit: {start: 1995-01-01, end: 1999-12-01}\nsplits: {train: {start: 1995-01-01, end: 1999-12-01}}\ntargets: [{name: spi_1, lead_months: 1}]\n")
    config = load_config(str(path))
    assert config.fit.months == 60 and config.targets[0].accumulation == 1 and violations(config) == []
