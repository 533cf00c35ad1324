import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from cutline.session import build_session

    session = build_session("tests", 4)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def panel_rows(spark):
    """Two institutes x two rounds x five years, 20 rows."""
    rows = []
    for year in range(2018, 2023):
        for round_ in (1, 2):
            for name, kind, extra in (("Institute A", "IIT", 0), ("Institute B", "NIT", 50)):
                rows.append((
                    year, round_, name, kind, "Computer Science", "OPEN", "AI", "Gender-Neutral", False, 4,
                    "Bachelor of Technology", 100 + 10 * (year - 2018) + round_, 200 + 20 * (year - 2018) + round_ + extra,
                    f"{year}_round_{round_}.csv", 0))
    return spark.createDataFrame(rows, (
        "year bigint, round bigint, institute string, institute_type string, program string, category string, quota string, "
        "gender string, is_pwd boolean, duration_years bigint, degree_type string, opening_rank bigint, closing_rank bigint, "
        "source_file string, source_row_id bigint")).cache()
