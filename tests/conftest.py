import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from touchline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def make_matches(spark):
    """Rows (season, date, home, away, hg, ag[, hs, as, hst, ast]) as contests."""
    from touchline import schema as S

    names = {}

    def code(team):
        return names.setdefault(team, len(names))

    def build(rows, league=0):
        out = []
        for i, (season, date, home, away, hg, ag, *rest) in enumerate(rows):
            hs, as_, hst, ast = rest or (10, 10, 5, 5)
            ftr = "H" if hg > ag else "A" if hg < ag else "D"
            out.append((i, league, season, dt.date.fromisoformat(date), code(home), code(away), hg, ag, hs, as_, hst, ast, ftr))
        return spark.createDataFrame(out, S.CONTEST_SCHEMA)

    build.code = code
    return build
