import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from runlens.operators.runs import MAX_ROWS_CONF  # noqa: E402
from runlens.schemas import FLAT_EVENT  # noqa: E402
from runlens.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="6g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def run_limit(spark):
    """Set the number of rows above which a run is split."""
    yield lambda rows: spark.conf.set(MAX_ROWS_CONF, str(rows))
    spark.conf.unset(MAX_ROWS_CONF)


@pytest.fixture
def flat(spark):
    """Flat events from dictionaries; run, player and position have defaults."""
    defaults = {"run_id": "r", "player_id": "p", "dmg_amount": 0.0, "is_elite_source": False,
                "hp": 1.0, "max_hp": 1.0, "chosen_upgrade_id": "unknown"}

    def make(*events):
        rows = []
        for at, event in enumerate(events):
            row = {"event_id": at, "timestamp": at * 1000, **defaults, **event}
            rows.append(tuple(row.get(name) for name in FLAT_EVENT.fieldNames()))
        return spark.createDataFrame(rows, FLAT_EVENT)

    return make


def values(frame, *columns):
    return [tuple(row) for row in frame.select(*columns).collect()]
