import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from checks.session import local_session  # noqa: E402
from lanelytics import enrich  # noqa: E402
from lanelytics.sources.schema import LEGS  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.environ.get("TEST_CPUS", "8"), "lanelytics-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def make_legs(spark):
    """Builds enriched legs from rows that name only the columns they care about."""
    money = {f.name for f in LEGS.fields if f.dataType.typeName() == "decimal"}

    def build(*rows, **shared):
        from decimal import Decimal

        data = []
        for number, row in enumerate(rows):
            full = {"warpId": f"S-{number}", "orderCode": "P-1", **shared, **row}
            unknown = set(full) - set(LEGS.fieldNames())
            assert not unknown, unknown
            data.append(
                tuple(
                    Decimal(str(full[n])) if n in money and full.get(n) is not None else full.get(n)
                    for n in LEGS.fieldNames()
                )
            )
        return enrich(spark.createDataFrame(data, LEGS))

    return build
