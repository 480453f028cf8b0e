import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from larder import schemas as S  # noqa: E402
from larder.session import local_session  # noqa: E402

AS_OF = dt.date(2024, 1, 15)
D = dt.date
TS = dt.datetime


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8, app="larder-tests")
    yield s


def inventory_rows():
    """The nine edge items of FIXTURES.md (as_of 2024-01-15)."""
    rows = [
        (1, "Latte Intero", "2.000", "LITRI", D(2024, 1, 15), "LATTICINI", "FRIGO", "1.50"),
        (2, "Pomodori", "3.000", "KG", D(2024, 1, 20), "VERDURE", "DISPENSA", None),
        (3, "Pollo", "1.500", "KG", D(2024, 1, 12), "CARNE", "FRIGO", "7.90"),
        (4, "Yogurt", "4.000", "PEZZI", D(2024, 1, 16), "LATTICINI", "FRIGO", "0.00"),
        (5, "Tonno", "6.000", "PEZZI", None, "CONSERVE", "DISPENSA", "2.20"),
        (6, "Salmone", "0.000", "KG", D(2024, 1, 14), "PESCE", "FREEZER", "12.00"),
        (7, "Mele", "2.500", "KG", D(2024, 1, 18), "FRUTTA", "CANTINA", None),
        (8, "Acqua", "12.000", "LITRI", D(2024, 1, 19), "BEVANDE", "CANTINA", None),
        (9, "Burro_50%", "1.000", "PEZZI", D(2024, 1, 17), "LATTICINI", "FRIGO", None),
    ]
    created = TS(2024, 1, 1)
    return [(i, n, Decimal(q), u, e, None, c, loc, Decimal(p) if p is not None else None, None, None,
             created, created, "system") for i, n, q, u, e, c, loc, p in rows]


@pytest.fixture(scope="session")
def inventory(spark):
    return spark.createDataFrame(inventory_rows(), S.INVENTORY)


@pytest.fixture(scope="session")
def tasks(spark):
    base = [
        (1, "ALTA", "DA_FARE", D(2024, 1, 16), "anna", False, None, TS(2024, 1, 1)),
        (2, "BASSA", "DA_FARE", D(2024, 1, 16), None, False, None, TS(2024, 1, 2)),
        (3, "MEDIA", "IN_CORSO", D(2024, 1, 16), "NON_ASSEGNATO", False, None, TS(2024, 1, 3)),
        (4, "ALTA", "COMPLETATO", D(2024, 1, 10), "anna", True, "SETTIMANALE", TS(2024, 1, 4)),
        (5, "MEDIA", "ANNULLATO", D(2024, 1, 31), None, True, "MENSILE", TS(2024, 1, 5)),
        (6, "BASSA", "DA_FARE", None, "luca", True, "GIORNALIERA", TS(2024, 1, 6)),
        (7, "ALTA", "DA_FARE", D(2024, 1, 16), "anna", False, None, TS(2024, 1, 7)),
    ]
    rows = [(i, f"Task {i}", None, p, st, due, a, r, f, "system", c, "system", c, None)
            for i, p, st, due, a, r, f, c in base]
    return spark.createDataFrame(rows, S.TASK)


@pytest.fixture(scope="session")
def consumption(spark):
    rows = [
        (1, 1, Decimal("0.500"), TS(2024, 1, 1), "CONSUMATO", None),
        (2, 1, Decimal("0.250"), TS(2024, 1, 10, 23, 59, 59, 999000), "CONSUMATO", None),
        (3, 3, Decimal("1.000"), TS(2024, 1, 5), "SCADUTO", None),
        (4, 2, Decimal("1.000"), TS(2024, 1, 11), "BUTTATO", None),
        (5, 4, Decimal("2.000"), TS(2024, 1, 9), "BUTTATO", None),
    ]
    return spark.createDataFrame(rows, S.CONSUMPTION)
