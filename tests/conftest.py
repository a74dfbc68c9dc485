import os
import sys
from pathlib import Path

import pytest

# several threads a matrix product only get in each other's way here
os.environ.setdefault("OMP_NUM_THREADS", "1")
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from lattica.session import session

    return session("local[4]", 4, **{"spark.sql.session.timeZone": "UTC"})
