import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from estuario.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # tiny inputs: compiling each plan would take most of the time
    s = build("local[4]", shuffle_partitions=3, **{"spark.driver.memory": "4g", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
