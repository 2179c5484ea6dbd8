import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.session import session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    # tiny inputs: compiling a class per stage would take longer than running it
    return session(**{"spark.sql.codegen.wholeStage": "false", "spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def ops(spark):
    from garimpo.plans.base import operations
    from garimpo.schema import stage

    return stage(operations(spark, SMALL))
