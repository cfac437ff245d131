import datetime as dt
import os
import sys
import tempfile
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from costlens.session import build_session  # noqa: E402
from costlens.sources import schemas  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    warehouse = tempfile.mkdtemp(prefix="costlens-test-wh-")
    s = build_session("local[4]", shuffle_partitions=4,
                      extra={"spark.sql.warehouse.dir": warehouse, "spark.driver.memory": "4g"})
    yield s
    s.stop()


def ts(text):
    return dt.datetime.fromisoformat(text)


def usage_row(record_id, start, *, ws="w1", cloud="AWS", sku="SKU_A", product="JOBS", unit="DBU", qty="1.00",
              hours=1, job_id="j1", run_id="r1", job_name=None, notebook_id=None, notebook_path=None,
              endpoint=None, run_as="u@x", serverless=True, offering=None, tags=None, account="a1"):
    s = ts(start)
    return (record_id, account, ws, cloud, sku, product, unit, Decimal(qty), s, s + dt.timedelta(hours=hours),
            s.date(), tags, (job_id, run_id, job_name, notebook_id, notebook_path, endpoint), (run_as,),
            (serverless, (offering,)))


def usage_df(spark, rows):
    return spark.createDataFrame(rows, schemas.USAGE)


def price_row(sku, start, end, list_price, eff_price, cloud="AWS", unit="DBU", account="a1"):
    return (account, cloud, sku, unit, ts(start), ts(end) if end else None,
            (Decimal(list_price), (Decimal(eff_price),)))


def prices_df(spark, rows):
    return spark.createDataFrame(rows, schemas.LIST_PRICES)
