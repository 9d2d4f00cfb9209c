import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import oracle
from talaan.llm.queries import QUERIES, SQL

data = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="needs the driver's tables")


@data
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert oracle.differs(spark, QUERIES[name], SQL[name]) == ""


COLUMNS = {
    "p1_found": ["lead_id", "group_id"], "p2_found": ["group_no", "field_name", "lead_id"], "p3_found": ["ref_a", "ref_b"], "p4_found": ["row_key", "city_id"], "p5_found": ["address_id_a", "address_id_b"],
    "p6_found": ["lead_id_a", "lead_id_b"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"],
}


@data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, oracle.DATA)
    assert df.count() >= 1
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    if name == "p8_round_trip":
        assert df.agg({"n_changed": "sum"}).first()[0] == 0
    if name == "p9_fill":
        assert df.first().used_share > 0.9 and df.first().fullest <= 2048
