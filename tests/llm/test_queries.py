import pytest

from postloom.llm.oracle import SQL
from postloom.llm.queries import QUERIES
from tests.oracle_check import compare, connect

COLUMNS = {
    "p1_found": ["rec_table", "rec_id", "info_type"], "p2_found": ["rec_table", "rec_id"], "p3_found": ["first_id", "post_id"], "p4_found": ["section", "cluster_id", "topic_id"], "p5_found": ["vec_a", "vec_b"],
    "p6_found": ["rec_type", "rec_key", "term"], "p7_found": ["topic_id", "rec_field", "markup_type"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "residue_type"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    df = QUERIES[name](spark, small)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert df.count() == df.distinct().count()
    if name in SQL:
        compare(df, connect(small), SQL[name])
    else:
        assert df.count() > 0
