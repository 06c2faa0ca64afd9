"""Every catalogue query against its SQL on the smallest tables."""

import pytest

from compare import connect, of_spark, of_sql
from penlake.plans.catalogue import ORACLES, QUERIES  # importing the package registers all

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    got, want = of_spark(QUERIES[name](spark, SF)), of_sql(duck, ORACLES[name])
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_nothing_is_cut(spark, duck):
    """The forms at the reference's bounds keep every token, character and pair of the given tables."""
    n = dict(duck.execute("SELECT user_id, count(*) FROM events GROUP BY user_id").fetchall())
    pads = {r["item_id"]: r["x"].split() for r in QUERIES["q17b_shift_pad_long"](spark, SF).collect()}
    assert {k: len(x) for k, x in pads.items()} == dict.fromkeys(n, 1500) and {k: x.index("523") for k, x in pads.items()} == {k: 2 * v for k, v in n.items()}
    chars = dict(duck.execute("SELECT doc_id, length(text) FROM documents WHERE text <> ''").fetchall())
    assert {r["doc_id"]: len(r["ids"].split()) for r in QUERIES["q15b_encode_whole_text"](spark, SF).where("ids <> ''").collect()} == chars
    assert QUERIES["q41b_causal_attention_long"](spark, SF).count() == sum(v * (v + 1) // 2 for v in n.values())
    assert QUERIES["q42b_cross_attention_whole"](spark, SF).count() == sum(v * v for v in n.values())
