"""Every registered query of the engine against its SQL."""

import datetime
import os

import pytest

from strandweave import queries, vocab
from strandweave.operators import ledger

from .oracle import SMALL, duck, same_rows

MORE = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    return duck()


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, con, name):
    same_rows(queries.QUERIES[name](spark, SMALL), con, queries.ORACLES[name])


@needs_data
def test_queries_without_sql(spark):
    for name in set(queries.QUERIES) - set(queries.ORACLES):
        assert queries.QUERIES[name](spark, SMALL).count() > 0


@needs_data
def test_entry(spark):
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(MORE), reason="needs the driver's tables")
def test_round_trip_keeps_every_decided_pair(spark):
    wanted = ledger.dump(queries._log(spark, MORE)).drop("log_seq")
    back = queries.sssom_roundtrip(spark, MORE)
    assert wanted.count() == back.count() > 500
    assert wanted.exceptAll(back.drop("log_seq")).isEmpty()
    pairs = [(r.subject_id, r.object_id) for r in back.orderBy("log_seq").collect()]
    assert pairs == sorted(pairs) and len(set(pairs)) == len(pairs)


def test_every_row_of_the_log_decides(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    events = [(3, day, 0, "error"), (5, day, 0, "signup"), (12, day, 10, "purchase"), (4, day, 0, "view")]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(i, i, [1.0]) for i in range(20)], "vec_id long, label long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    pairs = {(f"s:{s}", f"t:{t}") for s in (0, 10) for t in range(20) if t % 10}
    kept = queries.QUERIES["filter_decided"](spark, str(tmp_path)).collect()
    assert len(kept) == 17 and {tuple(r) for r in kept} == {p for p in pairs if p[0] == "s:0" and p != ("s:0", "t:3")}
    told = {("s:0", "t:5"): ("skos:narrowMatch", vocab.MMC), ("s:10", "t:12"): ("skos:exactMatch", vocab.HC)}
    got = queries.QUERIES["refresh_from_log"](spark, str(tmp_path)).collect()
    assert {((r[0], r[1]), (r[2], r[3])) for r in got} == {(p, told.get(p, (vocab.RELATED, vocab.LEXICAL))) for p in pairs}
