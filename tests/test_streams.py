"""Streams over lost checkpoints, broken-off batches, late rows; logs of topics."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tidepanel.sources import topics
from tidepanel.sources.tables import delete, folder
from tidepanel.streaming.drain import compact_changes, drain, drain_json, follow_latest, latest_state, log_topics, read_state

SCHEMA = "id long, price double"


@pytest.fixture()
def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def put(path, name, *rows):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}.json", "w") as f:
        f.write("\n".join(json.dumps(dict(zip(("id", "price"), r, strict=True))) for r in rows))


def judge(q):
    return q.withColumn("reason", F.when(F.col("price").isNull(), "no price"))


def taken(spark, base):
    read = lambda name: sorted(r["id"] for r in spark.read.parquet(f"file://{base}/{name}").collect()) if any(n.startswith("commit") for n in os.listdir(f"{base}/{name}")) else []
    return read("valid"), read("invalid")


def run(spark, base, schema, checkpoint, **options):
    drain_json(spark, f"file://{base}/in", schema, judge, f"file://{base}/valid", f"file://{base}/invalid", f"file://{base}/{checkpoint}", **options)


def test_a_lost_checkpoint_doubles_nothing(spark, tmp_path, schema):
    put(f"{tmp_path}/in", "a", (1, 1.0), (2, None))
    run(spark, tmp_path, schema, "first")
    put(f"{tmp_path}/in", "b", (3, 1.0), (4, 2.0))
    run(spark, tmp_path, schema, "first")
    assert taken(spark, tmp_path) == ([1, 3, 4], [2])
    shutil.rmtree(f"{tmp_path}/first")
    run(spark, tmp_path, schema, "first")
    assert taken(spark, tmp_path) == ([1, 3, 4], [2])
    # lost again, and a new file comes with the old ones in one batch; then one by one
    put(f"{tmp_path}/in", "c", (5, 1.0), (1, None))
    run(spark, tmp_path, schema, "second")
    put(f"{tmp_path}/in", "d", (6, 6.0))
    run(spark, tmp_path, schema, "third", maxFilesPerTrigger="1")
    assert taken(spark, tmp_path) == ([1, 3, 4, 5, 6], [1, 2])


def test_a_batch_that_broke_off_is_not_seen_and_comes_again(spark, tmp_path, schema):
    put(f"{tmp_path}/in", "a", (1, 1.0), (2, None))
    run(spark, tmp_path, schema, "first")
    name = next(n for n in os.listdir(f"{tmp_path}/valid") if n.startswith("commit"))
    # as after a stop before the record: rows aside only
    for at in ("valid", "invalid"):
        os.makedirs(f"{tmp_path}/{at}/_aside", exist_ok=True)
        shutil.move(f"{tmp_path}/{at}/{name}", f"{tmp_path}/{at}/_aside/{name}")
    shutil.move(f"{tmp_path}/valid/_commits/{name}", f"{tmp_path}/kept")
    assert taken(spark, tmp_path) == ([], [])
    # as after a stop between the record and the move: the next run, with nothing new, ends it
    shutil.move(f"{tmp_path}/kept", f"{tmp_path}/valid/_commits/{name}")
    run(spark, tmp_path, schema, "first")
    assert taken(spark, tmp_path) == ([1], [2])
    # without the record a new checkpoint takes the rows again, once
    for at in ("valid", "invalid"):
        shutil.move(f"{tmp_path}/{at}/{name}", f"{tmp_path}/{at}/_aside/{name}")
    shutil.rmtree(f"{tmp_path}/valid/_commits/{name}")
    run(spark, tmp_path, schema, "second")
    assert taken(spark, tmp_path) == ([1], [2])


def test_latest_state_over_restarts_replays_and_late_rows(spark, tmp_path, schema):
    at = lambda name: f"file://{tmp_path}/{name}"
    state = lambda checkpoint: {r["id"]: r["price"] for r in follow_latest(spark, at("in"), schema, "id", "price", at("store"), at(checkpoint)).collect()}
    put(f"{tmp_path}/in", "a", (1, 5.0), (2, 1.0))
    assert state("first") == {1: 5.0, 2: 1.0}
    put(f"{tmp_path}/in", "b", (2, 7.0), (1, 3.0))
    assert state("first") == {1: 5.0, 2: 7.0}
    # a batch writes the keys that it met, not the table: id 1 changed nothing but was touched
    last = sorted(folder(spark, at("store")))[-1]
    assert spark.read.parquet(at(f"store/{last}")).count() <= 2
    put(f"{tmp_path}/in", "c", (3, 1.0))
    assert state("second") == {1: 5.0, 2: 7.0, 3: 1.0}
    # files that are gone stay known through the changes, whatever their number
    for f in os.listdir(f"{tmp_path}/in"):
        os.remove(f"{tmp_path}/in/{f}")
    put(f"{tmp_path}/in", "d", (3, 0.5), (4, 2.0))
    assert state("third") == {1: 5.0, 2: 7.0, 3: 1.0, 4: 2.0}
    assert {r["id"]: r["price"] for r in spark.read.parquet(latest_state(spark, at("in"), schema, "id", "price", at("store"), at("third"))).collect()} == {1: 5.0, 2: 7.0, 3: 1.0, 4: 2.0}
    assert compact_changes(spark, schema, "id", "price", at("store"), more_than=1) == 1
    assert {r["id"]: r["price"] for r in read_state(spark, schema, "id", "price", at("store")).collect()} == {1: 5.0, 2: 7.0, 3: 1.0, 4: 2.0}
    delete(spark, at("store"))
    assert read_state(spark, schema, "id", "price", at("store")).count() == 0


def test_a_log_of_topics_is_read_by_offsets(spark, tmp_path, schema):
    """Segments go on where a partition ended; the checkpoint keeps an offset for each partition of each topic; lost, it doubles nothing."""
    topics.register(spark)
    at = f"file://{tmp_path}/log"
    rows = lambda *ids: spark.createDataFrame([(i, float(i) if i % 3 else None) for i in ids], SCHEMA)
    run = lambda checkpoint, **o: drain(log_topics(spark, topics.FORMAT, schema, path=at, **o), judge, f"file://{tmp_path}/valid", f"file://{tmp_path}/invalid", f"file://{tmp_path}/{checkpoint}")
    assert topics.append(rows(*range(10)), at, "a", "id", partitions=2, segment=3) == 10 and topics.append(rows(20, 21), at, "b", "id", partitions=1) == 2
    run("first")
    assert taken(spark, tmp_path) == ([1, 2, 4, 5, 7, 8, 20], [0, 3, 6, 9, 21])
    topics.append(rows(10, 11), at, "a", "id", partitions=2)
    topics.append(rows(12), at, "c", "id")
    run("first", subscribe="a,b")
    assert taken(spark, tmp_path) == ([1, 2, 4, 5, 7, 8, 10, 11, 20], [0, 3, 6, 9, 21])
    ends = {k: v[-1][1] + 1 for k, v in topics.segments(at).items()}
    assert sum(n for k, n in ends.items() if k.startswith("a/")) == 12 and ends["b/0"] == 2
    offsets = sorted((f for f in os.listdir(f"{tmp_path}/first/offsets") if f.isdigit()), key=int)
    last = json.loads(open(f"{tmp_path}/first/offsets/{offsets[-1]}").read().splitlines()[-1])
    assert last == {k: n for k, n in ends.items() if not k.startswith("c/")}
    run("second")
    assert taken(spark, tmp_path) == ([1, 2, 4, 5, 7, 8, 10, 11, 20], [0, 3, 6, 9, 12, 21])
