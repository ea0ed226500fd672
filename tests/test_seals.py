import pytest
from pyspark.sql import functions as F

from verdigris.operators import seals

ITEMS = "id long, name string, amount double"


def rows(n):
    return [(i, None if i % 9 == 0 else f"n{i % 40}", i / 4) for i in range(n)]


def root(df):
    return seals.merkle_roots(seals.merkle_leaves(df.select(seals.row_digest(df.columns).alias("d")), [], "d"), []).first()


def test_a_root_does_not_depend_on_order_or_partitions(spark):
    df = spark.createDataFrame(rows(500), ITEMS)
    first = root(df)
    assert first.rows == 500 and first == root(df.repartition(7, "name")) == root(df.orderBy(F.desc("id")))
    assert root(df.filter("id <> 77")) != first and root(df.unionByName(df.filter("id = 77"))) != first
    assert root(df.withColumn("name", F.coalesce("name", F.lit("")))) != first


def test_every_change_is_named(spark, tmp_path):
    df = spark.createDataFrame([*rows(800), (5, "twice", 1.0), (5, "twice", 1.0)], ITEMS)
    path = str(tmp_path / "seal")
    assert len(seals.seal(df, ["id"], path)) == 64
    assert seals.tampering(df.repartition(5), ["id"], path).count() == 0
    odd = df.filter("id <> 3 AND NOT (id = 5 AND name = 'twice')").unionByName(spark.createDataFrame([(5, "twice", 1.0), (9000, None, None), (10, "n10", 2.5)], ITEMS)).withColumn("amount", F.when(F.col("id") == 700, F.lit(None)).otherwise(F.col("amount")))
    found = {r.id: r.fault for r in seals.tampering(odd, ["id"], path).collect()}
    assert found == {3: "lost", 5: "lost", 9000: "added", 10: "added", 700: "changed"}
    assert {r.fault for r in seals.tampering(df.filter("false"), ["id"], path).collect()} == {"lost"}


def test_an_empty_table_has_a_seal(spark, tmp_path):
    none = spark.createDataFrame([], ITEMS)
    assert seals.seal(none, ["id"], str(tmp_path / "e")) == ""
    assert [r.fault for r in seals.tampering(spark.createDataFrame(rows(1), ITEMS), ["id"], str(tmp_path / "e")).collect()] == ["added"]


DECISION = "decision_id string, number long, packet long, id long, action string, item_digest string, reviewer string"


@pytest.fixture(scope="module")
def packets(spark):
    made = seals.prepare(spark.createDataFrame(rows(120), ITEMS), "id", 20).persist()
    yield made
    made.unpersist()


def test_packets_are_the_same_whatever_the_order(spark, packets):
    again = seals.prepare(spark.createDataFrame(rows(120)[::-1], ITEMS).repartition(3), "id", 20)
    assert sorted(map(tuple, packets.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    heads = seals.packet_heads(packets).collect()
    assert sum(h["items"] for h in heads) == 120 and len({h.seal for h in heads}) == len(heads) == 6


def test_decisions_are_applied_once(spark, packets):
    item = {r.id: r for r in packets.collect()}
    say = lambda i, name, number, action, **k: (f"{i}-{name}", number, k.get("packet", item[i].packet), i, action, k.get("digest", item[i].item_digest), k.get("reviewer", "r"))
    said = [
        say(1, "a", 1, "accept"), say(1, "a", 1, "accept"), say(1, "a", 5, "accept"), say(1, "b", 6, "reject"), say(2, "a", 2, "defer"), say(2, "b", 3, "reject"), say(3, "a", 4, "accept", digest="other"),
        say(4, "a", 7, "burn"), say(5, "a", 8, "accept", reviewer=" "), say(6, "a", 9, "accept", packet=item[6].packet + 100), ("x", 10, 0, 9999, "accept", "d", "r"),
    ]
    outcomes = seals.evaluate(packets, spark.createDataFrame(said, DECISION), "id").persist()
    got = {r.decision_id: (r.outcome, r.repeats) for r in outcomes.collect()}
    assert got == {
        "1-a": ("applied", 2), "1-b": ("too_late", 0), "2-a": ("applied", 0), "2-b": ("applied", 0), "3-a": ("stale", 0), "4-a": ("unknown_action", 0), "5-a": ("reviewer_missing", 0), "6-a": ("other_packet", 0), "x": ("unknown_item", 0),
    }
    states = {r.id: r.state for r in seals.apply_decisions(packets, outcomes, "id").collect()}
    assert states[1] == "accepted" and states[2] == "rejected" and sum(s == "open" for s in states.values()) == 118


def test_a_chain_breaks_with_every_change(spark, packets):
    item = [r for r in packets.collect() if r.packet == 0]
    said = [(f"d{r.id}", k, 0, r.id, "accept", r.item_digest, "r") for k, r in enumerate(item)]
    chain = lambda said: {r.packet: (r.state, r.chain, r.settled) for r in seals.packet_states(packets, seals.evaluate(packets, spark.createDataFrame(said, DECISION), "id"), "id").collect()}
    first = chain(said)
    assert first[0][0] == "closed" and first[0][2] == len(item) and all(v[0] == "prepared" for k, v in first.items() if k)
    assert chain(said[::-1] + said[:3]) == first
    other = [*said[:2], (*said[2][:4], "reject", *said[2][5:]), *said[3:]]
    assert chain(other)[0][1] != first[0][1] and chain(said[1:])[0][:1] == ("in_review",)
