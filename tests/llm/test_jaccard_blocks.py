import random

from asfiled.llm import jaccard_join

SIGNED = "doc_id long, text_hash long, set_id long, n long, size_class int, keys array<long>, bits binary"


def test_blocks_move_their_keys_once_and_hold_every_set(spark):
    rng = random.Random(3)
    own = {s: rng.sample(range(40), 6) + [1000 + s] for s in range(-20, 20)}  # keys of each set
    own[7], own[8] = [77, 78], [77]  # a block of two, and a key of one set in many rows
    sets = [*own, *rng.choices([*own], k=30), 7, 7]
    rows = [(i, i, s, 5, 1, own[s], b"") for i, s in enumerate(sets)] + [(None, None, 99, 0, 0, [], b"")]
    blocks = jaccard_join._blocks(spark.createDataFrame(rows, SIGNED).repartition(5))
    planned = blocks._jdf.queryExecution().executedPlan().toString()  # before it is run
    assert "Join" not in planned and planned.count("Exchange hashpartitioning") == 1
    told = {}
    for s in sets:
        for k in own[s]:
            told.setdefault(k, []).append(s)
    assert sorted(map(tuple, blocks.collect())) == sorted(
        (k, s, min(held), len(held)) for k, held in told.items() if len(set(held)) > 1
        for s in set(held))


def test_a_task_tells_keys_and_bitmap_of_a_set_once(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame(
        [(1, text), (2, text.upper()), (3, text + " more"), (4, None), (5, text)],
        "doc_id long, text string").coalesce(1)
    levels = spark.sparkContext.broadcast(jaccard_join.frequency_levels(docs, 5, "text"))
    signed = jaccard_join._signatures(docs, levels, 5, 80, "doc_id", "text").collect()
    assert [(r.doc_id, r.n, len(r.keys) > 0) for r in signed] == [
        (1, 36, True), (2, 36, False), (3, 37, True), (4, 0, False), (5, 36, False)]
    assert [r.bits is not None for r in signed] == [True, False, True, False, False]
    assert len({r.set_id for r in signed}) == 3


def test_bitmaps_of_several_tasks_give_one_row(spark):
    bitmaps = spark.createDataFrame([(s, bytes([s])) for s in (1, 2, 2, 3, 2, 4)],
                                    "set_id long, bits binary").repartition(3)
    named = spark.createDataFrame([(2,), (3,), (2,)], "set_id long")
    got = jaccard_join._bits_of(named, bitmaps).collect()
    assert sorted((r.set_id, bytes(r.bits)) for r in got) == [(2, b"\x02"), (3, b"\x03")]
