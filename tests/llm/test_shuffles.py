"""What operators shuffle: texts that a step doesn't change stay where they are."""

from __future__ import annotations

import random

from quillon.llm import common, simhash, suffix_dedup


def shuffled(spark):
    """Bytes of shuffles written by the session so far."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    store = context._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, context._gateway.new_array(context._gateway.jvm.double, 0), getattr(store, "stageList$default$5")())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_cut_stage_leaves_texts_without_repeats_in_place(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(f"{rng.getrandbits(48):012x}" for _ in range(300)) for _ in range(400)]
    shared = " ".join(f"s{k}" for k in range(60))
    texts[7], texts[390] = f"{shared} {texts[7]}", f"{texts[390]} {shared}"
    # Three texts agree in the words around a suffix, but not in all that its windows cover.
    texts[11], texts[12] = f"{texts[11]} {texts[10][:1000]}", f"{texts[12]} {texts[10][200:1200]}"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents"))
    docs = spark.read.parquet(str(tmp_path / "documents"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        with common.scratch(spark):
            got = {r.doc_id: r.text for r in suffix_dedup.cut_stage(spark, docs, str(tmp_path)).collect()}
        moved = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(got) == 400 and {k for k, text in enumerate(texts) if got[k] != text} == {11, 12, 390}
    assert moved < 0.5 * sum(map(len, texts))


def test_keep_first_leaves_texts_without_near_copies_in_place(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(f"{rng.getrandbits(48):012x}" for _ in range(1500)) for _ in range(200)]
    texts += [f"{texts[3]} tail", texts[8].upper(), texts[8], " ".join(texts[20].split()[:1400]), " ".join(texts[21].split()[:900]), "", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents"))
    docs = spark.read.parquet(str(tmp_path / "documents"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        with common.scratch(spark):
            got = {r.doc_id: r.text for r in simhash.keep_first(spark, docs, str(tmp_path)).collect()}
        moved = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {k: texts[k] for k in [*range(200), 204, 205]}
    assert moved < 0.5 * sum(len(t or "") for t in texts)


def test_band_marks_tell_bands_and_keys_apart(spark):
    keys = [0, -1, 1, (1 << 47) + 5, -(1 << 62), 1 << 62]
    rows = spark.createDataFrame([([key] * 25,) for key in keys] + [([],), (None,)], "bands array<long>")
    found = [r[0] for r in rows.select(simhash.band_marks("bands")).collect()]
    assert found[len(keys) :] == [[], None]
    assert [mark >> simhash.KEY_BITS for mark in found[1]] == list(range(25))
    assert all(mark % (1 << simhash.KEY_BITS) == key % (1 << simhash.KEY_BITS) for key, own in zip(keys, found, strict=False) for mark in own)


def test_flagged_marks_exactly_the_chosen_numbers(spark):
    numbers = [0, 1, 63, 64, 127, 128, 1 << 33, (1 << 33) + 62, (5 << 33) + 63, (1 << 62) + 7]
    rows = spark.createDataFrame([(n, str(n)) for n in numbers], "row long, text string")
    for chosen in ([], [0], [63, 63, 128, (5 << 33) + 63], numbers):
        found = suffix_dedup.flagged(rows, spark.createDataFrame([(n,) for n in chosen], "row long")).collect()
        assert len(found) == len(numbers) and {r.row for r in found if r.hit} == set(chosen) and all(r.text == str(r.row) for r in found)
