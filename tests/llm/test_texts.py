import random
import shutil
import tracemalloc

import pytest

from chronoweave.llm import packing, tokenise, vocab

TEXTS = [None, "", " ", "\n\n\t x", "it's we'll they'd", "日本語 テキスト 🚀🚀", "a\r\nb﻿c\x00d", "<|endoftext|>", "word " * 4000, "x" * 30_000, "  lead  trail  ", "١٢٣ ½ ⅷ", "é é"]


def test_encoding_equals_the_encoder(spark):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("ab 'sé\n\t1٣.,🚀 \x1c") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "no id", "x", 1), (0, None, "x", 1)], "doc_id long, text string, word string, block long").repartition(3)
    enc = vocab.encoder(vocab.vocabulary())
    for chars in (50, 10_000_000):
        got = tokenise.encode_corpus(df, block_chars=chars)
        rows = got.collect()
        assert len(rows) == len(texts) + 2
        by = {r.doc_id: list(r.ids) for r in rows}
        assert all(by[i] == enc.encode_ordinary(t or "") for i, t in enumerate(texts)) and by[None] == enc.encode_ordinary("no id")
    back = {r.doc_id: r.text for r in tokenise.decode_corpus(got).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    assert tokenise.token_bytes(df).count() == 50256


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokenise.encode_corpus(df).count() == 0 and packing.token_sizes(df).count() == 0
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted((r.doc_id, list(r.ids)) for r in tokenise.encode_corpus(only).collect()) == [(1, []), (2, [])]
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert tokenise.decode_corpus(nothing).first().text is None


def check(rows, sizes, capacity):
    held, parts = {}, {}
    for r in rows:
        held.setdefault(r.container_id, []).append(r)
        parts.setdefault(r.doc_id, []).append(r)
    for rs in held.values():
        rs.sort(key=lambda r: (r.offset, r.n_tokens))
        assert sum(r.n_tokens for r in rs) <= capacity
        at = 0
        for r in rs:
            if r.n_tokens:
                assert r.offset == at
                at += r.n_tokens
    for d, n in sizes.items():
        ps = sorted(parts[d], key=lambda r: r.piece)
        assert sum(p.n_tokens for p in ps) == n and [p.piece for p in ps] == list(range(len(ps)))
        assert len(ps) == max(1, -(-n // capacity))
        at = 0
        for p in ps:
            assert p.start_token == at
            at += p.n_tokens
    return len(held)


def test_containers(spark):
    rng = random.Random(5)
    sizes = {i: rng.choice([0, 1, rng.randint(1, 60), rng.randint(1, 400)]) for i in range(3000)}
    df = spark.createDataFrame([(i, n, 7, 8) for i, n in sizes.items()], "doc_id long, n_tokens long, shard int, capacity int")
    specs = spark.createDataFrame([(1, "a", 100), (2, "b", 350)], "spec_id int, spec_name string, capacity int")
    rows = packing.fill_containers(df, specs, shard_items=1000).collect()
    for spec, capacity in ((1, 100), (2, 350)):
        n = check([r for r in rows if r.spec_id == spec], sizes, capacity)
        assert n <= 1.02 * sum(sizes.values()) / capacity + 3
    rep = packing.fill_report(packing.fill_containers(df, specs), specs).collect()
    assert all(r.fill > 0.98 and r.n_tokens == sum(sizes.values()) for r in rep)


def test_containers_of_odd_input(spark):
    specs = spark.createDataFrame([(1, 10)], "spec_id int, capacity int")
    df = spark.createDataFrame([(1, None), (None, 4), (None, 4), (2, 10), (3, 25)], "doc_id long, n_tokens long")
    rows = packing.fill_containers(df, specs).collect()
    assert len(rows) == 7 and sum(r.n_tokens for r in rows) == 43
    assert packing.fill_containers(df.limit(0), specs).count() == 0 and packing.fill_containers(df, specs.limit(0)).count() == 0
    zeros = packing.fill_containers(spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, n_tokens long"), specs).collect()
    assert [(r.container_id, r.n_tokens) for r in zeros] == [(0, 0), (0, 0)]
    with pytest.raises(ValueError):
        packing.fill_containers(df, spark.createDataFrame([(1, 0)], "spec_id int, capacity int"))


def test_two_replace_the_smallest():
    # 6 + 3 leaves 1; 2 + 2 fill the gap of 4 left when 3 makes way.
    assert sorted(map(sorted, packing.best_two_fit([6, 3, 2, 2], 10))) == [[0, 2, 3], [1]]
    assert packing.best_two_fit([], 5) == [] and packing.best_two_fit([5, 5], 5) == [[0], [1]]


def test_blocks_are_written_once(spark, tmp_path):
    """Ids and positions come from the same stored blocks: a task that runs again can't find others, even if the rows come otherwise then."""
    spark.createDataFrame([(i, f"word{i} and word{i % 3}") for i in range(50)], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    coded = tokenise.encode_corpus(spark.read.parquet(str(tmp_path / "docs")), block_chars=100)
    shutil.rmtree(tmp_path / "docs")
    enc = vocab.encoder(vocab.vocabulary())
    assert {r.doc_id: list(r.ids) for r in coded.collect()} == {i: enc.encode_ordinary(f"word{i} and word{i % 3}") for i in range(50)}


def test_large_capacities_need_little_memory():
    rng = random.Random(1)
    sizes = [rng.randint(1, 20_000) for _ in range(3000)] + [999_999, 1_000_000]
    tracemalloc.start()
    packed = packing.best_two_fit(sizes, 1_000_000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20 << 20 and sorted(k for held in packed for k in held) == list(range(len(sizes)))
    assert all(sum(sizes[k] for k in held) <= 1_000_000 for held in packed) and len(packed) <= sum(sizes) // 1_000_000 + 2


def test_shards_follow_items_and_capacity():
    assert packing.shard_count(100_000, 50_000_000, 512) == 5  # 20,000 items each
    assert packing.shard_count(1_000_000, 500_000_000, 1_000_000) == 3  # 400,000 items fill 200 containers
    assert packing.shard_count(10_000_000, 10_000_000, 1_000_000) == 10 and packing.shard_count(0, 0, 10) == 1
