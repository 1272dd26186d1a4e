import random
from pathlib import Path

import numpy as np
import pytest

from quillfind.llm import lm


@pytest.mark.parametrize("size", [1, 31, 32, 33, 5000])
@pytest.mark.parametrize("span, heads", [(10, 2000), (3_000_000, 900), (2**31, 2**12), (2**32 - 1, 2**32)])
def test_stored_keys_are_found_and_no_others(tmp_path, size, span, heads):
    rng = np.random.default_rng(size)
    drawn = np.unique((rng.integers(0, heads, 3 * size, dtype=lm.U) << lm.U(32)) | rng.integers(0, span, 3 * size, dtype=lm.U))
    kept = np.sort(rng.permutation(drawn)[:size])
    lm.write_keys(f"file://{tmp_path}/keys", kept, span)
    keys = lm.Keys(f"file://{tmp_path}/keys", span)
    assert len(keys) == len(kept) and (keys.all() == kept).all()
    ends = np.array([0, (heads - 1) << 32 | (span - 1)], dtype=lm.U)
    asked = np.unique(np.concatenate([drawn, ends, kept[kept & lm.LOW32 > 0] - lm.U(1)]))
    at, known = keys.find(asked)
    assert (known == np.isin(asked, kept)).all()
    assert (at < len(kept)).all() and (kept[at[known]] == asked[known]).all()


def test_pairs_and_triples_take_less_than_six_bytes_a_key(spark):
    draw = random.Random(5)
    texts = [(i, " ".join(f"w{draw.randrange(3000)}" for _ in range(400))) for i in range(200)]
    model = lm.train(spark.createDataFrame(texts, "doc_id long, text string"))
    stored = lambda kind, sizes: sum(Path(f"{model['uri'].removeprefix('file:').replace('//', '/')}/{kind}-{b}").stat().st_size for b, n in enumerate(sizes) if n)
    (kind, (_, sizes, _)), = model["triples"].items()
    assert model["pairs"] > 20_000 and sum(sizes) > 50_000
    assert stored("pair", model["pair_sizes"]) < 6 * model["pairs"]
    assert stored(kind, sizes) < 6 * sum(sizes)


def test_counts_of_many_ranges_look_at_each_rank_once():
    ranges = lm.Ranges("file:///none", "pair", np.zeros(0, lm.U), [3, 0, 5, 1, 40], 10)
    ranks, use = np.array([48, 2, 3, 8, 7, 0, 20, 2]), np.array([True] * 7 + [False])
    got = [(b, mine.tolist(), at.tolist()) for b, mine, at in ranges._by_range(ranks, use)]
    assert got == [(0, [1, 5], [2, 0]), (2, [2, 4], [0, 4]), (3, [3], [0]), (4, [0, 6], [39, 11])]
    assert not list(ranges._by_range(ranks, np.zeros(8, bool))) and not list(lm.grouped(np.zeros(0, int)))
