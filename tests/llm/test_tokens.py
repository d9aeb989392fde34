"""Packing's ids against the whole tokenizer, on texts that try its shortcuts, and components joined in one task or by rounds."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from copyloom.llm import common, packing

LETTERS = "abcXYZ0129 \n\t.,;:!?$%&*#|'-_<>@()éÉİıΣςß字漢かД١̇́ 　‍🙂\x1c\x0b\rक़Å"
PIECES = ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'ll", "don't", "İ,", "Σ.", "≠", "é", "J̌", "word,,", "a b c ", "ẋ,"]


@pytest.mark.parametrize("seed", range(6))
def test_ids_are_the_tokenizers(seed):
    rng, ids = random.Random(seed), packing._Ids(packing.default_tokenizer())
    texts = ["".join(rng.choice(PIECES) if rng.random() < 0.2 else rng.choice(LETTERS) for _ in range(rng.randrange(30))) for _ in range(3000)] + ["", " ", "\n\n"]
    got, n = ids.texts(pa.array(texts), 1)
    want = [[*e.ids, 1] for e in ids.model.encode_batch(texts, add_special_tokens=False)]
    assert ids.apart and n.tolist() == list(map(len, want)) and got.tolist() == [x for w in want for x in w]


def test_memory_that_is_emptied_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    ids = packing._Ids(packing.default_tokenizer())
    for texts in (["one two three, four! five six"], ["seven, eight nine ten, one"], ["one two İ, x."]):
        got, _ = ids.texts(pa.array(texts), 1)
        assert got.tolist() == [*ids.model.encode(texts[0], add_special_tokens=False).ids, 1]


def test_another_tokenizer_gets_whole_texts(tmp_path):
    made = Tokenizer(models.WordLevel({"a b": 0, "a": 1, "b": 2, "?": 3}, "?"))
    made.pre_tokenizer = pre_tokenizers.Split("|", "removed")  # spaces are part of a piece
    made.save(str(tmp_path / "t.json"))
    ids = packing._Ids(str(tmp_path / "t.json"))
    got, n = ids.texts(pa.array(["a b|a", "b", "a b|a", ""]), 9)
    assert not ids.apart and got.tolist() == [0, 1, 9, 2, 9, 0, 1, 9, 9] and n.tolist() == [3, 2, 3, 1]


def test_packing_rows_that_repeat_and_lack_ids(spark):
    rows = [(1, "İ, x", 5), (1, "İ, x", 5), (None, "a " * 3000, 6), (2, None, 7), (3, "", 8)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, offset long")).collect()
    tok = packing._Ids(packing.default_tokenizer()).model
    assert sorted(r.doc_tokens for r in got if r.start == 0) == sorted(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    assert sum(r.length for r in got) == sum({(r.doc_id, k): r.doc_tokens for k, r in enumerate(got) if r.start == 0}.values())


@pytest.mark.parametrize("most", [0, 7, 10**6])
def test_components_by_rounds_and_in_one_task(spark, monkeypatch, most):
    monkeypatch.setattr(common, "ONE_TASK", most)
    rng = np.random.default_rng(most)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5), (7, 9), (9, 7)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    met = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in met}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_step_gives_its_memory_back():
    """What a task's allocators held, batches long gone, is not left to later stages of the same worker."""
    held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20

    def step(batches):
        for batch in batches:
            many = [pa.array(np.arange(1 << 14) + k) for k in range(1500)]  # some 190 MB
            del many
            yield batch

    batch = pa.record_batch({"x": [1]})
    before = held()
    assert list(common.giving_back(step)(iter([batch, batch]))) == [batch, batch]
    assert held() < before + 60
