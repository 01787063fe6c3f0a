"""Packing's token ids: those of the whole tokenizer, while plain texts ask its model for each distinct part once."""

import json
import random

import numpy as np
import pytest

from tierscope.llm import packing
from tierscope.llm.shared import vocabulary_path

LETTERS = "aabcdeStTrREvVmMlLdD''''é ÉßÀÿÖ×÷µªº²0123.,!?;_-\"<|>~ \n\t\x0b\x1c\x7f\x85\xa0́’İſǅΣ٣"


@pytest.fixture(scope="module")
def path():
    return vocabulary_path("word_bpe_49k.json")


def whole(path):
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(path)
    tokens.no_truncation()
    tokens.no_padding()
    return lambda t: np.array(tokens.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_plain_texts_encode_each_part_once(path):
    class Refuses:
        def encode(self, *_, **__):
            raise AssertionError("a word of a plain text went through the whole tokenizer")

    class Counts:
        def __init__(self, model):
            self.model, self.asked = model, []

        def tokenize(self, part):
            self.asked.append(part)
            return self.model.tokenize(part)

    words = packing.WordIds(path)
    words.tokens, words.parts.model = Refuses(), Counts(words.tokens.model)
    texts = [" ".join(f"{w}{mark}" for w in ("tree", "Tree", "café", "CAFÉ", "l'été")) for mark in (",", ".", "!?", "'s", "7")]
    want = whole(path)
    assert all(words.of(t) == want(t) for t in texts * 2)
    asked = words.parts.model.asked
    assert len(asked) == len(set(asked)) == len({"tree", "café", "l", "'", "été", ",", ".", "!?", "'s", "7"})


def test_ids_are_those_of_the_whole_tokenizer(path):
    rng, words, want = random.Random(5), packing.WordIds(path), whole(path)
    texts = ["", " ", "<|endoftext|>", "a<|startoftext|>b", "é É", "İx", "x" * 300, "don't'll'S"]
    for size in (12, 60):
        texts += ["".join(rng.choice(LETTERS[: rng.choice((22, 50, len(LETTERS)))]) for _ in range(rng.randint(1, size))) for _ in range(1500)]
    assert [t for t in texts if words.of(t) != want(t)] == []


def test_another_vocabulary_is_not_cut(path, tmp_path):
    """One that keeps capitals has its own ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"]["normalizers"].pop()
    own = tmp_path / "own.json"
    own.write_text(json.dumps(spec))
    words, want = packing.WordIds(str(own)), whole(str(own))
    assert not words.cut and words.of("Tree tree, TREE") == want("Tree tree, TREE") != whole(path)("Tree tree, TREE")
