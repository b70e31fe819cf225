"""Disguises of any length: stretched words, doubled letters, sentences written letter by letter."""

import time

import numpy as np
import pytest

from folioflow.llm import toxicity


@pytest.fixture(scope="module")
def model():
    text = "you are a stupid idiot and all of this is pathetic the loser will feel good about the clown and the trash was worthless scum " * 50
    raw = np.concatenate(([0, 0], toxicity._SYMBOL[np.frombuffer(text.encode(), np.uint8)], [0]))
    counts = np.bincount((raw[:-2] * 32 + raw[1:-1]) * 32 + raw[2:], minlength=32**3).reshape(32, 32, 32).astype(float)
    return np.log((counts + 0.01) / (counts.sum(2, keepdims=True) + 0.32))


@pytest.mark.parametrize("shown", ["st" + "u" * 60 + "pid", "s" * 30 + "tup" + "i" * 30 + "d", "ssttuuppiidd", "sstupid", "5ttuup1d", "s  t  u  p  i  d", "s. t. u. p. i. d", "s - t - u - p - i - d", "s\nt\nu\np\ni\nd"])
def test_disguises_are_decoded(model, shown):
    assert set(toxicity.features("stupid")) <= toxicity.Reader(model, None).read(f"well, {shown}, really")


@pytest.mark.parametrize("gap", [" ", "  ", "-", " . "])
def test_spaced_sentences_are_decoded(model, gap):
    sentence = "you are a stupid idiot and the loser was worthless and pathetic"
    found = toxicity.Reader(model, None).read(gap.join(sentence.replace(" ", "")))
    assert all(set(toxicity.features(w)) <= found for w in ("stupid", "idiot", "loser", "worthless", "pathetic"))
    wide = toxicity.Reader(model, None).read((gap * 3).join(gap.join(w) for w in sentence.split()))
    assert all(set(toxicity.features(w)) <= wide for w in ("stupid", "idiot", "loser", "worthless", "pathetic"))


def test_doubled_letters_may_be_meant(model):
    for word in ("all", "will", "feel", "good"):
        assert toxicity.restore(word, model) == word
    assert toxicity.restore("g00d", model) == "good"


def test_long_words_take_linear_time(model):
    begin = time.time()
    reader = toxicity.Reader(model, None)
    for text in ("ab1" * 20_000, "u" * 1_000_000, "a b1 c " * 20_000, "_" * 100_000, "a _" * 30_000, "a" + " " * 200_000 + "b"):
        reader.read(text)
    assert time.time() - begin < 20


def test_doubled_words_are_scored_as_by_viterbi(model):
    rng = np.random.default_rng(6)
    logs = toxicity.flat(model)
    for _ in range(3000):
        word = "".join(rng.choice(list("aeiost-é'"), rng.integers(1, 12)))
        if len(toxicity._RUN.findall(word)) <= 4:
            a, b = toxicity.undouble(word, logs), toxicity.restore(word, logs)
            total = lambda w: sum(model[x, y, z] for x, y, z in zip([0, 0, *map(toxicity.symbol, w)], [0, *map(toxicity.symbol, w), 0], [*map(toxicity.symbol, w), 0], strict=False))  # noqa: B023, E731
            assert a == b or abs(total(a) - total(b)) < 0.51, word
