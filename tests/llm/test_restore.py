"""Lattices of disguised words against all their readings, and words in long spaced runs."""

import itertools
import random

import pytest

from sourcefacts.llm import deobfuscation as D

TEXTS = ["the stupid idiot said that you are a stupid fool and the people there went home to read books about nothing at all"] * 50


@pytest.fixture(scope="module")
def model():
    return D.LetterModel(D.trigram_counts(TEXTS))


def cost(readings, model):
    """Of one path through a lattice: what its readings cost, and each letter after the two before."""
    total, before = sum(c for _, c in readings), (0, 0)
    for letter in "".join(text for text, _ in readings):
        code = 0 if letter == " " else D.code_of(letter)
        if code:
            total += model.rows[before[0]][before[1]][code]
            before = before[1], code
        else:
            total += model.rows[before[0]][before[1]][0] if before[1] else 0.0
            before = 0, 0
    return total + (model.rows[before[0]][before[1]][0] if before[1] else 0.0)


def all_paths(places, model):
    return min((round(cost(path, model), 9), "".join(t for t, _ in path)) for path in itertools.product(*places))


@pytest.mark.parametrize("spaced", [False, True])
def test_viterbi_is_the_cheapest_of_all_paths(model, spaced):
    rng = random.Random(3)
    for _ in range(150):
        token = "".join(rng.choice("stupid1073$@!-* " if spaced else "stupid1073$@!-*") for _ in range(rng.randrange(1, 7)))
        places = D.lattice(token, spaced)
        if not spaced:
            assert places == D.lattice(token)
        best = all_paths(places, model)
        got = D.decode(places, model)
        paths = [path for path in itertools.product(*places) if "".join(t for t, _ in path) == got]
        assert paths and min(cost(p, model) for p in paths) == pytest.approx(best[0], abs=1e-6), token


def test_disguises_are_read(model):
    restorer = D.Restorer(model)
    for token in ("5tup1d", "st*upid", "stuupid", "1d10t", "s-t-u-p-i-d"):
        assert {"stupid", "idiot"} & set(restorer.words(token) + restorer.spaced_words(token)), token


@pytest.mark.parametrize("before", [0, 60, 70, 77, 78, 79, 80, 81, 150, 157, 158, 159, 160, 237, 400])
def test_a_spaced_word_is_found_wherever_it_stands(model, before):
    run = " ".join(["a b o u t"[2 * (i % 5)] for i in range(before)] + list("stupid"))
    found = D.Restorer(model).spaced_words(run)
    assert any("stupid" in w for w in found), found
