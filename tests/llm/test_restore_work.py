"""Restoration does no work twice, and its short cuts read what the long way reads."""

import random
import unicodedata

from sourcefacts.llm import deobfuscation as D, toxicity as T

TEXTS = ["the stupid idiot said that you are a stupid fool and the people there went home to read books"] * 20


def test_a_piece_is_decoded_once(monkeypatch):
    calls = []
    plain = D.decode
    monkeypatch.setattr(D, "decode", lambda places, model: calls.append(1) or plain(places, model))
    restorer = D.Restorer(D.LetterModel(D.trigram_counts(TEXTS)))
    said = [restorer.words(token)[-1] for token in ("stuupid", "stuupid,", "stuupid.", '"stuupid"')]
    assert len(set(said)) == 1 and len(calls) == 1
    full, D.KNOWN_PIECES = D.KNOWN_PIECES, 1
    try:
        assert restorer.words("foool") == restorer.words("foool") and len(restorer._known) == 1
    finally:
        D.KNOWN_PIECES = full


def test_short_cuts_agree_with_the_long_way():
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice("ab1$ .-_*,\n\tcé…ﬁＡ") for _ in range(rng.randrange(0, 14)))
        assert bool(D._SPACED.search(text)) <= bool(D._MAYBE_SPACED.search(f" {text}")), repr(text)
        assert D.prepared(text) == (unicodedata.normalize("NFKC", text) if text and max(text) > "ɏ" else text).lower()


def test_beginnings_miss_no_feature():
    rng = random.Random(6)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(300)]
    listed = {f for w in words[:9] for f in T.features(w)}
    begins = T.beginnings(listed)
    for w in words:
        assert w[:3] in begins or not listed & set(T.features(w))
