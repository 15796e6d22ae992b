"""The encoder's ids are the tokenizer's own, however pieces are kept or joined."""

from __future__ import annotations

import pytest

from tomeflow.llm import tokens

ODD = ["", " ", "a", "a b", " a", "a ", "a\nb c", "été über 你好 x", "don't I'm 12 345,6 7.", "\x00 b", "a\tb c \U0001f600 d", "<|x|> a", "a\n\nb", "é f"]
TEXTS = [*ODD, " ".join(f"wörd{i} x{i * 7919}" for i in range(3000)), "same " * 50 + "end"]


@pytest.mark.parametrize(("kept", "joined"), [(400_000, 512), (100, 512), (400_000, 1), (100, 7)])
def test_equal_to_tokenizer(monkeypatch, kept, joined):
    monkeypatch.setattr(tokens, "CACHE_PIECES", kept)
    monkeypatch.setattr(tokens, "JOINED", joined)
    enc = tokens.Encoder(tokens.default_tokenizer())
    own = enc._ids(TEXTS)
    assert enc.encode(TEXTS) == own
    assert [enc.encode([t])[0] for t in TEXTS] == own


def test_tokens_not_of_their_bytes(monkeypatch):
    enc = tokens.Encoder(tokens.default_tokenizer())
    enc.sizes[:] = 1  # as a vocabulary that isn't byte-level has it
    assert enc.encode(TEXTS) == enc._ids(TEXTS)
