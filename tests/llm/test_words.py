"""The word encoder against the tokenizers library on whole texts."""

import random

import numpy as np
import pytest

from anisoframe.llm import token_planes
from anisoframe.llm.queries import tokenizer_path

HARD = [
    "", "  ", "Don't STOP's 'S 'Re", "étude ETÉ À la", "a<|endoftext|>b <|startoftext|> x<| y", "x y İstanbul ǅ J̌", "\x1c\x1dab\x85c \x00 \x0b z",
    "µm ª º1² 3×4÷5", "ﬁ ſ's don’t 日本語 한국 123 ١", "'''s ''ll !!'s ßÿØ", "﻿​ <||>", "Ä'Ś", "a" * 5000,
]


@pytest.mark.parametrize("remembered", [5, token_planes.REMEMBERED])
def test_word_encoder_equals_the_library(monkeypatch, remembered):
    monkeypatch.setattr(token_planes, "REMEMBERED", remembered)
    pick = random.Random(1)
    texts = HARD + ["".join(pick.choices("aA'sSlLtTé É́<|>endoftx \n \x85ẞ1½!.,’日", k=pick.randint(1, 60))) for _ in range(2000)]
    encoder = token_planes.WordEncoder(tokenizer_path("word_bpe_49k.json"))
    want = [np.array(e.ids, "<u4").tobytes() for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert [x for i in range(0, len(texts), 100) for x in encoder.encode(texts[i : i + 100])] == want
