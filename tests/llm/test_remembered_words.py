"""Words that a task has met are not encoded anew, and what it remembers is bounded."""

from anisoframe.llm import bpe, queries


def test_words_are_encoded_once(monkeypatch):
    own = bpe.ByteBPE(queries.tokenizer_path("byte_bpe_50k.json"))
    made, encode = [], own.encode_pieces
    monkeypatch.setattr(own, "encode_pieces", lambda pieces: made.append(len(pieces)) or encode(pieces))
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(k, k + 10_000)) for k in range(0, 80_000, 10_000)]
    first = [list(own.encode([t]))[0].tolist() for t in texts]
    n = sum(made)
    assert [list(own.encode([t]))[0].tolist() for t in texts] == first and sum(made) == n
    monkeypatch.setattr(bpe, "REMEMBERED_CHARS", 1000)
    assert list(own.encode([texts[0]]))[0].tolist() == first[0] and len(own.chunks) <= 10_001
