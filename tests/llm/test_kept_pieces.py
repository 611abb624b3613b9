"""What a worker keeps of encoded pieces has a bound, and pieces that it drops are encoded alike again."""

from tokenizers import Tokenizer

from vecloom.llm.tokens import Encoder, default_tokenizer, encoder


def test_few_pieces_are_kept():
    plain, e = Tokenizer.from_file(default_tokenizer()), Encoder(default_tokenizer(), kept=40)
    added = []
    add = e._add
    e._add = lambda new: (added.extend(new), add(new))
    texts = [" ".join(f"word{i * 7 % 90}x{i % 13} again" for i in range(k, k + 12)) for k in range(0, 240, 6)]
    for t in texts:
        assert e.encode(t) == b"".join(x.to_bytes(4, "little") for x in plain.encode(t, add_special_tokens=False).ids)
        assert len(e) + len(e.before) <= 40 + 60  # a text's own pieces, 60 at most, are in at once
    # a piece that every text holds comes back from those before, without the library
    assert added.count(" again") == 1


def test_encoders_by_bound():
    assert encoder(default_tokenizer(), 100) is encoder(default_tokenizer(), 100)
    assert encoder(default_tokenizer(), 100).kept == 100
