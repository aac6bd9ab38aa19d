"""The transducer's inverse reads one table of bytes."""

import public_tokenizers

from parcelspark.llm import wfst


def test_one_entry_for_each_id():
    machine = wfst.transducer(wfst.model_bytes(public_tokenizers.path("piece_bpe_32k.model")))
    for i, (piece, _, kind) in enumerate(machine.model.pieces):
        assert machine.raw[i] == (bytes([int(piece[3:5], 16)]) if kind == wfst.BYTE else b"" if kind == wfst.CONTROL else piece.encode())
    for text in ("Two words, é and 漢字.", "\t\x00 end", "a"):
        assert machine.decode(machine.encode(text)) == text
