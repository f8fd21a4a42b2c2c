"""Batches of ids decoded at once."""

import numpy as np
import pytest

from wardline.llm.bpe import Codec


def test_batches_of_ids():
    c = Codec({bytes([i]): i for i in range(256)} | {b"ab": 300}, r"\w+|\W+")
    texts = ["abc ab", "", "é ab", ""]
    ids = [c.encode(t) for t in texts]
    ends = np.cumsum([0, *map(len, ids)])
    assert c.decoded(np.concatenate(ids), ends).to_pylist() == [t.encode() for t in texts]
    assert c.decoded(np.zeros(0, np.int32), np.array([0, 0])).to_pylist() == [b""]
    with pytest.raises(KeyError):
        c.decoded(np.array([280], np.int32), np.array([0, 1]))
