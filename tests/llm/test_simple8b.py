import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from envsense.llm import simple8b


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 3) | st.integers(0, 50_000), max_size=400), st.integers(1, 60))
def test_round_trip_in_whole_and_by_block(values, block):
    values = np.array(values, np.uint64)
    lengths = [min(block, len(values) - k) for k in range(0, len(values), block)]
    coded = simple8b.encode(values, lengths)
    assert (simple8b.decode(coded) == values).all()
    for k, n in enumerate(lengths):
        words = coded.words[coded.offsets[k] : coded.offsets[k + 1]]
        one = simple8b.Coded(words, coded.escapes, np.array([0, len(words)]), np.array([n]))
        assert (simple8b.decode(one) == values[k * block : k * block + n]).all()


def test_sizes():
    assert len(simple8b.encode(np.zeros(240, np.uint64)).words) == 2
    assert len(simple8b.encode(np.full(60, 1, np.uint64)).words) == 1
    assert len(simple8b.encode(np.full(8, 32_767, np.uint64)).words) == 2
    big = simple8b.encode(np.array([2**60, 2**64 - 1], np.uint64))
    assert len(big.escapes) == 2 and len(big.words) == 2


def test_empty_blocks():
    coded = simple8b.encode(np.array([7, 8], np.uint64), [0, 1, 0, 1, 0])
    assert simple8b.decode(coded).tolist() == [7, 8]
    assert simple8b.decode(simple8b.encode([])).tolist() == []
