"""A worker's table of segments keeps what a text of many different words brings in."""

import itertools

import numpy as np
import public_tokenizers


def test_many_segments_stay_known():
    from cutline.llm.encoding import SegmentEncoder

    encoder = SegmentEncoder.open(public_tokenizers.path("byte_bpe_50k.json"))
    words = ["".join(w) for w in itertools.islice(itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=4), 420_000)]
    counts, ids = encoder.encode([" ".join(words)])
    encoder.encode([" ".join(words[:210_000])])  # the others came once
    encoder._ask = lambda parts: (_ for _ in ()).throw(AssertionError(f"{len(parts)} segments were forgotten"))
    again, same = encoder.encode(["aaaa " + " ".join(words[-1000:]), None])
    assert again[1] == 0 and np.array_equal(same[1:], ids[len(ids) - again[0] + 1:])
