"""Equal digests alone must not remove bytes."""

import numpy as np
import pyarrow as pa

from oddsframe.llm import suffixes


def test_a_digest_collision_removes_nothing(monkeypatch):
    plain = suffixes.runs
    rng = np.random.default_rng(2)
    same = "".join(chr(97 + int(c)) for c in rng.integers(0, 26, 200))
    other = "".join(chr(65 + int(c)) for c in rng.integers(0, 26, 200))
    part = lambda texts, codes: pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array([False] * len(texts)), pa.array(texts), pa.array([codes] * len(texts), pa.list_(pa.int64())), pa.array([[]] * len(texts), pa.list_(pa.int64()))],
        names=["k1", "k2", "late", "text", "codes", "hot"],
    )

    def colliding(*args):
        found = plain(*args)
        n = len(found["anchor"])
        return found | {"anchor": np.zeros(n, np.uint64), "under": np.zeros(n, np.uint64)}

    monkeypatch.setattr(suffixes, "runs", colliding)
    settled, _ = suffixes._stretches(part([same, other], [0]))
    assert not len(settled[0])
    settled, _ = suffixes._stretches(part([same, same], [0]))
    assert settled[0].tolist() == [1] and settled[2].tolist() == [0] and settled[3].tolist() == [200]
