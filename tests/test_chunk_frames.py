"""Chunks leave a task in frames of bounded size, whatever a batch of texts holds."""

import pandas as pd

from verbascope.sources import lines


def test_frames_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(lines, "CHUNK_CHARS", 100)
    texts = ["one. two. " * k for k in range(12)] + [None, ""]
    got = list(lines._chunk_frames([pd.DataFrame({"k": range(14), "t": texts})], ["k"], "t", 30, 0, 10))
    assert len(got) > 3 and all(f.text.str.len().sum() <= 100 + len(texts[11]) for f in got)
    rows = pd.concat(got)
    assert [("".join(rows[rows.k == k].sort_values("chunk_no").text)) for k in range(14)] == [t or "" for t in texts]
