"""Micro-batches of a stream are bounded by samples, and are decoded in pieces."""

from pathlib import Path

from voltair import streaming
from voltair.plans import decoding


def test_more_samples_make_more_micro_batches(spark, sf, monkeypatch, tmp_path):
    monkeypatch.setattr(decoding, "folder", lambda s, name: f"file://{tmp_path}/{name}")
    monkeypatch.setattr(decoding, "BATCH", 200)
    monkeypatch.setattr(streaming, "PIECE", 7)
    found = decoding.online_states(spark, sf)
    assert len([p for p in Path(tmp_path, "online-out-state/commits").iterdir() if p.name.isdigit()]) >= 5  # of 1,000 samples
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, decoding.one_ring_states(spark, sf).select(*found.columns).collect()))
