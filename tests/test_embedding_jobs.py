import json
from pathlib import Path

import numpy as np
import pytest

from semlake.operators import embedding_jobs as jobs
from semlake.sources.store import Store


class Folder(jobs.BatchService):
    """A service in a folder: every batch runs for some polls; names that end in -0 fail if told so."""

    def __init__(self, path, polls=1, bad=0):
        self.path, self.polls, self.bad = str(path), polls, bad

    def submit(self, name, texts):
        file = Path(self.path) / f"{name}.json"
        with open(Path(self.path) / "submitted", "a") as f:
            f.write(f"{name}\n")
        if not file.exists():
            file.write_text(json.dumps({"texts": texts, "polls": 0, "made": True}))
        return file.name

    def poll(self, ticket):
        file = Path(self.path) / ticket
        held = json.loads(file.read_text())
        held["polls"] += 1
        file.write_text(json.dumps(held))
        if held["polls"] <= self.polls:
            return "running"
        return "failed" if int(ticket[:-5].rsplit("-", 1)[1]) < self.bad else "done"

    def fetch(self, ticket):
        texts = json.loads((Path(self.path) / ticket).read_text())["texts"]
        return np.array([[len(t), 1.0, 0.0] for t in texts], np.float32), sum(map(len, texts))


def submitted(path):
    return (path / "submitted").read_text().split()


@pytest.fixture()
def texts(spark):
    return spark.createDataFrame([(bytearray([i]), "x" * (i + 1)) for i in range(40)] + [(bytearray([99]), None)], "key binary, text string")


def test_resumed_after_timeouts_and_crashes(spark, tmp_path, texts, monkeypatch):
    store, service = Store(spark, f"file://{tmp_path}/s"), Folder(tmp_path, polls=2)
    assert jobs.run(store, texts, service, "vectors-m", "m", confirm=lambda n: n > 1000)["planned"] == 0
    with pytest.raises(jobs.TimedOut):
        jobs.run(store, texts, service, "vectors-m", "m", size=10, most_polls=1, wait=0)
    first = submitted(tmp_path)
    assert len(first) == len(set(first)) >= 3
    out = jobs.run(store, texts, service, "vectors-m", "m", size=10, wait=0)
    assert out["planned"] == 0 and out["done"] == len(first) and out["tokens"] == sum(range(1, 41))
    assert submitted(tmp_path) == first and store.read("vectors-m").count() == 40
    by_key = {r.key[0]: r.q for r in store.read("vectors-m").collect()}
    assert all(abs(q[0] / q[1] - (i + 1)) < 0.01 * (i + 1) for i, q in by_key.items())
    # A crash between the submission and its commit: the same names go out again, and give the same tickets.
    more = spark.createDataFrame([(bytearray([50 + i]), f"new {i}") for i in range(8)], "key binary, text string")
    jobs.plan(store, more, "vectors-m", 4)
    with monkeypatch.context() as m:
        m.setattr(Store, "upsert", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError, match="killed"):
            jobs.submit(store, service)
    files = set(tmp_path.glob("*.json"))
    assert jobs.run(store, more, service, "vectors-m", "m", wait=0)["planned"] == 0
    assert set(tmp_path.glob("*.json")) == files and store.read("vectors-m").count() == 48


def test_failures_are_tried_again_and_bounded(spark, tmp_path, texts):
    store = Store(spark, f"file://{tmp_path}/s")
    out = jobs.run(store, texts, Folder(tmp_path, polls=0, bad=1), "vectors-m", "m", size=20, wait=0)
    assert out["done"] >= 1 and store.read("vectors-m").count() == 40
    other = tmp_path / "other"
    other.mkdir()
    with pytest.raises(jobs.Failed, match="failed 2 times"):
        jobs.run(Store(spark, f"file://{other}/s"), texts, Folder(other, polls=0, bad=9), "vectors-m", "m", size=20, wait=0, most_tries=2)
