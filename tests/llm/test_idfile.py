import random
import zlib
from pathlib import Path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from semlake.llm import idfile
from tests.llm import helpers


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=700))
def test_elias_fano_round_trip(values):
    values.sort()
    made = idfile.EliasFano.of(values)
    raw = made.to_bytes()
    back, used = idfile.EliasFano.from_bytes(raw + b"rest")
    assert used == len(raw) and back.values().tolist() == values
    for i in range(0, len(values), 37):
        assert back.select(i) == values[i]


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(0, 2000, 10_000))
    assert len(idfile.EliasFano.of(values).to_bytes()) * 8 < 10_000 * (2 + np.log2(values[-1] / 10_000) + 0.5) + 1000


def reference(texts):
    t = Tokenizer.from_file(idfile.default_tokenizer())
    return [t.encode(x or "", add_special_tokens=False).ids + [idfile.END_ID] for x in texts]


def test_chunks_equal_whole_texts():
    rnd, coder = random.Random(2), idfile.ChunkEncoder(idfile.default_tokenizer())
    parts = [*"aA.,.,Σσ'sʼ́ \n\t\x0b\xa0　éñ日x019/İ\x1c\x85﻿​", "<|endoftext|>", "<|startoftext|>", "'s", "Thing, ", "Über. "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 20))) for _ in range(4000)]
    got = [x for i in range(0, len(texts), 100) for x in coder.encode(texts[i : i + 100])]
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == reference(texts)


def test_query_and_export(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(idfile, "SHARD_IDS", 64)
    df = helpers.edge(spark).unionByName(helpers.table(spark, ["minus one"], [-1]))
    d = helpers.write(spark, tmp_path / "in", df)
    rows = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, want = 0, []
    for (i, _), ids in zip(rows, reference([t for _, t in rows]), strict=True):
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = idfile.op3_token_ids(spark, d).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    shards = idfile.write_shards(df, f"file://{tmp_path}/shards")
    names = idfile.export(shards, f"file://{tmp_path}/files").collect()
    shard = idfile.Shard((Path(tmp_path) / "files" / names[0].name).read_bytes())
    assert shard.doc(0)[-1] == idfile.END_ID and len(shard.doc_ids()) == shard.n
    assert idfile.op3_token_ids(spark, helpers.write(spark, tmp_path / "none", helpers.empty(spark))).collect() == []
