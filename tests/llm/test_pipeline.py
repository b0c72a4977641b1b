import random

import sentencepiece

import corpus_pipeline
from semlake.llm import pieces, toxicity
from tests.llm import brute, helpers
from tests.llm.test_toxicity import corpus


def test_stages_take_effect(spark, tmp_path):
    texts, labels = corpus(1500)
    rnd = random.Random(1)
    long = " ".join(f"v{rnd.randrange(500)}" for _ in range(200))
    extra = [long + "\nfooter line here", long + " end\nfooter line here", "x " + helpers.SENTENCE, *[f"own text number {i} of {i * 7}\nfooter line here" for i in range(12)], None, ""]
    docs = helpers.table(spark, texts + extra)
    d = helpers.write(
        spark, tmp_path, docs, spark.createDataFrame(list(enumerate(labels)), "doc_id bigint, toxic int"),
        spark.createDataFrame([(1, helpers.SENTENCE)], "item_id bigint, text string"),
    )
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "benchmark decontamination", "sentencepiece"]
    held, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, d)
        assert held.columns == docs.columns
        kept.append({r.doc_id: r.text for r in held.collect()})
    bad = {i for i, y in enumerate(labels) if y}
    assert len(bad - set(kept[0])) > 0.9 * len(bad) and len(set(kept[0]) & set(range(len(texts)))) > 0.95 * (len(texts) - len(bad))
    n = len(texts)
    assert kept[1][n] == long and kept[1][n + 3] == "own text number 0 of 0" and kept[1][n + 15] is None
    assert n in kept[2] and n + 1 not in kept[2]
    assert n + 2 in kept[2] and n + 2 not in kept[3]
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    assert set(out) == set(kept[3]) and out[n].decoded == long and out[n].n_tokens == len(out[n].ids) and out[n].ids[-1] == 2
    assert toxicity.PLACES == 1 << 18


def test_toxicity_stage_on_few_labels(spark, tmp_path):
    texts, labels = corpus(400)
    docs = helpers.table(spark, texts)
    d = helpers.write(spark, tmp_path, docs, spark.createDataFrame(list(enumerate(labels)), "doc_id bigint, toxic int"))
    kept = {r.doc_id for r in corpus_pipeline.toxicity_stage(spark, docs, d).collect()}
    bad = {i for i, y in enumerate(labels) if y}
    assert len(bad - kept) > 0.9 * len(bad) and len(kept - bad) > 0.95 * (len(texts) - len(bad))


def test_empty_tables(spark, tmp_path):
    d = helpers.write(spark, tmp_path, helpers.empty(spark), spark.createDataFrame([], "doc_id bigint, toxic int"), spark.createDataFrame([], "item_id bigint, text string"))
    assert corpus_pipeline.run(spark, d).collect() == []


def test_the_whole_equals_plain_python(spark, tmp_path):
    texts, labels = corpus(120)
    rnd = random.Random(9)
    own = lambda n: " ".join(f"v{rnd.randrange(4000)}" for _ in range(n))
    for i in range(14):
        base = own(60).split(" ")
        near = [*base[:55], *own(rnd.choice((1, 3, 9))).split(" ")]  # above and below the threshold
        texts += [" ".join(base) + "\nshared footer", " ".join(near) + "\nShared footer ", " ".join(base)]
    texts += [own(30) + " " + helpers.SENTENCE + " " + own(5), helpers.SENTENCE, helpers.SENTENCE[:30], None, "", " \n\t", "ok", "ok", helpers.LONG]
    docs = helpers.table(spark, texts)
    labels = spark.createDataFrame(list(enumerate(labels)), "doc_id bigint, toxic int")
    items = [helpers.SENTENCE, None, "short item", ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    d = helpers.write(spark, tmp_path, docs, labels, bench)
    model = toxicity.train(spark.read.parquet(f"{d}/documents.parquet"), labels)
    held = [(i, t) for i, t in enumerate(texts) if brute.score(t, model) < 0.5]
    held = [(i, t) for (i, _), t in zip(held, brute.kept_lines([t for _, t in held]), strict=True)]
    held = [held[k] for k in brute.near_kept([t for _, t in held])]
    held = [(i, t) for i, t in held if not brute.contaminated(t, items)]
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = {r.doc_id: (r.n_tokens, r.ids, r.decoded) for r in corpus_pipeline.run(spark, d).collect()}
    assert 20 < len(held) < len(texts) - 20
    for i, t in held:
        ids = [*sp.encode(t or ""), sp.eos_id()]
        assert got.pop(i) == (len(ids), ids, sp.decode(ids))
    assert not got
