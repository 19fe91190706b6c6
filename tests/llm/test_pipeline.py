import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from hindsight.llm import mixing

from .test_near_dedup import brute_force

INSULTS = ["zzfoul", "zzvile", "zzmean"]


def tables(spark, folder):
    random.seed(21)
    vocabulary = [f"w{i}" for i in range(500)]
    docs, labels = [], []
    for i in range(400):
        words = random.choices(vocabulary, k=random.randint(20, 80))
        toxic = random.random() < 0.2
        if toxic:
            for _ in range(4):
                words[random.randrange(len(words))] = random.choice(INSULTS)
        elif i > 20 and random.random() < 0.2:
            words = docs[random.randrange(i)][1].split()
            words[-1] = f"edit{i}"
            toxic = any(w in INSULTS for w in words)
        elif random.random() < 0.2:
            words[3] = f"me{i}@mail.example.org"
        docs.append((i, " ".join(words), "en", random.choice(["a", "a", "a", "b", None]), 0))
        labels.append((i, 1, int(toxic)))
    docs += [(400, None, None, None, None), (401, "", "en", "b", 0)]
    docs = [(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_stages_one_by_one(spark, tmp_path):
    rows = tables(spark, tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def after(name):
        out = stages[name](spark, docs, str(tmp_path))
        assert name == "packing" or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    docs = after("toxicity")
    clean = [r for r in rows if not any(w in INSULTS for w in (r[1] or "").split())]
    assert sorted(map(tuple, docs.collect()), key=str) == sorted(clean, key=str)

    docs = after("near_dedup")
    kept = brute_force([(r[0], r[1]) for r in clean])
    unique = [r for r in clean if kept[r[0]][2]]
    assert 0 < len(unique) < len(clean)
    assert sorted(map(tuple, docs.collect()), key=str) == sorted(unique, key=str)

    docs = after("pii")
    mask = lambda t: t and " ".join("<email>" if "@" in w else w for w in t.split(" "))
    masked = [(i, mask(t), lang, s, len(mask(t) or "")) for i, t, lang, s, _ in unique]
    found = {r.doc_id: r for r in docs.collect()}
    for r in masked:
        assert found[r[0]].text == r[1] and found[r[0]].source == r[3]

    docs = after("mixing")
    sizes, taken = {}, {}
    for r in masked:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    for r in docs.collect():
        taken[r.source] = taken.get(r.source, 0) + len((r.text or "").split())
    for source, target in mixing.share_out(sizes).items():
        assert abs(taken.get(source, 0) - target) <= 25
    mixed = docs.collect()

    out = after("packing").collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sums = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2] for r in mixed}
    total = sum(len(sums[r.doc_id]) for r in mixed)
    assert sum(r.length for r in out) == total
    for r in out:
        ids = np.array(sums[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids.tobytes())

    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, out), key=str)


def test_stages_of_empty_and_repeated_documents(spark, tmp_path):
    tables(spark, tmp_path)
    stages = corpus_pipeline.STAGES
    full = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs = full.limit(0)
    for name, stage in stages:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name
    docs = full.where("doc_id in (300, 301, 400)").unionByName(full.where("doc_id in (300, 400)"))
    for name, stage in stages:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/again-{name}")
        docs = spark.read.parquet(f"{tmp_path}/again-{name}")
    assert docs.count() > 0
