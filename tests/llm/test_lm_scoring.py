import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hindsight.llm import attention, lm_scoring, queries
from hindsight.llm.common import words

PATH = public_tokenizers.path("word_bpe_49k.json")


def base(rows):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    counts = Counter()
    for (_, text), h in zip(rows, held, strict=True):
        if not h:
            counts.update([*words(text), None])
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for (i, text), h in zip(rows, held, strict=True):
        tokens = [*words(text), None]
        score = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in tokens)
        out.append((i, h, len(tokens), sum(counts[t] > 0 for t in tokens), total, score))
    return out


def scores(spark, rows):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, kind string, n_tokens int")
    return lm_scoring.score_texts(df.repartition(2), PATH).collect()


def corpus(n, seed=1):
    random.seed(seed)
    out = []
    for i in range(n):
        w = random.choice([["the red fox", "saw a", "big house ,"], ["eine rote", "katze und der", "hund !"]])
        out.append((i, " ".join(random.choice(w) for _ in range(random.randint(0, 60)))))
    return out


@pytest.mark.parametrize("frequent", [1 << 20, 3, 0])
def test_base_equals_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm_scoring, "FREQUENT_WORDS", frequent)
    rows = corpus(150) + [(1000, None), (1001, ""), (None, "no id Fox"), (1002, "unseen words only"), (1003, "w" + "x y" * 30_000), (7, "another text"), (1001, "")]
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scores(spark, rows)), key=str)
    assert got == sorted(((*r[:5], round(r[5], 6)) for r in base(rows)), key=str)


def test_model_learns_and_beats_the_base(spark):
    rows = corpus(500)
    out = [r for r in scores(spark, rows) if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert all(r.score < 0 for r in out)


def plain_log_probability(w, vocabulary, ids):
    """The model, one token at a time, straight from its definition."""
    run = vocabulary.runs(np.array(ids, np.int64))
    return sum(one_step(w, run[: i + 1], len(run), i)[run[i + 1]] for i in range(len(run) - 1)) + float(vocabulary.extra[ids].sum())


def one_step(w, seen, _, i):
    low = max(0, (i // attention.BLOCK - 1) * attention.BLOCK)
    e = w.embed[seen[low:]].astype(float)
    q = e[-1] @ w.query / attention.KEY**0.5
    s = np.array([q @ (x @ w.key) + w.near[i - low - j] for j, x in enumerate(e)])
    a = np.exp(s - s.max())
    a /= a.sum()
    h = np.maximum(np.concatenate([e[-1], a @ (e @ w.value)]) @ w.mix + w.mix_bias, 0)
    soft = lambda z: z - z.max() - np.log(np.exp(z - z.max()).sum())
    pc = soft(h @ w.cluster + w.cluster_bias)
    return np.concatenate([pc[c] + soft(h @ w.member[c] + w.member_bias[c]) for c in range(attention.CLUSTERS)])


def some_weights(seed=3):
    random = np.random.default_rng(seed)
    w = attention.initial(random.integers(1, 50, attention.START))
    return w.like((w.flat() + 0.1 * random.normal(size=w.flat().size)).astype(np.float32))


def test_batched_windows_are_the_model():
    random = np.random.default_rng(0)
    counts = np.zeros(2000, np.int64)
    counts[:1500] = random.integers(0, 90, 1500)
    vocabulary, w = lm_scoring.Vocabulary(counts, 10), some_weights()
    texts = [random.integers(0, 2000, n) for n in (0, 1, 15, 16, 17, 40, 100, 3)]
    # Here blocks start with each text.
    for ids in texts:
        run = vocabulary.runs(ids)
        got = attention.log_probabilities(w, *attention.stream([run])).sum() + vocabulary.extra[ids].sum()
        assert got == pytest.approx(plain_log_probability(w, vocabulary, ids), rel=1e-4)
    # In a stream, texts do not see each other and order does not matter beyond where blocks fall.
    runs = [vocabulary.runs(ids) for ids in texts]
    found = attention.log_probabilities(w, *attention.stream(runs))
    assert len(found) == sum(len(r) - 1 for r in runs) and (found < 0).all()
    other = np.concatenate([[attention.START], runs[6][:0:-1]])
    changed = [runs[0], other, *runs[2:]]
    again = attention.log_probabilities(w, *attention.stream(changed))
    assert again[-4:] == pytest.approx(found[-4:], rel=1e-4)


@pytest.mark.parametrize("scale", [1, 40])
def test_probabilities_add_up_to_one(scale):
    w = some_weights()
    w = w._replace(member_bias=scale * w.member_bias, cluster=scale * w.cluster, query=scale * w.query)
    head = [attention.START, 5, 900]
    total = sum(math.exp(attention.log_probabilities(w, *attention.stream([np.array([*head, t])]))[-1]) for t in range(0, attention.START))
    assert total == pytest.approx(1, abs=1e-3)
    counts = np.zeros(3000, np.int64)
    counts[::2] = 7
    vocabulary = lm_scoring.Vocabulary(counts, 1)
    assert np.exp(vocabulary.extra[vocabulary.place == lm_scoring._RARE]).sum() == pytest.approx(1)


def test_gradient_is_that_of_the_loss():
    random = np.random.default_rng(1)
    w = some_weights()
    runs = [np.append(attention.START, random.integers(0, attention.START, n)) for n in (30, 5, 50)]
    args = next(attention._batches(*attention.stream(runs), batch=64))
    exact = lambda flat: attention._Pass(w.like(flat), *args)
    flat = w.flat().astype(np.float64)
    gradient = exact(flat).gradient().flat()
    loss = lambda flat: -exact(flat).log.sum() / (args[2] >= 0).sum()
    direction = random.normal(size=flat.size)
    for scale, some in ((1, np.ones(flat.size)), (1, np.arange(flat.size) > flat.size // 2)):
        step = direction * some * 1e-3 * scale
        slope = (loss(flat + step) - loss(flat - step)) / 2
        assert slope == pytest.approx(float(gradient @ step), rel=0.05, abs=1e-5)


def test_odd_tables(spark):
    assert scores(spark, []) == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    (row,) = scores(spark, [(held, "only held out")])
    assert row.train_tokens == 0 and row.n_known == 0 and row.score < 0
    assert Tokenizer


@pytest.mark.parametrize("text", ["", "a", " a", "a ", "A b\tA\x0bb\x0c\r\nÉ é", "x" * 3_000_000 + " y", "a\x1cb\u00a0c"])
def test_word_hashes(text):
    found = words(text)
    hashes = lm_scoring.word_hashes(text.encode())
    assert len(hashes) == len(found) == lm_scoring.word_count(text.encode())
    assert len(set(hashes.tolist())) == len(set(found)) and 0 not in hashes
    assert hashes.tolist() == [int(lm_scoring.word_hashes(w)[0]) for w in found]


def test_query_learns_from_every_training_token_once(spark, monkeypatch, tmp_path):
    """The windows of the rounds hold all tokens of the training texts and their ends, none of the held-out ones."""
    rows = [*corpus(300, seed=4), (1000, None), (1001, "rote katze " * 2000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    kept, write = {}, lm_scoring.written
    monkeypatch.setattr(lm_scoring, "SHARE", 2000)
    monkeypatch.setattr(lm_scoring, "written", lambda df, name: kept.setdefault(name, write(df, name)))
    assert queries.op3_attention_lm_scoring(spark, str(tmp_path)).count() == len(rows)
    tokenizer = Tokenizer.from_file(PATH)
    learnt = [text or "" for i, text in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    tokens = sum(len(tokenizer.encode(text, add_special_tokens=False).ids) + 1 for text in learnt)
    windows = kept["windows"].collect()
    assert sum(len(w["run"]) // 2 - 1 for w in windows) == tokens
    assert {w["round"] for w in windows} == set(range(lm_scoring.ROUNDS))
    assert len({(w["doc_id"], w["place"]) for w in windows}) == len(windows)


def test_averaging_takes_little_disk(spark, monkeypatch):
    """Trainers pass on four bytes a weight, whatever their number is raised to."""
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()

    def held():
        found = files()
        return {found.apply(i).getPath(): found.apply(i).length() for i in range(found.size())}

    monkeypatch.setattr(lm_scoring, "SHARE", 60)
    before = held()
    out = scores(spark, corpus(300))
    trainers = sum(r.n_tokens for r in out if not r.held_out) // (lm_scoring.ROUNDS * lm_scoring.SHARE)
    assert trainers > 30
    weights = attention.initial(np.ones(attention.START)).flat().nbytes
    took = sum(size for path, size in held().items() if path not in before)
    assert took < 0.8 * lm_scoring.ROUNDS * trainers * weights  # some trainers have no windows


def test_weights_are_averaged_by_tokens(spark):
    some = [some_weights(seed).flat() for seed in (1, 2, 3)]
    tokens = [5, 70, 300]

    def rows(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield lm_scoring._weights_rows(some[i], tokens[i], i)

    got = lm_scoring._average(spark.range(3).repartition(3).mapInArrow(rows, lm_scoring._WEIGHTS_DDL))
    assert got == pytest.approx(np.average(some, axis=0, weights=tokens), rel=1e-5, abs=1e-7)
    assert lm_scoring._average(spark.createDataFrame([], lm_scoring._WEIGHTS_DDL)) is None


def test_short_streams_are_learnt_from():
    """Some hundred windows lower the loss well below that of the frequencies."""
    random = np.random.default_rng(5)
    follow = random.permutation(40)
    texts = []
    for _ in range(60):
        text = [int(random.integers(40))]
        while len(text) < 100:
            text.append(int(follow[text[-1]]))
        texts.append(np.array([attention.START, *text]))
    w = attention.initial(np.where(np.arange(attention.START) < 40, 100, 0))
    stream = attention.stream(texts)
    before = attention.log_probabilities(w, *stream).mean()
    learnt = attention.trained(w, *stream, rate=lm_scoring.RATE)
    assert attention.log_probabilities(learnt, *stream).mean() > 0.8 * before


def test_steps_hold_little():
    """A step of training holds less than 2,250 bytes a token at once (before, 2,418)."""
    random = np.random.default_rng(0)
    stream = attention.stream([random.integers(0, attention.START, 257) for _ in range(32)])
    w = attention.initial(np.ones(attention.START))
    args = next(attention._batches(*stream, batch=attention.BATCH))
    tracemalloc.start()
    try:
        attention._Pass(w, *args).gradient()
        held = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert held < 2250 * len(args[2])
