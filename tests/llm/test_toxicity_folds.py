"""Folds, choice of phase and calibration of the toxicity network."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from dealspark.llm import common, toxicity


def _rows(n: int, seed: int = 3) -> tuple[list[str], list[int]]:
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in ("bo", "ka", "tel", "min", "su") for b in ("ra", "den", "pol", "ix")]
    y = [int(i % 3 == 0) for i in range(n)]
    return [" ".join([*rng.choice(words, 20), *(["grobnak", "vexolt"] if t else [])]) for t in y], y


def test_equal_texts_share_a_fold_and_labels_are_dealt_evenly():
    texts, y = _rows(60)
    fold = toxicity._folds(texts + texts[:20], np.array(y + y[:20], np.float32), 17)
    assert (fold[60:] == fold[:20]).all()
    for label in (0, 1):
        sizes = np.bincount(fold[:60][np.array(y) == label], minlength=toxicity.FOLDS)
        assert len(sizes) == toxicity.FOLDS and sizes.max() - sizes.min() <= 1


def test_a_fold_is_judged_without_being_read():
    texts, y = _rows(45)
    labels = np.array(y)
    part = toxicity.learn(texts, labels, 1, steps=2)
    fold = toxicity._folds(texts, labels.astype(np.float32), 17)
    assert part.rows.tolist() == np.flatnonzero(fold == 1).tolist() and all(len(t) == len(part.rows) for t in part.tops)
    # what its texts say changes nothing in what is learnt
    changed = [t + " onlyhere onlyhere" if fold[i] == 1 else t for i, t in enumerate(texts)]
    assert (toxicity._folds(changed, labels.astype(np.float32), 17) == fold).all()
    again = toxicity.learn(changed, labels, 1, steps=2)
    assert (again.words == part.words).all() and (again.params[-1]["wo"] == part.params[-1]["wo"]).all()


def test_rank_equals_all_pairs():
    rng = np.random.default_rng(0)
    top, y = rng.integers(0, 6, 50).astype(float), rng.integers(0, 2, 50)
    p, n = top[y == 1], top[y == 0]
    assert toxicity._rank(top, y) == pytest.approx(((p[:, None] > n) + 0.5 * (p[:, None] == n)).mean())
    assert np.isnan(toxicity._rank(top, np.ones(50)))


def test_tasks_of_spark_learn_from_the_rows_of_one_process(spark):
    texts, y = _rows(45)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(y)], "doc_id long, toxic int")
    got = toxicity.train(docs, labels)
    parts = [toxicity.learn(texts, np.array(y), k, steps=1) for k in range(toxicity.FOLDS + 1)]
    want = toxicity.combine(parts, np.array(y), 1 / 3)
    # with fewer steps, so only what the rows decide is compared
    assert got.trained and (got.words == want.words).all() and got.base == pytest.approx(want.base)
    assert {k: v.shape for k, v in got.params.items()} == {k: v.shape for k, v in want.params.items()}


def test_the_driver_gets_one_phase_of_one_network(spark, monkeypatch):
    """pipeline: the other phases and the folds' networks stay in the shared folder."""
    sent, loads = [], toxicity.pickle.loads
    monkeypatch.setattr(toxicity.pickle, "loads", lambda raw: sent.append(len(raw)) or loads(raw))
    texts, y = _rows(45)
    m = toxicity.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int"))
    size = sum(v.nbytes for v in m.params.values())
    assert m.trained and len(sent) == toxicity.FOLDS + 2 and size < sum(sent) < 1.5 * size


def test_pieces_equal_the_whole(monkeypatch):
    """pipeline: words, hashes and n-grams are the same however few are held at once."""
    texts = [*_rows(40)[0], "", "  ", "Ärger über x" + "y" * 300, "y", *_rows(5)[0]]
    words = common.split_words(pc.utf8_lower(pa.array(texts, pa.large_string())), common.NOT_ALNUM)
    uniq, at, inverse = toxicity._distinct(words)
    known, rolled = uniq[::3], common.rolling(words.hashes(), 5)
    want = toxicity._vocabulary(words, uniq, at, known)
    means = toxicity._char_means({"chars": np.random.default_rng(0).standard_normal((toxicity.CHAR_BUCKETS, toxicity.CHAR_DIM)).astype(np.float32)}, want)
    monkeypatch.setattr(common, "PIECE", 50)
    monkeypatch.setattr(toxicity, "PIECE", 50)
    monkeypatch.setattr(toxicity, "GRAMS", 20)
    assert (common.rolling(words.hashes(), 5) == rolled).all() and len(common.rolling(words.hashes()[:4], 5)) == 0
    distinct, counts, *numbers = toxicity._read(texts)
    assert (counts == np.diff(words.first)).all() and (numbers[0] == uniq).all() and (numbers[2] == inverse).all()
    got = toxicity._vocabulary(distinct, numbers[0], numbers[1], known)
    assert all((getattr(got, a) == getattr(want, a)).all() for a in ("ids", "grams", "first"))
    assert (toxicity._char_means({"chars": np.random.default_rng(0).standard_normal((toxicity.CHAR_BUCKETS, toxicity.CHAR_DIM)).astype(np.float32)}, got) == means).all()


def test_training_holds_no_numbers_for_each_byte(monkeypatch):
    """pipeline: a training task held fifty-six bytes for each byte of its texts."""
    monkeypatch.setattr(common, "_POWERS", {})
    texts, y = _rows(60)
    texts = [" ".join([t] * 600) for t in texts]
    tracemalloc.start()
    toxicity.learn(texts, np.array(y), 1, steps=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15 * sum(map(len, texts))


def test_few_and_missing_labels():
    for y in ([0] * 6, [1] * 6, [1, 0, 0, 0, 0, 0], [1, 0]):
        texts = _rows(len(y))[0]
        m = toxicity.fit(texts, np.array(y), float(np.mean(y)), steps=1)
        got = toxicity.score_slice(m, pa.array([*texts, "", None], pa.large_string()))
        assert np.isfinite(got).all() and (got >= 0).all() and (got <= 1).all()
        assert m.trained == (0 < sum(y) < len(y)) and (got[-2:] == m.base).all()


def test_a_training_task_holds_few_times_its_texts():
    """pipeline, finding 1: on these texts, mostly of rare words, it held 43.7 bytes for each of theirs."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i:x}" for i in rng.integers(0, 40_000, 400)) for _ in range(600)]
    labels = np.arange(600) % 2
    toxicity.learn(texts[:4], labels[:4], 1, steps=1)  # what is loaded once doesn't count
    tracemalloc.start()
    part = toxicity.learn(texts, labels, 1, steps=1, nets=False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 * sum(map(len, texts))
    whole = toxicity.learn(texts, labels, 1, steps=1)
    assert not part.params and all((a == b).all() for a, b in zip(part.tops, whole.tops, strict=True))
