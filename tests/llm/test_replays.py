"""Plain replays of methods: best fit of packing, kernel ridge of language ID, files of the shared folder."""

import random
from collections import Counter

import numpy as np
import pytest

from frameloom.llm import common, langid, packing

# ---- packing --------------------------------------------------------------------------------------


def replay(lengths, size, most, gap):
    """Windows as plain lists; a step at a time, by the rules as the module states them."""
    open_windows, emitted = [], []
    used = lambda w: sum(n for _, _, n in w)

    def close(w):
        emitted.append(w)
        open_windows[:] = [x for x in open_windows if x is not w]

    for row, n in enumerate(lengths):
        start = 0
        while n - start >= size:
            emitted.append([(row, start, size)])
            start += size
        while start < n:
            rest = n - start
            room = {i: size - used(w) for i, w in enumerate(open_windows)}
            fitting = sorted((r - rest, i) for i, r in room.items() if r >= rest)
            if fitting:
                w = open_windows[fitting[0][1]]
                w.append((row, start, rest))
                start = n
                if used(w) == size:
                    close(w)
            elif len(open_windows) < most:
                open_windows.append([(row, start, rest)])
                start = n
            else:
                w = open_windows[min(room, key=lambda i: (room[i], i))]
                free = size - used(w)
                if free >= gap:
                    w.append((row, start, free))
                    start += free
                close(w)
    return emitted, open_windows


@pytest.mark.parametrize(("seed", "size", "most", "gap"), [(0, 64, 3, 4), (1, 50, 1, 1), (2, 128, 7, 16), (3, 16, 4, 16)])
def test_windows_equal_a_plain_best_fit(seed, size, most, gap):
    rnd = random.Random(seed)
    lengths = [rnd.choice([1, 2, 3, rnd.randrange(1, size), rnd.randrange(1, 3 * size), size]) for _ in range(400)]
    emitted = []
    windows = packing.Windows(size, most, gap, emitted.append)
    for row, n in enumerate(lengths):
        windows.add(row, n)
    assert (emitted, [w[1] for w in windows.open]) == replay(lengths, size, most, gap)


# ---- language ID ------------------------------------------------------------------------------------


def plain_grams(text):
    clean = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    padded = f" {clean} "
    return {padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)}


def test_predictions_equal_kernel_ridge_by_sets():
    """The same equations over sets of strings: kernels, Nyström landmarks, balanced one-versus-rest ridge."""
    rnd = random.Random(2)
    letters = {"aa": "abcde", "bb": "cdefgé", "cc": "fghijü"}
    make = lambda lab: " ".join("".join(rnd.choice(letters[lab]) for _ in range(rnd.randrange(1, 7))) for _ in range(rnd.randrange(3, 25)))
    labels = [rnd.choice(["aa", "aa", "bb", "cc"]) for _ in range(150)]
    texts = [make(x) for x in labels]
    model = langid.fit(texts, labels, landmarks=8)
    kernel = lambda a, b: len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b)))
    sets, seen, marks = [plain_grams(t) for t in texts], Counter(), []
    for i, x in enumerate(labels):
        seen[x] += 1
        if seen[x] <= 8:
            marks.append((seen[x], x, i))
    marks = [i for _, _, i in sorted(marks)]
    names = sorted(set(labels))
    k_nm = np.array([[kernel(a, sets[m]) for m in marks] for a in sets])
    y = np.array([[1.0 if x == n else -1.0 for n in names] for x in labels])
    balance = np.array([len(labels) / len(names) / labels.count(x) for x in labels])[:, None]
    normal = k_nm.T @ (balance * k_nm) + langid.RIDGE * len(texts) * k_nm[marks] + 1e-8 * np.eye(len(marks))
    weights = np.linalg.solve(normal, k_nm.T @ (balance * y))
    asked = texts + [make(rnd.choice(names)) for _ in range(100)] + ["é", "zzz", "a b c", "FGH! abc 12"]
    margins = np.array([[kernel(plain_grams(t), sets[m]) for m in marks] for t in asked]) @ weights
    odds = np.exp(4 * (margins - margins.max(axis=1, keepdims=True)))
    want, score = [names[k] for k in margins.argmax(axis=1)], odds.max(axis=1) / odds.sum(axis=1)
    found, scores = model.predict(asked)
    sure = np.sort(margins, axis=1)[:, -1] - np.sort(margins, axis=1)[:, -2] > 1e-3  # single precision, and hashes of n-grams
    assert sure.mean() > 0.95 and [f for f, s in zip(found, sure, strict=True) if s] == [w for w, s in zip(want, sure, strict=True) if s]
    assert np.allclose(np.array(scores), score, atol=5e-3)


def test_labels_with_long_texts_only_are_learned(spark):
    long = "le chat noir et la souris " * 1000
    rows = [(k, "the cat and the mouse", "en") for k in range(5)] + [(9, long, "fr"), (10, "a cat " * 5000, "en")]
    model = langid.fit_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.labels == ["en", "fr"] and model.predict([long, "the cat"])[0] == ["fr", "en"]


# ---- the shared folder ------------------------------------------------------------------------------


def test_a_file_that_is_there_already_stays(tmp_path, monkeypatch):
    uri = f"file://{tmp_path}/a/b"
    common.put_bytes(uri, b"once")
    common.put_bytes(uri, b"once")
    refused = lambda *_: (_ for _ in ()).throw(OSError("file exists"))

    class Refusing:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            return refused if name == "move" else getattr(self.inner, name)

    open_fs = common.open_fs
    monkeypatch.setattr(common, "open_fs", lambda u: (Refusing(open_fs(u)[0]), open_fs(u)[1]))
    common.put_bytes(uri, b"once")
    with pytest.raises(OSError, match="exists"):
        common.put_bytes(uri, b"other bytes")
    assert (tmp_path / "a" / "b").read_bytes() == b"once"


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: None if key == "spark.checkpoint.dir" else "/warehouse")

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session, "x")
