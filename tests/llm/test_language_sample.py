import random
import tracemalloc

import numpy as np

from gristmill.llm import language


def test_sample_is_whole_and_held_sparse():
    assert (language.SAMPLE_ROWS, language.SAMPLE_BYTES) == (1_500, 16_000_000)
    rng = random.Random(3)
    samples = [(" ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(40)), lang) for lang, letters in (("a", "abcdef"), ("b", "ghijkl"), ("c", "mnopqr"), ("d", "stuvwx")) for _ in range(300)]
    tracemalloc.start()
    model = language.fit(samples)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < len(samples) * language.DIMENSIONS * 4
    counts = np.array([language.gram_counts(np.frombuffer(t.encode(), np.uint8)) for t, _ in samples[::50]])
    assert [model.languages[k] for k in language.predict(model, counts)[0]] == [lang for _, lang in samples[::50]]
