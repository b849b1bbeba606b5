import random
import re
from collections import Counter

import numpy as np

from gristmill.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """Measures, verdict and cleaned text, line by line."""
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + d for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for d in range(3)}
    seen, rules, lost, n_lines, dup, stay = set(), [0, 0, 0], 0, 0, 0, []
    lines = text.split("\n")
    for k, line in enumerate(lines):
        own = WORD.findall(line)
        whole = line + ("\n" if k + 1 < len(lines) else "")
        if not own:
            stay.append(whole)
            continue
        n_lines += 1
        later = line in seen
        seen.add(line)
        dup += later
        chars = sum(map(len, own))
        shouted, parted = sum(w[-1] in "!?" for w in own), sum(w in quality.SEPARATORS for w in own)
        low = re.sub("[A-Z]", lambda m: m[0].lower(), line)
        fails = (
            own[-1][-1] not in quality.SENTENCE_MARKS and chars < 40 or len(own) >= 5 and 100 * shouted >= 30 * len(own),
            parted >= 3 and 100 * parted >= 20 * len(own),
            later or any(p in low for p in quality.PHRASES) or 100 * sum(c in quality.SYMBOLS for c in line) >= 10 * chars,
        )
        rules = [a + b for a, b in zip(rules, fails)]
        if any(fails):
            lost += chars
        else:
            stay.append(whole)
    total = sum(map(len, words))
    base = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    measures = [len(words), total, sum(text.count(c) for c in quality.SYMBOLS), dup, len(repeated), n_lines, *rules, lost]
    return (*measures, base, not base and 100 * lost <= 50 * total, "".join(stay))


PIECES = [
    "A plain sentence that ends as it should.", "no end", "WHAT! NOW! BUY! THIS! STUFF!", "Home | About | Contact | Login", "All Rights Reserved 2020.", "",
    "   ", "## *** $$$ %%%", "日本語の文。", "Das ist ein langer Satz ohne Zeichen am Ende und er geht noch weiter", "« oui »", "a > b > c > d", "Why?\r", "• one • two • three • x.",
    "We use cookies to serve you.", "ends with …", "x\x0by", "हिन्दी।", "a b.", "LICENSED UNDER the law", "one\ttwo three.", "Click", "here it is not.",
]


def test_clean_equals_brute_force(documents, odd_rows, prose):
    rng = random.Random(2)
    rows = list(odd_rows)
    for k in range(600):
        own = [rng.choice([*PIECES, prose(rng.randrange(1, 40), k, 30) + "."]) for _ in range(rng.randrange(12))]
        rows.append((100 + k, "\n".join(own)))
    got = [(r[0], *r[1:]) for r in quality.clean(documents(rows)).collect()]
    assert sorted(got, key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert {(r[-3], r[-2]) for r in got} == {(True, False), (False, True), (False, False)}
    assert quality.clean(documents([])).count() == 0


def test_clean_texts_stay(documents, prose):
    good = "\n".join(prose(12, k).capitalize() + "." for k in range(10))
    menu = "\n".join(["Home | News | Sports | Contact"] + [f"Item {k}" for k in range(60)])
    found = {r.doc_id: r for r in quality.clean(documents([(1, good), (2, menu), (3, good + "\n" + menu[:40])])).collect()}
    assert found[1].kept and found[1].text == good
    assert not found[2].kept and not found[2].base_failed
    assert found[3].kept and found[3].text == good + "\n"


def test_long_text_in_blocks(prose, monkeypatch):
    text = "\n".join([prose(30, k % 7) + "." for k in range(40)] + PIECES * 2 + ["x" * 900, prose(400, 1)]).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    one = quality.Lines(data, offsets)
    monkeypatch.setattr(quality, "SLICE_BYTES", 200)
    many = quality.Lines(data, offsets)
    for name in ("words", "at", "symbols", "word_chars", "begin", "stop", "text", "chars", "punctuation", "navigation", "boilerplate", "later", "failed"):
        assert (getattr(one, name) == getattr(many, name)).all(), name
    assert (one.repeated_words() == many.repeated_words()).all()
