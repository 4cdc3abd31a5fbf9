"""Matches by runs of doubling length against difflib's own, in results and in growth."""

import difflib
import random
import time

import pytest

from lexmill.operators import diff


@pytest.mark.parametrize("few", [0, 60, 4096])
def test_matches_are_those_of_difflib(few, monkeypatch):
    monkeypatch.setattr(diff, "_FEW", few)
    r = random.Random(3)
    for _ in range(150):
        letters = "abcdefghijklmnopqrstuvwxyz"[: r.choice((1, 2, 5, 26))]
        a = r.choices(letters, k=r.randrange(80))
        b = a[r.randrange(5) :] if r.random() < 0.5 else r.choices(letters, k=r.randrange(80))
        for _ in range(r.randrange(4)):
            b.insert(r.randrange(len(b) + 1), r.choice("abx"))
        mine, plain = diff.Matcher(a, b), difflib.SequenceMatcher(None, a, b, autojunk=False)
        assert (mine.get_opcodes(), mine.ratio()) == (plain.get_opcodes(), plain.ratio())


def test_long_texts_full_of_spaces_take_no_quadratic_time():
    r = random.Random(4)
    words = [str(r.randrange(500)) for _ in range(10_000)]
    changed = [str(r.randrange(500)) if r.random() < 0.01 else w for w in words]
    start = time.process_time()
    ops = diff.Matcher([u for w in words for u in (w, " ")], [u for w in changed for u in (w, " ")]).get_opcodes()
    assert len(ops) > 100 and time.process_time() - start < 20  # difflib: over a minute
