"""Properties of the pure parts."""

import difflib

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators.impact import diff_lists
from tessera.operators.segment import recursive_split
from tessera.streaming.logs import advance, apply_event

texts = st.lists(st.text("abc d", min_size=1, max_size=30), max_size=8)


@given(texts, texts)
@settings(max_examples=60, deadline=None)
def test_diff_tells_all_that_is_new_or_gone(old, new):
    got = diff_lists(old, new)
    if old == new:
        assert got == []
    same = sum(b.size for b in difflib.SequenceMatcher(None, old, new).get_matching_blocks())
    kinds = [k for k, _ in got]
    assert kinds.count("removed") + kinds.count("modified") == len([x for x in old]) - same
    assert kinds.count("added") + kinds.count("modified") == len(new) - same


@given(st.text("ab \n", max_size=300), st.integers(3, 40), st.integers(0, 2))
@settings(max_examples=60, deadline=None)
def test_parts_are_no_longer_than_asked(text, size, overlap):
    parts = recursive_split(text, size, overlap)
    assert all(0 < len(p) <= size for p in parts)
    if not overlap:
        assert "".join("".join(parts).split()) == "".join(text.split())


@given(st.lists(st.sampled_from(["Step 1 completed", "Step 2 completed", "Step 2 running", "x", "Step 10 completed"]), max_size=12))
@settings(max_examples=60, deadline=None)
def test_steps_only_move_forward(lines):
    state = (0, ("pending", "pending"))
    for line in lines:
        new = advance(state, line, ["1", "2"])
        assert new[0] >= state[0] and all(s == "completed" for s in new[1][: new[0]])
        state = new


@given(st.text(max_size=40))
@settings(max_examples=60, deadline=None)
def test_foreign_lines_change_nothing(line):
    if not line.startswith("data:"):
        assert apply_event("c", "s", line) == ("c", "s")
