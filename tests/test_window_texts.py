"""Windows of known items are cut from texts in the tasks."""

from __future__ import annotations

import pyarrow as pa

from siltstone.operators import evaluate


def test_windows_are_cut_from_texts_as_tokens_are():
    """Lower-case texts, no lists of tokens, come to the tasks."""
    row, g = evaluate.window_hashes(pa.array(["a  b\tc", None, "", "a b", "a b c"]), 2)
    assert row.tolist().count(0) == 2 and not {1, 2} & set(row.tolist())
    of = lambda i: set(g[row == i].tolist())
    assert of(3) < of(0) == of(4) and len(of(3)) == 1
