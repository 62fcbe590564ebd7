"""Drops of files through the stream: re-sent, changed, late and gone files, restarts."""

from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.operators import chunkers
from siltstone.operators.chunkers import ChunkConfig
from siltstone.streaming.ingest import IncrementalIngest, net_change

CONFIG = ChunkConfig(chunk_size=20, chunk_overlap=0, min_chunk_size=1)


def put(root, drop, **files):
    for name, text in files.items():
        p = root / drop / "sub" / f"{name.replace('_', '.')}"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def rows(ingest):
    return sorted((r.name, r.chunk_index, r.text) for r in ingest.chunks().collect())


def wanted(spark, **texts):
    """Chunks of the given texts, chunked at once."""
    names = {i: f"sub/{n.replace('_', '.')}" for i, n in enumerate(texts)}
    docs = spark.createDataFrame(list(enumerate(t.strip() for t in texts.values())), "doc_id long, text string")
    return sorted((names[r.doc_id], r.chunk_index, r.text) for r in chunkers.chunk(docs, "recursive", CONFIG).collect())


def kinds(ingest):
    return sorted((r.batch, r.name, r.kind) for r in ingest._table("changes", "name string, drop string, path string, digest string, kind string").collect())


def test_drops_restarts_and_repeated_batches(spark, tmp_path, monkeypatch):
    src, out = tmp_path / "in", str(tmp_path / "out")
    a, b, c = ("one text of some words. " * 12, "another text of more words. " * 9, "third text. " * 30)
    put(src, "d1", a_txt=a, b_txt=b, c_md=c)
    made = lambda: IncrementalIngest(spark, str(src), out, config=CONFIG)  # noqa: E731  (a new one for each run, as after a restart)
    made().run()
    assert rows(made()) == wanted(spark, a_txt=a, b_txt=b, c_md=c) and {k for *_, k in kinds(made())} == {"new"}
    first = kinds(made())

    put(src, "d2", a_txt=a, b_txt=b + "changed now.")  # one re-sent, one changed
    put(src, "d2", d_docx="no archive", c_md_gone="-", a_txt_gone="-", empty_txt="")  # a file wins over the mark of its drop
    made().run()
    assert rows(made()) == wanted(spark, a_txt=a, b_txt=b + "changed now.")
    assert {x[1:] for x in kinds(made()) if x not in first} == {("sub/b.txt", "changed"), ("sub/c.md", "gone"), ("sub/d.docx", "new")}
    assert [(r.name, r.step) for r in made().failures().collect()] == [("sub/d.docx", "load")]

    put(src, "d0", b_txt="late and old")  # an older drop that comes late
    before = kinds(made())
    made().run()
    assert kinds(made()) == before

    # the run ends after everything is written and before Spark records the batch: it is repeated, and nothing is there twice
    put(src, "d3", c_md=c, a_txt="a newer text of a. " * 8)
    whole = IncrementalIngest.write

    def cut_short(self, changes, batch):
        whole(self, changes, batch)
        raise RuntimeError("the driver is lost")

    monkeypatch.setattr(IncrementalIngest, "write", cut_short)
    with pytest.raises(Exception, match="the driver is lost"):
        made().run()
    monkeypatch.setattr(IncrementalIngest, "write", whole)
    state = rows(made())
    made().run()
    texts = {"a_txt": "a newer text of a. " * 8, "b_txt": b + "changed now.", "c_md": c}
    assert rows(made()) == state == wanted(spark, **texts)
    assert len(kinds(made())) == len(set(kinds(made()))) == len(before) + 2
    assert {(r.name, r.kind) for r in made().versions().collect()} >= {("sub/c.md", "new"), ("sub/a.txt", "changed")}

    made().run()  # nothing new
    assert rows(made()) == state


def test_bounded_batches_give_the_same(spark, tmp_path):
    src = tmp_path / "in"
    texts = {f"f{i}_txt": f"words of file {i} and more of them " * 5 for i in range(7)}
    put(src, "d1", **texts)
    small = IncrementalIngest(spark, str(src), str(tmp_path / "out"), config=CONFIG, max_files=3)
    small.run()
    assert rows(small) == wanted(spark, **texts) and len({b for b, *_ in kinds(small)}) == 3


def test_empty_and_without_drop(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    ingest = IncrementalIngest(spark, str(src), str(tmp_path / "out"), config=CONFIG)
    assert ingest.chunks().count() == ingest.failures().count() == 0
    (src / "x.txt").write_text("no drop at all")
    (src / "y.unknown").write_text("no loader")
    ingest.run()
    assert rows(ingest) == [("x.txt", 0, "no drop at all")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("1234"), st.sampled_from(["x", "y", None])), min_size=1, max_size=8, unique_by=lambda t: (t[0], t[1] is None)), st.randoms())
def test_any_order_and_batching_ends_alike(arrived, random):
    """The last state follows from the set of arrivals alone."""
    ends = set()
    for _ in range(4):
        order = [(d, f"{d}/{g}", g) for d, g in arrived]
        random.shuffle(order)
        state, held = None, None
        while order:
            n = random.randint(1, len(order))
            state, change = net_change(state, order[:n])
            order = order[n:]
            if change is not None:
                assert change[2] != held
                held = change[2]
        assert state is not None and held == state[1]
        ends.add(state)
    newest = max(arrived, key=lambda t: (t[0], t[1] is not None))
    assert ends == {newest}


def test_digest_is_of_the_content(spark, tmp_path):
    src = tmp_path / "in"
    put(src, "d1", a_txt="some text here")
    ingest = IncrementalIngest(spark, str(src), str(tmp_path / "out"), config=CONFIG)
    ingest.run()
    assert ingest.versions().first().digest == hashlib.sha256(b"some text here").hexdigest()
