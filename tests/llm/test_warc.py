"""WARC archives: an exact round trip, whole and of a selection."""

import hashlib

import pyarrow as pa
import pytest

from skein.llm import token_files, warc
from skein.llm._shared import open_fs, tokenizer_path, work_path

PAGES = [(5, "http://a/ b", "x" * 200), (2, None, "x" * 200), (7, "u", "short"), (8, "u", "short"), (9, "é", "ü\r\n\r\nWARC/1.1\r\n" * 50), (10, "n", None), (11, "e", ""), (None, "z", "x" * 200), (2, None, "x" * 200), (12, "long", "abc" * 3_000_000)]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, digest int")
    folder = work_path(spark, "warc")
    warc.write_archives(pages, folder)
    index = warc.read_index(spark, folder)
    got = warc.read_records(index, folder).collect()
    assert len(got) == len(PAGES)
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        first = min((p for p, _, h in PAGES if h == html and p is not None), default=None) if len(data) >= 100 else i
        kind = "response" if first == i else "revisit"
        want.append((i is None, i, len(data), hashlib.sha256(data).hexdigest(), kind, first if kind == "revisit" else None, kind == "revisit" or data))
    key = lambda x: (x[0], x[1] or 0)
    assert sorted(((r.page_id is None, r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.record_type == "revisit" or bytes(r.payload)) for r in got), key=key) == sorted(want, key=key)
    some = warc.read_records(index.where("page_id in (7, 9)"), folder).collect()
    assert sorted(r.page_id for r in some) == [7, 9]


def test_empty(spark):
    folder = work_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_records(warc.read_index(spark, folder), folder).count() == 0


def test_ranges_are_joined():
    reads = list(warc.coalesced(iter([("a", 0, 10), ("a", 10, 5), ("a", 40, 5), ("b", 0, 3)]), gap=10, most=100))
    assert reads == [("a", 0, 15, [(0, 10), (10, 5)]), ("a", 40, 45, [(40, 5)]), ("b", 0, 3, [(0, 3)])]


def test_paths_name_their_file_system(tmp_path):
    fs, at = open_fs(f"file:{tmp_path}")
    assert at == str(tmp_path) and open_fs(f"file://{tmp_path}")[1] == at and type(fs).__name__ == "LocalFileSystem"
    with pytest.raises(ValueError, match="names no file system"):
        open_fs("/data")


def test_another_file_system(spark, monkeypatch):
    """Files go through pyarrow's file system of the folder, here one that isn't the local one by type."""
    from pyarrow import fs

    folder = work_path(spark, "sub")
    other = fs.SubTreeFileSystem("/", fs.LocalFileSystem())
    with monkeypatch.context() as m:
        m.setattr(token_files, "open_fs", lambda uri: (other, uri.removeprefix("file:").lstrip("/")))
        batch = pa.record_batch({"key": pa.array([1, 2], pa.int64()), "content": ["a b", "c"]})
        m.setattr("pyspark.TaskContext.get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0, "attemptNumber": lambda self: 0})()))
        made = list(token_files._write(tokenizer_path("word_bpe_49k.json"), 1, folder)(iter([batch])))[0].to_pydict()
        rows = pa.record_batch({"name": made["name"], "n_docs": made["n_docs"], "base": [0], "width": made["width"]})
        got = [r for b in token_files._read(folder)(iter([rows])) for r in b.to_pylist()]
    assert [r["doc_id"] for r in got] == [1, 2] and sum(r["n_tokens"] for r in got) == made["n_ids"][0]
