"""Many small PDF files: shared frames, rows dealt out before they become files."""

import docs
import pandas as pd

from quire.queries import _files
from quire.sources import pdf, samples


def test_small_pdf_files_share_frames():
    made = [samples.pdf(f"name {n}", "body", []) for n in range(3000)] + [docs.report(), b"no", docs.pdf()]
    frames = list(pdf._rows(iter([pd.DataFrame({"path": [f"/in/{n}.pdf" for n in range(len(made))], "content": made})])))
    assert len(frames) <= 4 and max(map(len, frames)) <= pdf.FRAME_ROWS
    every = pd.concat(frames)
    assert list(every["path"].drop_duplicates()) == [f"/in/{n}.pdf" for n in range(len(made))]
    assert (every["path"] == "/in/7.pdf").sum() == 3 and every["error"].notna().sum() == 1


def test_frames_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(pdf, "FRAME_BYTES", 10)
    frames = list(pdf._rows(iter([pd.DataFrame({"path": ["/in/a.pdf"], "content": [samples.pdf("a name of some length", "body of some length", [])]})])))
    assert [len(f) for f in frames] == [2, 1]


def test_rows_are_dealt_before_files_are_made(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert _files(spark, "/root/testdata/sf0.001", "pdf").rdd.getNumPartitions() == n
