"""The inbox stream: new, changed, touched, repeated, late and vanished files over restarts."""

import os
import time

import pytest

from evidex.sources.readers import form_feed_pages
from evidex.streaming.inbox import current, watch_inbox


def test_versions_over_restarts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    out, check = f"{tmp_path}/out", f"{tmp_path}/check"
    put = lambda name, text: (folder / name).write_text(text, encoding="utf-8")

    def look(**more):
        watch_inbox(spark, str(folder), out, check, **more).awaitTermination()
        return sorted((r.filename, r.version, r.gone) for r in spark.read.parquet(f"{out}/_versions").collect())

    rows = lambda: sorted(r.filename for r in spark.read.parquet(out).collect())
    put("a.pdf", "one")
    put("b.pdf", "two")
    put("c.txt", "no")
    want = [("a.pdf", 1, False), ("b.pdf", 1, False)]
    assert look() == want and rows() == ["a.pdf", "b.pdf"]
    # touched only
    os.utime(folder / "a.pdf", ns=(1, time.time_ns() + 10**9))
    assert look() == want
    # changed in place; a copy; a late file; an empty one
    put("b.pdf", "six")
    put("copy.pdf", "one")
    put("late.pdf", "past")
    put("none.pdf", "")
    os.utime(folder / "late.pdf", ns=(1, 1))
    want = sorted(want + [("b.pdf", 2, False), ("copy.pdf", 1, False), ("late.pdf", 1, False), ("none.pdf", 1, False)])
    assert look() == want and rows() == ["a.pdf", "b.pdf", "b.pdf", "late.pdf", "none.pdf"]
    # back to what it was: a version, no further entry
    put("b.pdf", "two")
    want = sorted(want + [("b.pdf", 3, False)])
    assert look() == want and len(rows()) == 5
    now = {r.filename: r for r in current(spark, out).collect()}
    assert {n: r.version for n, r in now.items()} == {"a.pdf": 1, "b.pdf": 3, "copy.pdf": 1, "late.pdf": 1, "none.pdf": 1}
    assert now["a.pdf"].content_hash == now["copy.pdf"].content_hash
    third = spark.read.parquet(f"{out}/_versions").where("filename = 'b.pdf' and version = 3").first()
    second = spark.read.parquet(f"{out}/_versions").where("filename = 'b.pdf' and version = 2").first()
    assert third.supersedes == second.content_hash
    with pytest.raises(FileNotFoundError):
        watch_inbox(spark, f"{tmp_path}/else", out, check)


def test_files_that_vanish_and_come_back(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pdf").write_text("one")
    (folder / "b.pdf").write_text("two")
    out = f"{tmp_path}/out"

    def look():
        watch_inbox(spark, str(folder), out, f"{tmp_path}/check", gone_after=1000, extract=lambda body: form_feed_pages(body)).awaitTermination()
        return {r.filename: r.version for r in current(spark, out).collect()}

    assert look() == {"a.pdf": 1, "b.pdf": 1}
    (folder / "a.pdf").rename(tmp_path / "kept")
    time.sleep(1.5)
    look()
    assert "a.pdf" not in look()
    (tmp_path / "kept").rename(folder / "a.pdf")
    assert look()["a.pdf"] == 3
    assert spark.read.parquet(out).count() == 2
