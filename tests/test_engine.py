"""The whole engine over a small tree: index, ask, change a file, index again."""

import datetime as dt
import os

from lodestar.engine import Engine

TODAY = dt.date(2025, 11, 20)


def put(root, name, body, days):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(body)
    t = dt.datetime(2025, 11, 1, 12).timestamp() + days * 86_400
    os.utime(p, (t, t))


def test_engine(spark, tmp_path):
    root = tmp_path / "corpus"
    put(root, "study/exam/plan.md", "# Exam timetable\n\nThe exam is on 24-11-2025 with Ann Lee of Stone University.\n", 0)
    put(root, "study/exam/notes.md", "Revision notes for the exam on 24 Nov. Ann Lee of Stone University explains graphs.\n", 1)
    put(root, "home/garden.txt", "Tomatoes grow slowly. Published in 1999.\n", -200)
    e = Engine(spark, str(tmp_path / "data"))
    assert e.index(str(root)).where("change = 'new'").count() == 3
    assert e.stats()["files"] == 3 and e.stats()["documents"] == 3
    hits = e.query(["exam plan in November 2025"], TODAY).orderBy("rank").collect()
    paths = [h.path for h in hits]
    assert set(paths[:2]) == {"study/exam/plan.md", "study/exam/notes.md"} and all(h.complete for h in hits)
    assert [r.path for r in e.timeline("November", TODAY).collect()] == ["study/exam/notes.md", "study/exam/plan.md"]
    assert e.tags().count() > 0 and e.projects(TODAY).count() >= 1
    put(root, "home/garden.txt", "Tomatoes grow quickly now and need water every day.\n", 3)
    (root / "study/exam/notes.md").unlink()
    d = {r.path: r.change for r in e.index(str(root), dry_run=True).collect()}
    assert d == {"home/garden.txt": "modified", "study/exam/notes.md": "deleted", "study/exam/plan.md": "unchanged"}
    e.index(str(root))
    assert e.stats()["documents"] == 2
    assert "quickly" in e.table("documents").where("path = 'home/garden.txt'").first().text
