"""A made corpus with its truth, from a seed: work sessions of files with set times, near copies, labelled dates and queries."""

from __future__ import annotations

import datetime as dt
import json
import os
import random
from dataclasses import asdict, dataclass, field

SUBJECTS = ("graphs", "networks", "optics", "statistics", "robotics", "poetry", "geology", "finance")
KINDS = ("exam", "project", "hackathon", "career", "meeting")
ENDINGS = (".md", ".txt", ".py", ".csv")


@dataclass
class MadeFile:
    path: str
    content: str
    mtime: str
    session: str | None
    dates: list[dict] = field(default_factory=list)
    near_duplicate_of: str | None = None


def _sentence(rng: random.Random, subject: str) -> str:
    return f"{rng.choice(('We', 'They', 'Both groups', 'The notes'))} {rng.choice(('compare', 'explain', 'collect', 'test'))} {subject} with {rng.choice(('new', 'old', 'simple', 'careful'))} {rng.choice(('methods', 'figures', 'examples', 'tables'))} {rng.randrange(100)}."


def _content(rng: random.Random, subject: str, kind: str, due: dt.date, ending: str) -> tuple[str, list[dict]]:
    body = [_sentence(rng, subject) for _ in range(rng.randrange(4, 9))]
    year = rng.randrange(1950, 2000)
    said = [f"The {kind} submission is due on {due:%d-%m-%Y}.", f"Published in {year}."]
    dates = [{"date": due.isoformat(), "kind": "meaningful", "surface": f"{due:%d-%m-%Y}"}, {"date": f"{year}-01-01", "kind": "incidental", "surface": str(year)}]
    if ending == ".csv":
        return "topic,note\n" + "\n".join(f"{subject},{x[:-1]}" for x in body) + f"\ndue,{due:%d-%m-%Y}\n", dates[:1]
    if ending == ".py":
        return "\n".join([f"# {x}" for x in [*body, said[0]]] + [f"{subject} = {rng.randrange(1000)}", ""]), dates[:1]
    return (f"# {subject.title()} {kind}\n\n" if ending == ".md" else "") + "\n\n".join([*body, *said]) + "\n", dates


def make(seed: int = 11, sessions: int = 5, files: int = 7, loose: int = 5, start: dt.datetime = dt.datetime(2025, 3, 3, 9)) -> tuple[list[MadeFile], list[dict]]:
    """(files, queries): `sessions` bursts of `files` files three weeks apart, `loose` files far from all, a near copy in every second session."""
    rng = random.Random(seed)
    made: list[MadeFile] = []
    queries: list[dict] = []
    for s in range(sessions):
        subject, kind, began = SUBJECTS[s % len(SUBJECTS)], KINDS[s % len(KINDS)], start + dt.timedelta(days=21 * s)
        own = []
        for f in range(files):
            ending, due = ENDINGS[f % len(ENDINGS)], (began + dt.timedelta(days=5 + f)).date()
            content, dates = _content(rng, subject, kind, due, ending)
            own.append(MadeFile(f"{kind}/{subject}/part{f}{ending}", content, (began + dt.timedelta(hours=3 * f)).isoformat(), f"s{s}", dates))
        if s % 2 == 0:
            first = own[0]
            own[1] = MadeFile(f"{kind}/{subject}/part1-copy.md", first.content + "\nOne more line at the end.\n", own[1].mtime, f"s{s}", first.dates, first.path)
        made += own
        targets = [f.path for f in own]
        queries.append({"id": f"q{s}", "text": f"{subject} {kind}", "targets": targets[:1], "relevant": targets, "kind": "semantic", "difficulty": "easy"})
        queries.append({"id": f"t{s}", "text": f"what was due in {began:%B %Y}", "targets": targets[:1], "relevant": targets, "kind": "temporal", "difficulty": "hard"})
    for x in range(loose):
        content, dates = _content(rng, SUBJECTS[-1 - x % 3], "reading", dt.date(2024, 1 + x % 12, 9), ".txt")
        made.append(MadeFile(f"loose/{x}.txt", content, (start - dt.timedelta(days=100 * (x + 1))).isoformat(), None, dates))
    return made, queries


def write(root: str, seed: int = 11, **how) -> dict:
    """Files below root with their times, and the truth, which is also written beside root as <root>.truth.json."""
    files, queries = make(seed, **how)
    for f in files:
        path = os.path.join(root, f.path)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as out:
            out.write(f.content)
        at = dt.datetime.fromisoformat(f.mtime).replace(tzinfo=dt.timezone.utc).timestamp()
        os.utime(path, (at, at))
    truth = {
        "schema_version": 1, "seed": seed, "counts": {"files": len(files), "queries": len(queries)}, "sessions": sorted({f.session for f in files if f.session}),
        "files": [{k: v for k, v in asdict(f).items() if k != "content"} for f in files], "near_duplicate_pairs": [[f.near_duplicate_of, f.path] for f in files if f.near_duplicate_of],
        "unsessioned_files": [f.path for f in files if f.session is None], "queries": queries,
    }
    with open(root.rstrip("/") + ".truth.json", "w", encoding="utf-8") as out:
        json.dump(truth, out, indent=1)
    return truth
