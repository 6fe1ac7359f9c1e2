"""Compare the PDF files of a folder: ``python -m simweave.cli FOLDER [REPORT_FOLDER]``."""

from __future__ import annotations

import glob
import os
import sys

from simweave.config import AnalysisConfig
from simweave.session import local_session
from simweave.sinks.report import export_report, totals
from simweave.tasks import Progress, TaskManager, create_task


def pdf_paths(where: str) -> list[str]:
    """The file itself, or the PDF files of a folder, sorted."""
    if os.path.isfile(where):
        return [where]
    return sorted(p for p in glob.glob(os.path.join(where, "*")) if p.lower().endswith(".pdf"))


def progress_line(p: Progress) -> str:
    left = "" if p.eta_seconds is None else f", {p.eta_seconds:.0f} s left"
    return f"[{p.percent:3d} %] {p.stage}: files {p.processed_files}/{p.total_files}, pages {p.processed_pages}, candidates {p.candidate_pairs}, pairs {p.confirmed_pairs}{left}"


def main(arguments: list[str]) -> int:
    if not arguments:
        print(__doc__)
        return 2
    paths = pdf_paths(arguments[0])
    if len(paths) < 2:
        print("at least two PDF files are needed")
        return 1
    config = AnalysisConfig.preset("balanced", paths=tuple(paths), analysis_depth="deep", candidate_top_k_per_file=36, max_matches_per_pair=60).validate()
    tasks = TaskManager()
    task = create_task(local_session(), config, tasks=tasks)
    end = tasks.wait(task, 24 * 3600, lambda p: print(progress_line(p), flush=True))
    if end.stage == "Failed":
        print(end.message)
        return 1
    report = tasks.result(task)
    for name, value in totals(report).items():
        print(f"{name}: {value}")
    for path in export_report(report, arguments[1] if len(arguments) > 1 else "."):
        print(path)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
