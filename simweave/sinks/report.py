"""Reports of an analysis: JSON and Word, and tables for results too large for one document.

``collect_report`` brings the confirmed pairs and groups to the driver, as a report for a
reader does; ``write_tables`` writes them as Parquet from the executors instead.
"""

from __future__ import annotations

import json
import os
import zipfile
from dataclasses import asdict
from datetime import datetime, timezone
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simweave.functions.text import file_name, level, status
from simweave.plans.pipeline import Analysis

EVIDENCE_ROWS = 5  # of each kind and pair in the Word report
_QUOTES = {'"': "&quot;", "'": "&apos;"}
#: The notice that begins the warnings of every report.
NOTICE = "Pages are compared by their text layer and embedded images; scanned text is not recognised."


def file_table(analysis: Analysis, files: DataFrame) -> DataFrame:
    """Summaries with name, images, status and error of each file."""
    rows = analysis.summaries.join(files.drop("page_count"), "file")
    state = F.when(F.col("error").isNotNull(), "failed").otherwise(status(F.col("total_text_chars"), F.col("image_count"), F.col("glyph_fallback")))
    return rows.select(
        F.col("file").alias("id"), F.col("file").alias("path"), file_name(F.col("file")).alias("file_name"), "page_count", "total_text_chars", "chunk_count",
        "image_count", "indexed_image_count", state.alias("status"), "error", "warnings",
    )


#: Files and pairs that a report for a reader is made of at most; larger results are tables.
MAX_REPORT_ROWS = 200_000


def unread_table(files: DataFrame) -> DataFrame:
    """The file table of an analysis that was cancelled before its pages were compared."""
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("page_count", "total_text_chars", "chunk_count")]
    state = F.when(F.col("error").isNotNull(), "failed").otherwise("ready")
    return files.select(F.col("file").alias("id"), F.col("file").alias("path"), file_name(F.col("file")).alias("file_name"), *zero, "image_count", "indexed_image_count", state.alias("status"), "error", "warnings")


def collect_report(analysis: Analysis, files: DataFrame, task_id: str, started_at: str | None = None, done_only: bool = False, most: int = MAX_REPORT_ROWS) -> dict:
    """The whole result as plain values, best pairs and groups first.

    ``done_only`` leaves out what hasn't been computed, so that a cancelled analysis computes
    nothing more. A result of more than ``most`` files or pairs is an error: it belongs into tables.
    """
    has = lambda stage: not done_only or stage in analysis.__dict__
    n = max(files.count(), analysis.pairs.count() if has("pairs") else 0)
    if n > most:
        raise ValueError(f"{n} rows are too many for a report; see write_tables")
    table = file_table(analysis, files) if has("chunks") else unread_table(files)
    rows = [r.asDict(recursive=True) for r in table.orderBy("id").collect()]
    warnings = [NOTICE] + [f"{r['file_name']}: {w}" for r in rows for w in r.pop("warnings") or []]
    names = {r["id"]: r["file_name"] for r in rows}
    pairs = [r.asDict(recursive=True) for r in analysis.pairs.orderBy(F.desc("final_score"), "lf", "rf").collect()] if has("pairs") else []
    for p in pairs:
        p |= {"left_file_id": p.pop("lf"), "right_file_id": p.pop("rf")}
        p |= {"left_file": names.get(p["left_file_id"], ""), "right_file": names.get(p["right_file_id"], "")}
        p["matched_texts"], p["matched_images"] = p["matched_texts"] or [], p["matched_images"] or []
    by_root: dict[str, list] = {}
    strong = {r["pair_id"]: r["root"] for r in analysis.relations.select("pair_id", "root").collect()} if has("relations") else {}
    scores = ("text_score", "image_score", "page_image_score", "final_score")
    for p in pairs:
        if p["pair_id"] in strong:
            by_root.setdefault(strong[p["pair_id"]], []).append({k: p[k] for k in ("left_file_id", "right_file_id", "left_file", "right_file", *scores)})
    groups = [r.asDict(recursive=True) for r in analysis.groups.orderBy(F.desc("group_score"), "group_id").collect()] if has("relations") else []
    for g in groups:
        g["files"] = [names.get(f, "") for f in g["file_ids"]]
        g["pair_relations"] = by_root.get(g.pop("root"), [])
        g["representative_evidence"] = [{"evidence_type": g.pop("evidence_type"), "summary": f"{len(g['pair_relations'])} similar pairs among {len(g['file_ids'])} files"}]
    return {
        "task_id": task_id,
        "started_at": started_at or datetime.now(timezone.utc).isoformat(),
        "finished_at": datetime.now(timezone.utc).isoformat(),
        "settings": asdict(analysis.config),
        "files": rows,
        "pairs": pairs,
        "groups": groups,
        "warnings": warnings,
        "report_path": None,
    }


def sanitized(report: dict) -> dict:
    """Without folders: paths as base names, and no path of the report."""
    base = lambda p: p.replace("\\", "/").rsplit("/", 1)[-1]
    ids = {f["id"]: base(f["id"]) for f in report["files"]}

    def bare(value):
        if isinstance(value, dict):
            return {k: bare(v) for k, v in value.items()}
        if isinstance(value, (list, tuple)):
            return [bare(v) for v in value]
        return ids.get(value, value) if isinstance(value, str) else value

    out = bare(report)
    out["settings"]["paths"] = [base(p) for p in report["settings"]["paths"]]
    for f in out["files"]:
        f["path"] = base(f["path"])
    for p in out["pairs"]:
        p["pair_id"] = f"pair-{p['left_file_id']}-{p['right_file_id']}"
    for g in out["groups"]:
        g["group_id"] = "group-" + base(g["group_id"].removeprefix("group-"))
    return out | {"report_path": None}


def write_report(report: dict, directory: str) -> str:
    """The JSON report, made with every run."""
    return _write_json(report, os.path.join(directory, f"report_{report['task_id']}.json"))


def _write_json(report: dict, path: str) -> str:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(sanitized(report), f, ensure_ascii=False, indent=2)
    return path


def export_report(report: dict, directory: str, docx: bool = True, as_json: bool = True, include_text_evidence: bool = True) -> list[str]:
    """The files written, Word first. Leaving evidence out concerns Word only."""
    if not (docx or as_json):
        raise ValueError("choose at least one format")
    base = os.path.join(directory, f"similarity_report_{report['task_id'][:8]}")
    out = []
    if docx:
        out.append(write_word(report, base + ".docx", include_text_evidence))
    if as_json:
        out.append(_write_json(report, base + ".json"))
    return out


def totals(report: dict) -> dict[str, int]:
    """The figures of the summary; a file without text or images counts as failed."""
    ready = sum(f["status"] in ("ready", "cid-fallback", "image-only") for f in report["files"])
    return {
        "files": len(report["files"]),
        "ready files": ready,
        "failed files": len(report["files"]) - ready,
        "pairs": len(report["pairs"]),
        "groups": len(report["groups"]),
        "equal pages": sum(p["exact_page_match_count"] for p in report["pairs"]),
        "similar passages": sum(p["approximate_text_match_count"] for p in report["pairs"]),
        "matched images": sum(len(p["matched_images"]) for p in report["pairs"]),
    }


def _paragraph(text: str, style: str | None = None) -> str:
    mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f'<w:p>{mark}<w:r><w:t xml:space="preserve">{escape(text, _QUOTES)}</w:t></w:r></w:p>'


def _table(rows: list[list]) -> str:
    cells = lambda row: "".join(f"<w:tc>{_paragraph(str(c))}</w:tc>" for c in row)
    border = "".join(f'<w:{s} w:val="single" w:sz="4"/>' for s in ("top", "left", "bottom", "right", "insideH", "insideV"))
    return f"<w:tbl><w:tblPr><w:tblBorders>{border}</w:tblBorders></w:tblPr>{''.join(f'<w:tr>{cells(r)}</w:tr>' for r in rows)}</w:tbl>"


def word_document(report: dict, include_text_evidence: bool = True) -> str:
    """The body: summary, parameters, groups with their relations, evidence of the pairs, warnings."""
    percent = lambda x: f"{x * 100:.1f}%"
    clean = sanitized(report)
    parts = [_paragraph("Similarity report", "Title"), _paragraph(NOTICE), _paragraph("1. Summary", "Heading1"), _table([[k, v] for k, v in totals(report).items()])]
    parts += [_paragraph("2. Parameters", "Heading1"), _table([[k, v] for k, v in clean["settings"].items() if k != "paths"])]
    parts.append(_paragraph("3. Groups", "Heading1"))
    for g in clean["groups"]:
        parts.append(_paragraph(f"{g['group_id']}: {', '.join(g['files'])} ({g['level']}, {percent(g['group_score'])}, density {g['graph_density']:.2f})", "Heading2"))
        if g["quality_flags"]:
            parts.append(_paragraph(", ".join(g["quality_flags"])))
        parts.append(_table([["left", "right", "text", "images", "final"]] + [[r["left_file"], r["right_file"], *(percent(r[k]) for k in ("text_score", "image_score", "final_score"))] for r in g["pair_relations"]]))
    parts.append(_paragraph("4. Evidence", "Heading1"))
    for p in clean["pairs"]:
        parts.append(_paragraph(f"{p['left_file']} / {p['right_file']}: {percent(p['final_score'])} ({p['level']})", "Heading2"))
        if include_text_evidence and p["matched_texts"]:
            parts.append(_table([["pages", "similarity", "left", "right"]] + [[f"{m['left_page']} / {m['right_page']}", percent(m["similarity"]), m["left_text"], m["right_text"]] for m in p["matched_texts"][:EVIDENCE_ROWS]]))
        if p["matched_images"]:
            parts.append(_table([["pages", "similarity", "equal", "size"]] + [[f"{m['left_page']} / {m['right_page']}", percent(m["similarity"]), m["exact"], f"{m['width']} x {m['height']}"] for m in p["matched_images"][:EVIDENCE_ROWS]]))
    if clean["warnings"]:
        parts += [_paragraph("5. Warnings", "Heading1"), *map(_paragraph, clean["warnings"])]
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{_W}"><w:body>{"".join(parts)}<w:sectPr/></w:body></w:document>'


# The names of the document format.
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_REL = "http://schemas.openxmlformats.org/package/2006/relationships"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_TYPES = "application/vnd.openxmlformats-officedocument.wordprocessingml"


def write_word(report: dict, path: str, include_text_evidence: bool = True) -> str:
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    styles = "".join(
        f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{n}"/><w:rPr><w:b/><w:sz w:val="{s}"/></w:rPr></w:style>'
        for i, n, s in (("Title", "Title", 40), ("Heading1", "heading 1", 30), ("Heading2", "heading 2", 24))
    )
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{_TYPES}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{_TYPES}.styles+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{_REL}"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": f'{head}<Relationships xmlns="{_REL}"><Relationship Id="rId1" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>',
        "word/styles.xml": f'{head}<w:styles xmlns:w="{_W}">{styles}</w:styles>',
        "word/document.xml": word_document(report, include_text_evidence),
    }
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return path


def write_tables(analysis: Analysis, directory: str, files: DataFrame | None = None) -> None:
    """Files, pairs, relations, members and groups as Parquet, without the driver."""
    tables = {name: getattr(analysis, name) for name in ("pairs", "relations", "members", "groups")}
    if files is not None:
        tables["files"] = file_table(analysis, files)
    for name, df in tables.items():
        void = [c for c, t in df.dtypes if t == "void"]
        df.drop(*void).write.mode("overwrite").parquet(f"{directory}/{name}")


__all__ = ["collect_report", "export_report", "file_table", "level", "sanitized", "totals", "write_report", "write_tables", "write_word"]
