import json
import threading
import time
import zipfile
import zlib

import numpy as np
import pytest

from simweave.config import AnalysisConfig
from simweave.sinks.report import export_report, sanitized
from simweave.sources.jpeg import luma
from simweave.sources.pdf import cid_fingerprint, extract, perceptual_hash, scan_pdfs
from simweave.tasks import Progress, TaskManager, analyze_files, create_task, eta


def pdf(content: bytes = b"", resources: str = "<<>>", extra: tuple[bytes, ...] = (), compress: bool = True) -> bytes:
    body = zlib.compress(content) if compress else content
    kind = "/Filter /FlateDecode" if compress else ""
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        f"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources {resources} >>".encode(),
        f"<< /Length {len(body)} {kind} >>\nstream\n".encode() + body + b"\nendstream",
        *extra,
    ]
    out = b"%PDF-1.5\n"
    for i, o in enumerate(objects, 1):
        out += f"{i} 0 obj\n".encode() + o + b"\nendobj\n"
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


def image_object(width: int, height: int, pixels: bytes, space: str = "DeviceGray") -> bytes:
    data = zlib.compress(pixels)
    head = f"<< /Subtype /Image /Width {width} /Height {height} /BitsPerComponent 8 /ColorSpace /{space} /Filter /FlateDecode /Length {len(data)} >>\nstream\n"
    return head.encode() + data + b"\nendstream"


def image_pdf() -> bytes:
    pixels = bytes(i % 255 for i in range(400 * 300))
    return pdf(b"q /Im0 Do Q", "<< /XObject << /Im0 5 0 R >> >>", (image_object(400, 300, pixels),))


def test_text_and_escapes():
    found = extract(pdf(rb"BT /F1 12 Tf (Hello \(world\)\041) Tj 0 -14 Td [(Sec) 20 (ond) -300 (line)] TJ ET", "<< /Font << /F1 << /Subtype /Type1 >> >> >>"))
    assert found.pages == ["Hello (world)!\nSecond line\n"] and found.error is None


def test_to_unicode():
    cmap = b"2 beginbfchar <0001> <0041> <0002> <6DF1> endbfchar 1 beginbfrange <0003> <0004> <0062> endbfrange"
    stream = f"<< /Length {len(cmap)} >>\nstream\n".encode() + cmap + b"\nendstream"
    found = extract(pdf(b"BT /F1 9 Tf <0001000200030004> Tj ET", "<< /Font << /F1 << /Subtype /Type0 /Encoding /Identity-H /ToUnicode 5 0 R >> >> >>", (stream,)))
    assert found.pages == ["A深bc\n"]


def test_glyph_numbers_without_map():
    found = extract(pdf(b"BT /F1 9 Tf <0ac50753> Tj ET", "<< /Font << /F1 << /Subtype /Type0 /Encoding /Identity-H >> >> >>"))
    assert found.pages == ["\U000f0ac5\U000f0753\n"] and found.glyph_fallback
    assert cid_fingerprint(bytes.fromhex("0ac507")) == "\U000f0ac5\U000f0007"


@pytest.mark.parametrize("data", [b"", b"no pdf", b"%PDF-1.4\n", b"%PDF-1.4\n1 0 obj << >> endobj"])
def test_broken_files_have_an_error(data):
    assert extract(data).error


def test_images_through_forms_and_sizes():
    small, good = image_object(47, 200, bytes(47 * 200)), image_object(64, 64, bytes(i % 255 for i in range(4096)))
    form = b"<< /Subtype /Form /Resources << /XObject << /A 6 0 R /B 7 0 R >> >> /Length 0 >>\nstream\n\nendstream"
    found = extract(pdf(b"", "<< /XObject << /F 5 0 R /G 5 0 R >> >>", (form, small, good)))
    assert found.found_images == 2 and [i["width"] for i in found.images] == [64]
    assert found.images[0]["phash"] is not None and found.images[0]["page"] == 1


def test_jpeg_keeps_its_content_hash():
    # no image that can be decoded
    image = b"<< /Subtype /Image /Width 64 /Height 64 /ColorSpace /DeviceRGB /Filter /DCTDecode /Length 4 >>\nstream\nJPEG\nendstream"
    found = extract(pdf(b"", "<< /XObject << /I 5 0 R >> >>", (image,)))
    assert found.images[0]["phash"] is None and len(found.images[0]["sha256"]) == 64
    assert any("decoded" in w for w in found.warnings)


def jpeg(planes: list[np.ndarray], restart: int = 0, adobe: int | None = None) -> bytes:
    """A baseline image with codes of fixed length; planes smaller than the first are of half its size each way."""
    height, width = planes[0].shape
    factor = 2 if len(planes) > 1 and planes[1].shape != planes[0].shape else 1
    k, n = np.arange(8)[:, None], np.arange(8)
    basis = np.cos((2 * n + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    order = [(r, s - r) if s % 2 else (s - r, r) for s in range(15) for r in range(max(0, s - 7), min(s, 7) + 1)]
    symbols = [0x00, 0xF0, *(r << 4 | b for r in range(16) for b in range(1, 11))]
    out, bits = b"", ""

    def flush() -> None:
        nonlocal out, bits
        bits += "1" * (-len(bits) % 8)
        out += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
        bits = ""

    def number(v: int) -> str:
        size = abs(v).bit_length()
        return format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    padded = []
    for p in planes:
        f = factor if p.shape == planes[0].shape else 1
        padded.append((np.pad(p, ((0, -p.shape[0] % (8 * f)), (0, -p.shape[1] % (8 * f))), mode="edge").astype(float) - 128, f))
    across, down = padded[0][0].shape[1] // (8 * factor), padded[0][0].shape[0] // (8 * factor)
    last, units = [0] * len(planes), 0
    for y in range(down):
        for x in range(across):
            if restart and units and units % restart == 0:
                flush()
                out += bytes([0xFF, 0xD0 + (units // restart - 1) % 8])
                last = [0] * len(planes)
            units += 1
            for i, (p, f) in enumerate(padded):
                for row in range(f):
                    for column in range(f):
                        top, left = (y * f + row) * 8, (x * f + column) * 8
                        c = np.round(basis @ p[top : top + 8, left : left + 8] @ basis.T).astype(int)
                        flat = [int(c[a]) for a in order]
                        d, last[i] = flat[0] - last[i], flat[0]
                        bits += format(abs(d).bit_length(), "04b") + number(d)
                        run = 0
                        for v in flat[1:]:
                            if not v:
                                run += 1
                                continue
                            while run > 15:
                                bits += format(symbols.index(0xF0), "08b")
                                run -= 16
                            bits += format(symbols.index(run << 4 | abs(v).bit_length()), "08b") + number(v)
                            run = 0
                        if run:
                            bits += format(0, "08b")
    flush()

    def part(marker: int, body: bytes) -> bytes:
        return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body

    head = b"\xff\xd8" + (part(0xEE, b"Adobe\x00\x64\x00\x00\x00\x00" + bytes([adobe])) if adobe is not None else b"")
    head += part(0xDB, b"\x00" + b"\x01" * 64)
    sampling = [f << 4 | f for _, f in padded]
    head += part(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(planes)]) + b"".join(bytes([i + 1, s, 0]) for i, s in enumerate(sampling)))
    head += part(0xC4, b"\x00" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12)))
    head += part(0xC4, b"\x10" + bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols))
    if restart:
        head += part(0xDD, restart.to_bytes(2, "big"))
    head += part(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, 0]) for i in range(len(planes))) + b"\x00\x3f\x00")
    return head + out + b"\xff\xd9"


def _picture(height: int, width: int, shift: float = 0.0) -> np.ndarray:
    y, x = np.mgrid[:height, :width]
    return np.clip(np.round(128 + 60 * np.sin(x / 9 + shift) + 50 * np.cos(y / 13 + shift)), 0, 255)


@pytest.mark.parametrize("restart", [0, 3])
def test_gray_jpeg(restart):
    wanted = _picture(61, 83)
    assert np.abs(luma(jpeg([wanted], restart)) - wanted).max() <= 3


def test_colour_jpeg():
    y, b, r = _picture(64, 80), _picture(32, 40, 1.0), _picture(32, 40, 2.0)
    found = luma(jpeg([y, b, r]))
    big = lambda p: np.repeat(np.repeat(p, 2, axis=0), 2, axis=1) - 128
    red, green, blue = (np.clip(c, 0, 255) for c in (y + 1.402 * big(r), y - 0.344136 * big(b) - 0.714136 * big(r), y + 1.772 * big(b)))
    assert np.abs(found - (0.299 * red + 0.587 * green + 0.114 * blue)).max() <= 6
    plain = luma(jpeg([y, y, y], adobe=0))
    assert np.abs(plain - y).max() <= 4
    inks = luma(jpeg([255 - y, 255 - y, 255 - y, np.full(y.shape, 255.0)], adobe=0))
    assert np.abs(inks - (255 - y)).max() <= 4


@pytest.mark.parametrize("damage", [lambda d: d[:40], lambda d: d[: len(d) // 2], lambda d: d.replace(b"\xff\xc0", b"\xff\xc2"), lambda d: b"", lambda d: b"\xff\xd8" + b"\xff" * 50])
def test_damaged_jpeg_is_no_crash(damage):
    body = damage(jpeg([_picture(64, 64)]))
    image = f"<< /Subtype /Image /Width 64 /Height 64 /ColorSpace /DeviceGray /Filter /DCTDecode /Length {len(body)} >>\nstream\n".encode() + body + b"\nendstream"
    found = extract(pdf(b"", "<< /XObject << /I 5 0 R >> >>", (image,)))
    assert len(found.images) == 1 and found.error is None


def test_jpeg_and_plain_pixels_look_the_same():
    random = np.random.default_rng(3)
    shown = np.clip(np.kron(random.integers(20, 235, (8, 8)), np.ones((12, 16))) * 0.5 + _picture(96, 128) * 0.5, 0, 255)
    body = jpeg([shown])
    packed = f"<< /Subtype /Image /Width 128 /Height 96 /ColorSpace /DeviceGray /Filter /DCTDecode /Length {len(body)} >>\nstream\n".encode() + body + b"\nendstream"
    found = extract(pdf(b"", "<< /XObject << /A 5 0 R /B 6 0 R >> >>", (packed, image_object(128, 96, shown.astype(np.uint8).tobytes()))))
    one, other = (i["phash"] for i in found.images)
    assert one is not None and ((one ^ other) & (2**64 - 1)).bit_count() <= 2


@pytest.mark.parametrize("width", ["(x)", "/Big", "[1 2]", "-5", "99999999999", "null"])
def test_malformed_image_is_no_crash(width):
    image = f"<< /Subtype /Image /Width {width} /Height 64 /ColorSpace /DeviceGray /Length 4 >>\nstream\nabcd\nendstream".encode()
    found = extract(pdf(b"BT (text) Tj ET", "<< /Font << >> /XObject << /I 5 0 R >> >>", (image,)))
    assert found.error is None and found.found_images == 1 and found.images == []


@pytest.mark.parametrize("resources", ["<< /XObject [1 2] >>", "<< /XObject << /I (no) >> >>", "(none)", "<< /Font 7 /XObject 8 >>"])
def test_malformed_page_is_a_row(resources):
    found = extract(pdf(b"BT /F1 12 Tf (text) Tj ET", resources))
    assert len(found.pages) == 1 and found.error is None


def test_perceptual_hash_survives_resizing():
    grid = lambda n: np.fromfunction(lambda y, x: (3 * (x * 64 // n) + 5 * (y * 64 // n)) % 255, (n, n))
    assert ((perceptual_hash(grid(64)) ^ perceptual_hash(grid(96))) & (2**64 - 1)).bit_count() <= 4


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where = tmp_path_factory.mktemp("pdfs")
    for name in ("a.pdf", "b.PDF"):
        (where / name).write_bytes(image_pdf())
    (where / "broken.pdf").write_bytes(b"nothing")
    (where / "notes.txt").write_text("no")
    return where


def test_scan(spark, folder):
    files, pages, images = scan_pdfs(spark, str(folder))
    assert files.count() == 3 and files.where("error IS NOT NULL").count() == 1
    assert pages.count() == 2 and images.count() == 2


def test_image_files_end_to_end(spark, folder, tmp_path):
    tasks = TaskManager()
    tasks.create("task-1")
    config = AnalysisConfig(paths=tuple(str(p) for p in sorted(folder.glob("*.[pP][dD][fF]"))))
    report = analyze_files(spark, config, "task-1", str(tmp_path), tasks)
    assert sorted(f["status"] for f in report["files"]) == ["failed", "image-only", "image-only"]
    (pair,), (group,) = report["pairs"], report["groups"]
    assert pair["image_score"] == pair["final_score"] == 1.0 and pair["matched_texts"] == []
    assert len(group["file_ids"]) == 2 and group["representative_evidence"][0]["evidence_type"] == "text-and-image"
    word, plain = export_report(report, str(tmp_path / "out"))
    assert str(folder) not in open(plain, encoding="utf-8").read()
    assert json.load(open(report["report_path"], encoding="utf-8"))["report_path"] is None
    with zipfile.ZipFile(word) as z:
        assert "styles.xml" in z.read("word/_rels/document.xml.rels").decode()
        assert "a.pdf" in z.read("word/document.xml").decode()
    with pytest.raises(ValueError):
        export_report(report, str(tmp_path), docx=False, as_json=False)
    assert sanitized(report)["settings"]["paths"] == ["a.pdf", "b.PDF", "broken.pdf"]


def test_background_task(spark, folder):
    tasks = TaskManager()
    task = create_task(spark, AnalysisConfig(paths=(str(folder / "a.pdf"), str(folder / "b.PDF"))), tasks=tasks)
    for _ in range(600):
        if tasks.progress(task).stage in ("Done", "Failed"):
            break
        time.sleep(0.2)
    assert tasks.progress(task).stage == "Done" and tasks.progress(task).percent == 100
    assert tasks.progress(task).confirmed_pairs == 1 and len(tasks.result(task)["pairs"]) == 1


def test_cancelled_task_stops(spark, folder, monkeypatch, tmp_path):
    from simweave.plans.pipeline import Analysis

    tasks, begun = TaskManager(), threading.Event()
    config = AnalysisConfig(paths=(str(folder / "a.pdf"), str(folder / "b.PDF")))

    def endless(self):
        begun.set()
        self.pages.rdd.map(lambda r: time.sleep(60)).count()

    monkeypatch.setattr(Analysis, "candidates", property(endless))
    task = create_task(spark, config, str(tmp_path), tasks=tasks)
    assert begun.wait(60)
    time.sleep(1)
    asked = time.monotonic()
    tasks.cancel(task)
    seen = []
    assert tasks.wait(task, 30, seen.append, 0.2).stage == "Cancelled" and time.monotonic() - asked < 25
    result = tasks.result(task)
    assert len(result["files"]) == 2 and result["pairs"] == [] and seen[-1].processed_files == 2 and seen[-1].indexed_images == 2


def test_tables_of_a_task(spark, folder, tmp_path):
    tasks = TaskManager()
    tasks.create("t")
    config = AnalysisConfig(paths=(str(folder / "a.pdf"), str(folder / "b.PDF")))
    analyze_files(spark, config, "t", tasks=tasks, tables=str(tmp_path / "tables"))
    assert {n: spark.read.parquet(str(tmp_path / "tables" / n)).count() for n in ("files", "pairs", "members", "groups")} == {"files": 2, "pairs": 1, "members": 2, "groups": 1}
    assert tasks.progress("t").indexed_images == 2


def test_registry():
    tasks = TaskManager()
    for i in range(23):
        tasks.create(f"t{i}")
    tasks.create("active")
    tasks.update("active", stage="ComparingText")
    for i in range(23):
        tasks.finish(f"t{i}", {})
    assert len(tasks) == 21 and tasks.progress("active").stage == "ComparingText"
    assert tasks.is_cancelled("unknown") and not tasks.is_cancelled("active")
    tasks.cancel("active")
    assert tasks.is_cancelled("active")
    with pytest.raises(KeyError):
        tasks.progress("unknown")


def test_progress():
    assert Progress().percent == 0 and Progress(stage="Done").percent == 100
    assert Progress(stage="ComparingText", total_files=2, processed_files=2).percent == 94
    assert eta(10, 20, 5.0) == 5.0 and eta(0, 20, 5.0) is None and eta(20, 20, 5.0) is None


def test_watched_folder(spark, folder, tmp_path):
    from simweave.streaming.watch import watch_pdfs

    for _ in range(2):
        query = watch_pdfs(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state"), once=True)
        query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/files")).count() == 3
    assert spark.read.parquet(str(tmp_path / "out/images")).count() == 2
