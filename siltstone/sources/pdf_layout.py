"""From positioned text to lines and tables of a PDF page, and files as frames of pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pdf import File, Page, Span

#: In sizes of the text: a gap that is a space, one between columns, a move that is another line, one that is another paragraph.
SPACE, COLUMN, LINE, PARAGRAPH = 0.18, 1.5, 0.5, 1.9
#: Units of a point within which rulings and columns are one.
NEAR = 3.0
#: Rows and columns of a table without rulings at least, characters of its cells at most.
ROWS, COLUMNS, CELL = 3, 2, 40


def joined(spans: list[Span]) -> str:
    """Spans of a line, spaces put in where there are gaps."""
    out = ""
    for before, s in zip([None, *spans], spans, strict=False):
        if before and s.x - before.end > SPACE * s.size and not out.endswith(" ") and not s.text.startswith(" "):
            out += " "
        out += s.text
    return out


def lines(spans: list[Span]) -> list[list[Span]]:
    """Spans in stream order, cut where the baseline moves or the text goes back."""
    out: list[list[Span]] = []
    for s in spans:
        last = out[-1][-1] if out else None
        if last and abs(s.y - last.y) < LINE * max(s.size, last.size) and s.x >= last.end - max(s.size, last.size):
            out[-1].append(s)
        else:
            out.append([s])
    return out


def page_text(spans: list[Span]) -> str:
    """Lines in stream order; an empty line where a paragraph or column begins."""
    out, before = [], None
    for row in lines(spans):
        text = joined(row).strip()
        if not text:
            continue
        drop = before[0].y - row[0].y if before else 0
        if before and not 0 <= drop <= PARAGRAPH * max(before[0].size, row[0].size):
            out.append("")
        out.append(text)
        before = row
    return "\n".join(out)


def close(values: list[float]) -> list[float]:
    """Sorted values, those near one another taken as one."""
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] > NEAR:
            out.append(v)
    return out


def grids(rulings: list[tuple]) -> list[tuple[list[float], list[float]]]:
    """(x borders, y borders) of the groups of horizontal and vertical lines that touch."""
    flat = [(min(a, c), min(b, d), max(a, c), max(b, d)) for a, b, c, d in rulings]
    flat = [r for r in flat if (r[2] - r[0] <= NEAR) != (r[3] - r[1] <= NEAR)]
    group = list(range(len(flat)))

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    by_left = sorted(range(len(flat)), key=lambda i: flat[i][0])
    open_: list[int] = []
    for i in by_left:  # a sweep from left to right: only lines that reach this far can touch
        a = flat[i]
        open_ = [j for j in open_ if flat[j][2] >= a[0] - NEAR]
        for j in open_:
            if flat[j][1] - NEAR <= a[3] and a[1] - NEAR <= flat[j][3]:
                group[root(i)] = root(j)
        open_.append(i)
    out = []
    for g in sorted({root(i) for i in range(len(flat))}):
        own = [flat[i] for i in range(len(flat)) if root(i) == g]
        xs = close([r[0] for r in own if r[2] - r[0] <= NEAR])
        ys = close([r[1] for r in own if r[3] - r[1] <= NEAR])
        if len(xs) > 1 and len(ys) > 1 and (len(xs) - 1) * (len(ys) - 1) > 1:
            out.append((xs, ys))
    return out


def ruled_tables(spans: list[Span], rulings: list[tuple]) -> tuple[list[tuple[float, list[list[str]]]], list[Span]]:
    """([(top, rows)], spans in none): the text in each cell of each grid."""
    tables, rest = [], list(spans)
    for xs, ys in grids(rulings):
        cells: dict[tuple[int, int], list[Span]] = {}
        outside = []
        for s in rest:
            x, y = s.x + min(s.size, s.end - s.x) / 2, s.y + s.size / 4
            column, row = sum(b <= x for b in xs) - 1, sum(b <= y for b in ys) - 1
            if 0 <= column < len(xs) - 1 and 0 <= row < len(ys) - 1:
                cells.setdefault((row, column), []).append(s)
            else:
                outside.append(s)
        if len(cells) > 1:
            text = lambda held: " ".join(filter(None, (joined(r).strip() for r in lines(held))))
            tables.append((ys[-1], [[text(cells.get((r, c), [])) for c in range(len(xs) - 1)] for r in range(len(ys) - 2, -1, -1)]))
            rest = outside
    return tables, rest


def gap_tables(spans: list[Span]) -> list[tuple[float, list[list[str]]]]:
    """[(top, rows)] of at least ROWS rows one below another whose short cells begin or end at the same places."""
    rows: list[list[Span]] = []
    for s in sorted(spans, key=lambda s: (-s.y, s.x)):
        if rows and abs(rows[-1][0].y - s.y) < LINE * s.size:
            rows[-1].append(s)
        else:
            rows.append([s])
    cut = []
    for row in rows:
        row.sort(key=lambda s: s.x)
        cells = [[row[0]]]
        for s in row[1:]:
            if s.x - cells[-1][-1].end > COLUMN * s.size:
                cells.append([s])
            else:
                cells[-1].append(s)
        cut.append([(c[0].x, c[-1].end, joined(c).strip()) for c in cells])
    tables, held = [], []

    def fits(a: list, b: list) -> bool:
        return len(a) == len(b) and all(abs(x[0] - y[0]) <= NEAR or abs(x[1] - y[1]) <= NEAR for x, y in zip(a, b, strict=True))

    for row, cells in zip([*rows, []], [*cut, []], strict=True):
        good = len(cells) >= COLUMNS and all(len(c[2]) <= CELL for c in cells)
        if held and not (good and fits(held[-1][1], cells) and held[-1][0][0].y - row[0].y <= 3 * row[0].size):
            if len(held) >= ROWS:
                tables.append((held[0][0][0].y, [[c[2] for c in h[1]] for h in held]))
            held = []
        if good:
            held.append((row, cells))
    return tables


def page_tables(spans: list[Span], rulings: list[tuple]) -> list[list[list[str]]]:
    """Tables of a page from top to bottom."""
    ruled, rest = ruled_tables(spans, rulings)
    return [rows for _, rows in sorted([*ruled, *gap_tables(rest)], key=lambda t: -t[0])]


PAGES = "source string, page_no int, text string, tables array<array<array<string>>>, error string"


def read_pages(files: DataFrame) -> DataFrame:
    """(source, page_no, text, tables, error) of every page of PDF files (path, content); a file that can't be read is one row with an error."""
    names = ["source", "page_no", "text", "tables", "error"]
    types = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.list_(pa.list_(pa.string()))), pa.string()]

    def rows_of(source: str, data: bytes):
        try:
            file, n = File(data), 0
            for n, info in enumerate(file.pages(), 1):
                page = Page(file, info)
                yield source, n, page_text(page.spans), page_tables(page.spans, page.rulings), None
            if not n:
                raise ValueError("the file has no pages")
        except Exception as e:  # the error is the file's result
            yield source, None, None, None, f"{type(e).__name__}: {e}"

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                held = []
                for row in rows_of(batch.column(0)[i].as_py(), batch.column(1)[i].as_py()):
                    held.append(row)
                    if len(held) == 64:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    return files.select(F.col("path"), F.col("content")).mapInArrow(run, PAGES)
