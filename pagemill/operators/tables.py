"""Tables of a page: rows whose cells stand in tracks, cells between ruled lines, and which of the two counts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators.folds import bands_of
from pagemill.runtime import map_groups

PAGE = ("doc_id", "page")
#: Least rows and columns of a table without lines, least share of filled cells, greatest variation of the gaps between its rows,
#: characters from which a cell is prose, share of the text of its lines that a table must carry.
ROWS, COLUMNS, FILLED, VARIES, PROSE, CARRIED = 3, 2, 0.5, 1.0, 90, 0.7
#: Points within which edges are one, and within which a cell belongs to a track.
SNAP, TRACK = 3.0, 6.0
_VALUE = re.compile(r"^[-+(]?[$€£]?\d[\d.,\s]*%?\)?$|^(?:n/?a|-|–|—)$", re.IGNORECASE)
_LABEL = re.compile(r"^[^.!?]{1,40}:$|^[A-ZÀ-Þ][^.!?:]{0,38}$")


@dataclass
class Cell:
    x0: float
    y0: float
    x1: float
    y1: float
    text: str


@dataclass
class Table:
    """Rows of cells by column ('' where there is none), over the lines first to last (that one not included)."""

    kind: str
    first: int
    last: int
    rows: list[list[str]]
    lines: set[int] = field(default_factory=set)


def split_line(items: list[tuple]) -> list[Cell]:
    """Cells of a line of items (x, y, width, height, size, text): a new one where the gap exceeds the size of the text before."""
    out: list[Cell] = []
    size = 0.0
    for x, y, w, h, s, text in sorted(items):
        if out and x - out[-1].x1 <= size:
            last = out[-1]
            last.text += (" " if not last.text.endswith(" ") else "") + text.strip()
            last.x1, last.y0, last.y1 = max(last.x1, x + w), min(last.y0, y), max(last.y1, y + h)
        else:
            out.append(Cell(x, y, x + w, y + h, text.strip()))
        size = s or h
    return out


def lines_of(items: list[tuple]) -> list[list[Cell]]:
    items = sorted((i for i in items if i[5].strip()), key=lambda i: (i[1], i[0]))
    lines: list[list[tuple]] = []
    for item, n in zip(items, bands_of([i[1] for i in items], [i[3] for i in items]), strict=True):
        if n > len(lines):
            lines.append([])
        lines[-1].append(item)
    return [split_line(own) for own in lines]


def track_of(cell: Cell, tracks: list[tuple[float, float]]) -> int | None:
    """The track that holds a cell's centre, else the nearest one that begins, else that ends, beside it."""
    centre = (cell.x0 + cell.x1) / 2
    inside = [i for i, (a, b) in enumerate(tracks) if a <= centre < b]
    if inside:
        return inside[0]
    for distance in (lambda t: abs(cell.x0 - t[0]), lambda t: abs(cell.x1 - t[1])):
        near = min(range(len(tracks)), key=lambda i: distance(tracks[i]), default=None)
        if near is not None and distance(tracks[near]) <= TRACK:
            return near
    return None


def _placed(row: list[Cell], tracks: list[tuple[float, float]]) -> list[int] | None:
    """Tracks of a row's cells, if each has one of its own."""
    own = [track_of(c, tracks) for c in row]
    return own if None not in own and len(set(own)) == len(own) else None


def variation(gaps: list[float]) -> float:
    """Population deviation over the mean; 0 for fewer than two gaps."""
    if len(gaps) < 2 or not sum(gaps):
        return 0.0
    mean = sum(gaps) / len(gaps)
    return (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5 / mean


def borderless(lines: list[list[Cell]]) -> list[Table]:
    """Runs of lines whose cells stand in the same tracks.

    A run begins with a line of two cells and grows while lines of two cells fit its tracks, which take in their extents; lines of
    one cell that lies in a track belong to it if such a line follows. It is a table with enough rows, of which cells are filled
    evenly and short, at even distances.
    """
    out: list[Table] = []
    i = 0
    while i < len(lines):
        if len(lines[i]) < COLUMNS:
            i += 1
            continue
        tracks = [(c.x0, c.x1) for c in lines[i]]
        rows = [(i, list(range(len(tracks))))]
        pending: list[tuple[int, list[int]]] = []
        j = i + 1
        while j < len(lines):
            gap = lines[j][0].y0 - max(c.y1 for c in lines[j - 1])
            tall = max(c.y1 - c.y0 for c in lines[j - 1])
            if gap > 3 * max(tall, 1.0):
                break
            own = _placed(lines[j], tracks)
            if own is None and len(lines[j]) > len(tracks) and len(rows) == 1 and (back := _placed(lines[i], [(c.x0, c.x1) for c in lines[j]])) is not None:
                tracks, own = [(c.x0, c.x1) for c in lines[j]], list(range(len(lines[j])))  # a header of fewer cells
                rows = [(i, back)]
            if own is None:
                break
            if len(own) >= COLUMNS:
                rows += [*pending, (j, own)]
                pending = []
                tracks = [(min(a, *(c.x0 for c, t in zip(lines[j], own) if t == k)), max(b, *(c.x1 for c, t in zip(lines[j], own) if t == k))) if k in own else (a, b) for k, (a, b) in enumerate(tracks)]
            else:
                pending.append((j, own))
                if len(pending) > 2:
                    break
            j += 1
        table = _table("text", lines, rows, len(tracks))
        if table:
            out.append(table)
            i = table.last
        else:
            i += 1
    return out


def _table(kind: str, lines: list[list[Cell]], rows: list[tuple[int, list[int]]], columns: int) -> Table | None:
    grid = []
    for n, own in rows:
        texts = [""] * columns
        for c, t in zip(lines[n], own, strict=True):
            texts[t] = c.text
        grid.append(texts)
    full = sum(1 for _, own in rows if len(own) >= COLUMNS)
    filled = sum(bool(t) for r in grid for t in r)
    tops = [lines[n][0].y0 for n, _ in rows]
    sizes = [len(t) for r in grid for t in r if t]
    if full < ROWS or columns < COLUMNS or filled < FILLED * len(grid) * columns or variation([b - a for a, b in zip(tops, tops[1:])]) > VARIES:
        return None
    if sum(s > PROSE for s in sizes) * 3 > len(sizes):
        return None
    return Table(kind, rows[0][0], rows[-1][0] + 1, merge_continuations(grid), {n for n, _ in rows})


def _continues(before: str, after: str) -> bool:
    return not before.rstrip().endswith((".", "!", "?", ":")) and (after[:1].islower() or before.rstrip().endswith(("-", ",", "(")))


def merge_continuations(rows: list[list[str]]) -> list[list[str]]:
    """Rows with wrapped cells put together: a row whose first cell is empty goes into the one before if it has nothing in other places
    than that one, no values, and a cell of which goes on. Tables whose first column is mostly empty are left alone."""
    if sum(bool(r[0].strip()) for r in rows) * 2 < len(rows):
        return rows
    out: list[list[str]] = []
    for row in rows:
        own = [i for i, t in enumerate(row) if t.strip()]
        before = out[-1] if out else None
        if before and own and not row[0].strip() and before[0].strip() and all(before[i].strip() for i in own) and not any(_VALUE.match(row[i].strip()) for i in own) and any(_continues(before[i], row[i].strip()) for i in own):
            for i in own:
                before[i] += " " + row[i].strip()
        else:
            out.append(list(row))
    return out


def description_lists(lines: list[list[Cell]], taken: set[int]) -> list[Table]:
    """Runs of at least three lines of a label and a value beside it, the labels and the values each with one left edge."""
    out, run = [], []
    for n, row in [*enumerate(lines), (len(lines), [])]:
        fits = n not in taken and len(row) == 2 and _LABEL.match(row[0].text) and len(row[1].text) <= 200
        if fits and (not run or abs(row[0].x0 - lines[run[0]][0].x0) <= SNAP and abs(row[1].x0 - lines[run[0]][1].x0) <= SNAP and n == run[-1] + 1):
            run.append(n)
            continue
        if len(run) >= ROWS and sum(lines[k][0].text.endswith(":") for k in run) * 2 >= len(run):
            out.append(Table("list", run[0], run[-1] + 1, [[c.text for c in lines[k]] for k in run], set(run)))
        run = [n] if fits else []
    return out


def merged_edges(values: list[float], snap: float = SNAP) -> list[float]:
    """Positions chained while they lie within the snap, each chain as its mean."""
    out: list[list[float]] = []
    for v in sorted(values):
        if out and v - out[-1][-1] <= snap:
            out[-1].append(v)
        else:
            out.append([v])
    return [sum(g) / len(g) for g in out]


def rule_components(hs: list[tuple], vs: list[tuple]) -> list[tuple[list[tuple], list[tuple]]]:
    """Horizontal (y, x1, x2) and vertical (x, y1, y2) rules in groups that cross each other."""
    parent = list(range(len(hs) + len(vs)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (y, x1, x2) in enumerate(hs):
        for j, (x, y1, y2) in enumerate(vs):
            if x1 - SNAP <= x <= x2 + SNAP and y1 - SNAP <= y <= y2 + SNAP:
                parent[root(i)] = root(len(hs) + j)
    groups: dict[int, tuple[list, list]] = {}
    for i in range(len(parent)):
        g = groups.setdefault(root(i), ([], []))
        g[0].append(hs[i]) if i < len(hs) else g[1].append(vs[i - len(hs)])
    return [g for g in groups.values() if len(g[0]) >= 2 and len(g[1]) >= 2]


def ruled(lines: list[list[Cell]], hs: list[tuple], vs: list[tuple]) -> list[Table]:
    """Tables between rules that cross: each item's centre names its cell. Empty rows and columns go. A grid that running text crosses
    is none: where a third of the lines inside have cells over its column edges."""
    out = []
    for horizontal, vertical in rule_components(hs, vs):
        ys, xs = merged_edges([h[0] for h in horizontal]), merged_edges([v[0] for v in vertical])
        if len(ys) < 2 or len(xs) < 2:
            continue
        grid = [["" for _ in xs[1:]] for _ in ys[1:]]
        inside: set[int] = set()
        crossed = 0
        for n, line in enumerate(lines):
            over = False
            for c in line:
                cx, cy = (c.x0 + c.x1) / 2, (c.y0 + c.y1) / 2
                row = next((i for i in range(len(ys) - 1) if ys[i] <= cy < ys[i + 1]), None)
                col = next((i for i in range(len(xs) - 1) if xs[i] <= cx < xs[i + 1]), None)
                if row is None or col is None:
                    continue
                over |= any(c.x0 + SNAP < x < c.x1 - SNAP for x in xs[1:-1])
                grid[row][col] += (" " if grid[row][col] else "") + c.text
                inside.add(n)
            crossed += over
        rows = [r for r in grid if any(r)]
        kept = [k for k in range(len(xs) - 1) if any(r[k] for r in rows)]
        rows = [[r[k] for k in kept] for r in rows]
        if len(rows) >= 2 and kept and crossed * 3 <= len(inside):
            out.append(Table("ruled", min(inside), max(inside) + 1, rows, inside))
    return out


def _filled(t: Table) -> int:
    return sum(bool(c.strip()) for r in t.rows for c in r)


def resolve(lined: list[Table], plain: list[Table]) -> list[Table]:
    """Ruled tables and others, without those that overlap: a ruled one counts, unless it has one column and the other several, or the
    other has over twice its filled cells."""
    meet = lambda a, b: a.first < b.last and b.first < a.last
    kept = []
    for r in lined:
        rivals = [p for p in plain if meet(r, p)]
        single = len(r.rows[0]) <= 1 and any(len(p.rows[0]) >= 2 for p in rivals)
        if not single and not any(_filled(p) >= 2 * _filled(r) + 4 for p in rivals):
            kept.append(r)
    kept += [p for p in plain if not any(meet(k, p) for k in kept)]
    return sorted(kept, key=lambda t: (t.first, t.last))


def text_carried(table: Table, lines: list[list[Cell]]) -> float:
    """Share of the visible characters of a table's lines that its cells carry."""
    size = lambda s: len(re.sub(r"\s", "", s))
    whole = sum(size(c.text) for n in table.lines for c in lines[n])
    return sum(size(c) for r in table.rows for c in r) / whole if whole else 1.0


def find_tables(items: DataFrame, horizontals: DataFrame | None = None, verticals: DataFrame | None = None) -> DataFrame:
    """Cells of the tables of each page: (doc_id, page, table, kind 'ruled' | 'text' | 'list', row, col, text), all from 1.

    `horizontals` (doc_id, page, y, x1, x2) and `verticals` (doc_id, page, vx, v1, v2) are ruled lines. Cells that stand in rows of
    a table come with '' where they are empty. Null and blank texts and null boxes are in no table. A table that carries under
    70 % of the text of its lines is none. The rows of a page, its rules among them, come to one fold.
    """
    number = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    own = items.filter(F.col("text").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    rows = own.select(*PAGE, "seq", F.lit("i").alias("what"), F.col("x").alias("a"), F.col("y").alias("b"), number("width").alias("c"), number("height").alias("d"), number("font_size").alias("e"), "text")
    none = [F.lit(None).cast("double").alias("d"), F.lit(None).cast("double").alias("e"), F.lit(None).cast("string").alias("text")]
    if horizontals is not None:
        rows = rows.unionByName(horizontals.select(*PAGE, F.lit(0).alias("seq"), F.lit("h").alias("what"), F.col("y").alias("a"), F.col("x1").alias("b"), F.col("x2").alias("c"), *none))
    if verticals is not None:
        rows = rows.unionByName(verticals.select(*PAGE, F.lit(0).alias("seq"), F.lit("v").alias("what"), F.col("vx").alias("a"), F.col("v1").alias("b"), F.col("v2").alias("c"), *none))

    def run(cols: dict[str, list]) -> list[tuple]:
        all_ = list(zip(*(cols[c] for c in ("what", "a", "b", "c", "d", "e", "text")), strict=True))
        lines = lines_of([r[1:] for r in all_ if r[0] == "i"])
        lined = ruled(lines, [r[1:4] for r in all_ if r[0] == "h"], [r[1:4] for r in all_ if r[0] == "v"])
        plain = borderless(lines)
        plain += description_lists(lines, {n for t in plain for n in t.lines})
        tables = [t for t in resolve(lined, plain) if text_carried(t, lines) >= CARRIED]
        return [(cols["doc_id"][0], cols["page"][0], k, t.kind, r, c, text) for k, t in enumerate(tables, 1) for r, row in enumerate(t.rows, 1) for c, text in enumerate(row, 1)]

    return map_groups(rows, PAGE, ["what", "seq", "a", "b"], run, "doc_id long, page int, table int, kind string, row int, col int, text string")


def grid_cells(items: DataFrame, columns: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, page, row, col, text): texts of items by the cell of a ruled grid that holds their centre. `columns` and `rows`
    (doc_id, page, n, lo, hi) are the intervals between its edges, the lower one included."""
    cx, cy = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    own = items.filter(F.col("text").isNotNull()).select(*PAGE, "seq", "text", cx.alias("cx"), cy.alias("cy"), "y", "x")
    c = columns.select(*PAGE, F.col("n").alias("col"), F.col("lo").alias("c0"), F.col("hi").alias("c1"))
    r = rows.select(*PAGE, F.col("n").alias("row"), F.col("lo").alias("r0"), F.col("hi").alias("r1"))
    met = own.join(c, list(PAGE)).filter((F.col("cx") >= F.col("c0")) & (F.col("cx") < F.col("c1"))).join(r, list(PAGE)).filter((F.col("cy") >= F.col("r0")) & (F.col("cy") < F.col("r1")))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "seq", "text"))), lambda s: s["text"])
    return met.groupBy(*PAGE, "row", "col").agg(F.array_join(pieces, " ").alias("text"))


def fused_regions(regions: DataFrame, aligned: float = 0.7) -> DataFrame:
    """(doc_id, page, region, fused): side by side regions of a page (doc_id, page, region, x0, x1, y0 of each line) that are slices of one
    table, named by their leftmost: at least three lines each, of which 70 % stand beside a line of the other, and mostly short ones
    (column chars)."""

    def run(cols: dict[str, list]) -> list[tuple]:
        held: dict[int, list[tuple]] = {}
        for region, x0, x1, y0, chars in zip(*(cols[c] for c in ("region", "x0", "x1", "y0", "chars")), strict=True):
            held.setdefault(region, []).append((x0, x1, y0, chars))
        order = sorted(held, key=lambda k: min(r[0] for r in held[k]))
        name = {k: k for k in order}
        for a, b in zip(order, order[1:]):
            left, right = held[a], held[b]
            if min(len(left), len(right)) < ROWS or max(r[1] for r in left) > min(r[0] for r in right) + SNAP:
                continue
            beside = sum(any(abs(r[2] - s[2]) <= SNAP for s in right) for r in left)
            short = sum(r[3] <= 25 for r in (*left, *right))
            if beside >= aligned * max(len(left), len(right)) and short * 10 >= 7 * (len(left) + len(right)):
                name[b] = name[a]
        return [(cols["doc_id"][0], cols["page"][0], k, name[k]) for k in order]

    return map_groups(regions.select(*PAGE, "region", "x0", "x1", "y0", "chars"), PAGE, ["region", "y0"], run, "doc_id long, page int, region int, fused int")
