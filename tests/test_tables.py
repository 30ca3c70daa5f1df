"""Tables with headers of several tiers against a plain grid."""

import random

from quillspark.operators import tables

CELLS = f"t int, {tables.CELL}"


def plain_paths(head, width):
    """path and label of each column, by painting a grid."""
    top = min(r for r, *_ in head)
    tiers = max(r for r, *_ in head) - top + 1
    grid, at = [[None] * width for _ in range(tiers)], {}
    for row, _, rowspan, colspan, text in sorted(head):
        r = row - top
        c = at.get(r, 0)
        held = grid[r]
        while c < width and held[c] is not None:
            c += 1
        if c >= width:
            at[r] = width
            continue
        for y in range(r, min(r + rowspan, tiers)):
            for x in range(c, min(c + colspan, width)):
                grid[y][x] = text
        at[r] = c + colspan
    wide, c = {}, 0
    while c < width:
        end = c
        while end < width and grid[0][end] == grid[0][c]:
            end += 1
        if grid[0][c] and end - c >= 3:
            wide[grid[0][c]] = c
        c = end
    out = []
    for c in range(width):
        path = []
        for r in range(tiers):
            if grid[r][c] and (not path or path[-1] != grid[r][c]):
                path.append(grid[r][c])
        p = path[1:] if len(path) > 1 and wide.get(path[0], 0) > 0 and c >= wide[path[0]] else path
        label = "" if not p else p[0] if len(p) == 1 else f"{p[0]}<br>({p[1]})" if len(p) == 2 else f"{p[0]}: {p[1]}<br>({p[2]})"
        if c == 0:
            for name, first in wide.items():
                if first > 0 and name not in label:
                    label = f"{name} &amp;<br>{label}" if label else name
        out.append((c, path, label))
    return out


def test_headers_like_a_painted_grid(spark):
    rnd = random.Random(8)
    rows, want = [], []
    for t in range(150):
        top, tiers, width = rnd.randrange(3), rnd.randrange(2, 5), rnd.randrange(1, 8)
        head = []
        for r in range(tiers):
            left, n = width, 0
            while left > 0 and (n == 0 or rnd.random() < 0.85):
                span = rnd.randrange(1, min(left, 4) + 1)
                head.append((top + r, n, rnd.choice([1, 1, 2, 3, 9]), span, rnd.choice(["", "A", "B", "C", "AB"])))
                left, n = left - span, n + 1
        body = [(top + tiers + k, 0, 1, rnd.randrange(1, 9), "x") for k in range(rnd.randrange(3))]
        sums = {}
        for r, _, _, span, _ in head + body:
            sums[r] = sums.get(r, 0) + span
        rows += [(t, r, n, True, rs, cs, text) for r, n, rs, cs, text in head] + [(t, r, n, False, rs, cs, text) for r, n, rs, cs, text in body]
        want += [(t, *x) for x in plain_paths(head, max(sums.values()))]
    rnd.shuffle(rows)
    got = tables.header_paths(spark.createDataFrame(rows, CELLS), ["t"]).collect()
    assert sorted((r.t, r.col, list(r.path), r.label) for r in got) == sorted(want)


def test_bodies(spark):
    def body(*rows, head=1):
        return [(0, r, n, False, 1, cs, text) for r, row in enumerate(rows, head) for n, (text, cs) in enumerate(row)] + [(0, 0, n, True, 1, 1, "h") for n in range(8)]

    note = "a note that is longer than twenty"
    full = [(f"c{k}", 1) for k in range(8)]
    six = [(f"x{k}", 1) for k in range(6)]
    lots = [("same", 1), *[("v", 1)] * 7]
    cases = [full, [("only", 1)], [("a", 1), ("mid", 5)], [("1.", 1), *six], [("a", 1), *six], lots, [("same", 1), *[(note, 1)] * 7], full, [("n", 1), (note, 7)], [("end", 8)]]
    got = {r.row_no: (r.part, list(r.texts), r.dense) for r in tables.body_rows(spark.createDataFrame(body(*cases), CELLS), ["t"]).collect()}
    e = [""]
    want = [
        [f"c{k}" for k in range(8)], ["only"] + e * 7, ["a", "", "", "mid", "", "", "", ""], ["1.", *[f"x{k}" for k in range(6)], ""], ["", "a", *[f"x{k}" for k in range(6)]], ["same", "", "", "", "v", "", "", ""], ["same", note] + e * 6,
        [f"c{k}" for k in range(8)], ["n", note], ["end"],
    ]
    assert [got[k + 1] for k in range(10)] == [(2 if k > 7 else 1, w, True) for k, w in enumerate(want)]


def test_cells_of_pages(spark):
    pages = spark.createDataFrame([(1, '<table><tr><th rowspan="2">A <b>b</b></th><th colspan=x>c</th></tr><tr><th>d<tr><td>1<table><tr><td>in</table></td></table>'), (2, None), (3, "<td>no table</td>")], "p long, html string")
    got = sorted((r.p, r.table_no, r.row_no, r.cell_no, r.header, r.rowspan, r.colspan, r.text) for r in tables.html_cells(pages, "p", "html").collect())
    assert got == [(1, 0, 0, 0, True, 2, 1, "A b"), (1, 0, 0, 1, True, 1, 1, "c"), (1, 0, 1, 0, True, 1, 1, "d"), (1, 0, 2, 0, False, 1, 1, "1"), (1, 1, 0, 0, False, 1, 1, "in")]
    none = spark.createDataFrame([], CELLS)
    assert tables.header_paths(none, ["t"]).count() == tables.body_rows(none, ["t"]).count() == 0


def test_pages_of_tables_are_parsed_once(spark):
    """Header paths and bodies read the cells several times; pages are parsed by one pass before that."""
    import __spark_entry__ as entry

    for name in ("header_paths", "flat_tables"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan, name
